import math
import re
import zlib
from collections import Counter

import pytest

from veilwork.llm.lm_scoring import BLOCK, PAIR_WEIGHT, TRIPLE_WEIGHT, score, score_held_out
from veilwork.llm.queries import QUERIES

ROOT = "/root/testdata/sf0.01"


def tokens(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lowered) + [None]


def brute(docs, training):
    """The automaton with dictionaries, one token after the other, along arcs and failure arcs."""
    sequences = [tokens(t) for t in training]
    uni = Counter(w for s in sequences for w in s)
    total, distinct = sum(uni.values()), len(uni)
    pairs = Counter(p for s in sequences for p in zip(["^", *s], s))
    triples = Counter(t for s in sequences for t in zip(["^", *s], s, s[1:]))
    history = {(): 0, ("^",): len(training), **{(w,): n for w, n in uni.items()}, **pairs}
    learned = {**{(w,): n for w, n in uni.items()}, **pairs, **triples}
    weight = {1: PAIR_WEIGHT, 2: TRIPLE_WEIGHT}

    def p(w, state):
        if not state:
            return (uni[w] + 1) / (total + distinct + 1)
        k = weight[len(state)]
        return (learned.get((*state, w), 0) + k * p(w, state[1:])) / (history[state] + k)

    def step(state, w):
        log = 0.0
        while state and (*state, w) not in learned:  # failure arcs
            k = weight[len(state)]
            log, state = log + math.log10(k / (history[state] + k)), state[1:]
        log += math.log10(p(w, state))
        state = (*state, w)[-2:]
        while state and not history.get(state):
            state = state[1:]
        return log, state

    out = []
    for doc, text in docs:
        s, score, state = tokens(text), 0.0, ("^",) if training else ()
        for w in s:
            log, state = step(state, w)
            score += log
        out.append((doc, len(s), sum(uni[w] > 0 for w in s), total, sum(math.log10(p(w, ())) for w in s), score))
    for state in [x for x in history if x and x[-1] is not None and history[x]]:  # a state's probabilities sum to one
        assert sum(p(w, state) for w in [*uni, "not learned"]) == pytest.approx(1)
    return out


@pytest.mark.parametrize("block_bytes", [BLOCK, 24, 1])
def test_brute_force(spark, block_bytes):
    train = ["a b c", "a b c d", "A b", "x a b c d", "c d c d c d a b", "", "q w e r t y", None, "a a a a a b", "b " * 300]
    docs = [(i, t) for i, t in enumerate(train)] + [(50, "never seen words a b c"), (51, None), (52, ""), (53, "b c d\tA"), (None, "a b"), (50, "a b")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = score(frame, spark.createDataFrame([(t, 1) for t in train], "text string, n int"), block_bytes=block_bytes)
    expected = sorted(brute(docs, train), key=repr)
    for a, b in zip(sorted((tuple(r) for r in got.collect()), key=repr), expected, strict=True):
        assert a[:4] == b[:4] and a[4:] == pytest.approx(b[4:], abs=1e-6)


def test_query(spark):
    docs = spark.read.parquet(f"{ROOT}/documents.parquet").toPandas()
    got = QUERIES["op10_lm_scoring"](spark, ROOT).toPandas().set_index("doc_id")
    train = [t for d, t in zip(docs["doc_id"], docs["text"], strict=True) if zlib.crc32(str(d).encode()) % 7 != 2]
    uni = Counter(w for t in train for w in tokens(t))
    total, distinct = sum(uni.values()), len(uni)
    assert len(got) == len(docs) and set(got["train_tokens"]) == {total}
    for d, t in zip(docs["doc_id"], docs["text"], strict=True):
        row, s = got.loc[d], tokens(t)
        assert row.held_out == (zlib.crc32(str(d).encode()) % 7 == 2)
        assert (row.n_tokens, row.n_known) == (len(s), sum(uni[w] > 0 for w in s))
        assert row.base_score == pytest.approx(sum(math.log10((uni[w] + 1) / (total + distinct + 1)) for w in s), rel=1e-9)
    held = got[got["held_out"]]
    assert held["score"].sum() > held["base_score"].sum()  # histories help on texts that were not learned


def test_nothing_learned(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in score(docs, docs.where("false")).collect()}
    assert [(got[i].n_tokens, got[i].n_known, got[i].train_tokens, got[i].base_score, got[i].score) for i in (1, 2)] == [(3, 0, 0, 0, 0), (1, 0, 0, 0, 0)]
    assert score_held_out(docs.where("false")).count() == 0
