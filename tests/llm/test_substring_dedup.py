import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from veilwork.llm.substring_dedup import LEAST, Entries, Search, answer, dedup_substrings, longest_repeats, pack, unpack

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string"


def brute(docs, window):
    texts = [(doc, LEAST if doc is None else doc, WORD.findall(text or "")) for doc, text in docs]
    gone, longest, length = [set() for _ in docs], [0] * len(docs), window
    while any(len(words) >= length for *_, words in texts):
        first = {}
        for _, key, words in texts:
            for i in range(len(words) - length + 1):
                w = hash(tuple(words[i : i + length]))
                first[w] = min(first.get(w, key), key)
        for k, (_, key, words) in enumerate(texts):
            for i in range(len(words) - length + 1):
                if first[hash(tuple(words[i : i + length]))] < key:
                    longest[k] = length
                    gone[k].update(range(i, i + window) if length == window else ())
        length *= 2
        if not any(n == length // 2 for n in longest):
            break
    return sorted(
        ((doc, len(words), len(out), n, " ".join(w for i, w in enumerate(words) if i not in out)) for (doc, _, words), out, n in zip(texts, gone, longest, strict=True)),
        key=repr,
    )


def corpus(seed, n, words, longest):
    """Documents with shared passages, copies, periodic text, nulls, repeated ids and rows."""
    rng = random.Random(seed)
    some = lambda k: " ".join(rng.choice(words) for _ in range(k))
    shared = [some(rng.randrange(3, longest)) for _ in range(6)]
    docs = []
    for i in range(n):
        parts = [rng.choice([some(rng.randrange(0, longest)), rng.choice(shared), "a " * rng.randrange(20)]) for _ in range(3)]
        docs.append((rng.randrange(-n, 4 * n), rng.choice([" ", "\n\t", "\x0b "]).join(parts)))
    docs += [(docs[k][0], docs[k][1]) for k in range(0, n, 7)] + [(5_000 + k, docs[k][1]) for k in range(0, n, 5)]
    return docs + [(None, shared[0]), (None, None), (1, None), (2, ""), (3, " \n "), (LEAST, shared[1]), ((1 << 63) - 1, shared[1])]


@pytest.mark.parametrize("window,part_bytes", [(2, 4 << 20), (5, 300), (6, 1), (12, 2000)])
def test_brute_force(spark, rows, window, part_bytes):
    """Windows of even and odd length, over one part, few parts and a part per row."""
    docs = corpus(window, 60, ["x", "y", "Y", "é", "zwei", "w" * 30], 3 * window + 3)
    df = spark.createDataFrame(docs, SCHEMA).repartition(4)
    assert rows(dedup_substrings(df, window, part_bytes)) == brute(docs, window)


def test_production_window_and_a_long_text(spark, rows):
    rng = random.Random(3)
    text = [f"w{rng.randrange(5000)}" for _ in range(30_000)]
    docs = [(9, " ".join(text)), (4, " ".join(text[700:760])), (3, " ".join(text[20_000:20_049])), (10, "new " + " ".join(text[100:150]) + " end")]
    docs += [(100 + i, " ".join(text[5000 : 5000 + 45 + i])) for i in range(20)] + [(200, "b " * 400), (201, "b " * 49), (202, "b " * 50)]
    assert rows(dedup_substrings(spark.createDataFrame(docs, SCHEMA))) == brute(docs, 50)


def test_a_third_of_all_rows_share_a_passage(spark, rows):
    rng = random.Random(4)
    passage = " ".join(f"p{i}" for i in range(60))
    some = lambda: " ".join(f"q{rng.randrange(900)}" for _ in range(30))
    docs = [(i, f"{some()} {passage if i % 3 == 0 else ''} {some()}") for i in range(900)]
    assert rows(dedup_substrings(spark.createDataFrame(docs, SCHEMA).repartition(6), 50, 4000)) == brute(docs, 50)


def test_empty_table_and_clashing_columns(spark, rows):
    assert dedup_substrings(spark.createDataFrame([], SCHEMA)).count() == 0
    df = spark.createDataFrame([(1, "a b c", "x", 3), (2, "a b c", "y", 4)], f"{SCHEMA}, part string, seq int")
    assert rows(dedup_substrings(df, 3)) == [(1, 3, 0, 0, "a b c"), (2, 3, 3, 3, "")]


def test_doubles_until_no_candidates_survive(spark, rows):
    base = " ".join(f"w{i}" for i in range(300))
    docs = [(1, base + " one"), (2, "two " + " ".join(f"w{i}" for i in range(40, 260)))]
    found = dict(rows(longest_repeats(spark.createDataFrame(docs, SCHEMA).coalesce(1), 25)))
    assert found == {25: 196, 50: 171, 100: 121, 200: 21}


def test_texts_are_not_shuffled_again(spark):
    search = Search(spark.createDataFrame(corpus(1, 50, ["x", "y", "z"], 20), SCHEMA), 5, 500, 1 << 20, "doc_id", "text")
    search.climb()
    plan = search.kept()._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and plan.count("Exchange") <= 2  # the answers only, and the union's
    assert "Bucketed: true" in plan


@given(st.lists(st.tuples(st.integers(0, 2**64 - 1), st.integers(0, 2**32 - 1), st.integers(LEAST, -LEAST - 1), st.booleans()), min_size=1, max_size=40))
@settings(max_examples=100, deadline=None)
def test_payloads_round_trip(entries):
    low, high, least, several = (np.array(x, t) for x, t in zip(zip(*entries, strict=True), ("u8", "u4", "i8", "?"), strict=True))
    for got, want in zip(unpack(len(low), pack(low, high, least, several)), (low, high, least, several), strict=True):
        assert (got == want).all()


def test_answers():
    import pyarrow as pa

    def asked(part, low, ids):
        low = np.array(low, np.uint64)
        return [r for r in Entries(low, np.zeros(len(low), np.uint32), np.array(ids)).asked(part, 1, 6)]

    rows = asked(1, [5, 5, 7, 9], [10, 11, 10, 10]) + asked(2, [7, 9, 9], [4, 10, 10])
    batch = pa.RecordBatch.from_pylist([dict(zip(["part", "level", "bucket", "n", "payload"], r, strict=True)) for r in rows])
    got = {r["part"]: r for b in answer(iter([batch])) for r in b.to_pylist()}
    bits = lambda part, name: np.unpackbits(np.frombuffer(got[part][name], np.uint8), count=got[part]["n"]).tolist()
    assert bits(1, "both") == [1, 1, 0] and bits(1, "smaller") == [0, 1, 0]
    assert bits(2, "both") == [1, 0] and bits(2, "smaller") == [0, 0]
