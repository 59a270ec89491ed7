import itertools
import random
import time
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece

from veilwork.llm import piece_sampling as ps
from veilwork.llm.queries import PIECES, QUERIES

TEXTS = ["", " ", "a", "hello world", "  two  spaces ", "tab\tand\nline", "▁literal▁", "emoji 😀 日本語 \u0000x", "é" * 50, "x" * 5000, "a " * 3000, "ÀÉ́ ﬁ"]


def seeds(n):
    return ps.mix(np.arange(n, dtype=np.uint64))


def test_round_trip_and_library_decoding():
    v = ps.vocabulary(PIECES)
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for text, ids in zip(TEXTS, ps.encode_texts(v, TEXTS, seeds(len(TEXTS))), strict=True):
        assert ps.decode_ids(v, ids.tolist()) == text
        if "\u0000" not in text:
            assert model.decode(ids.tolist()) == text.removeprefix(" ") or model.decode(ids.tolist()) == text


def test_batching_changes_nothing():
    v = ps.vocabulary(PIECES)
    whole = ps.encode_texts(v, TEXTS, seeds(len(TEXTS)))
    for i, text in enumerate(TEXTS):
        assert (ps.encode_texts(v, [text], seeds(len(TEXTS))[i : i + 1])[0] == whole[i]).all()


@pytest.mark.parametrize("theta", [0.0, 0.5, 1.0])
def test_shares_of_all_segmentations(theta):
    """Brute force: enumerate all paths of a short word and compare the shares of 20,000 samples."""
    v, text = ps.vocabulary(PIECES, theta), "theñ"
    full = " " + text
    weight = {}
    for cuts in itertools.product([0, 1], repeat=len(full) - 1):
        ends = [i + 1 for i, c in enumerate(cuts) if c] + [len(full)]
        parts = [full[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        ids, w = v.find(np.array([ps._hash(p) for p in parts], np.uint64))
        w = [v.byte_weight if i < 0 and len(p) == 1 else x for i, x, p in zip(ids, w, parts, strict=True)]
        if np.prod(w) > 0:
            weight[tuple(parts)] = np.prod(w)
    n = 20_000
    got = Counter(tuple(v.bytes_of[i].decode() for i in ids) for ids in ps.encode_texts(v, [text] * n, seeds(n)))
    total = sum(weight.values())
    for parts, w in weight.items():
        assert abs(got.get(parts, 0) / n - w / total) < 0.02
    assert set(got) <= set(weight)


def test_frames(spark, rows):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, None, "y"), (3, "hello world", "z")], "doc_id long, text string, pieces string")
    encoded = ps.encode(docs, PIECES)
    back = ps.decode(encoded, PIECES)
    assert rows(back) == sorted([(i, t) for i, t in enumerate(TEXTS)] + [(None, ""), (3, "hello world")], key=repr)
    assert rows(encoded) == rows(ps.encode(docs.repartition(5), PIECES))
    trip = ps.round_trip(docs, PIECES)
    assert trip.where("NOT lossless").count() == 0 and trip.count() == len(TEXTS) + 2
    assert ps.encode(docs.where("false"), PIECES).count() == 0


def test_query(spark):
    got = QUERIES["op7_piece_sampling"](spark, "/root/testdata/sf0.01")
    assert got.where("lossless").count() == spark.read.parquet("/root/testdata/sf0.01/documents.parquet").count()


def test_edges_are_all_pieces_that_end_at_a_place():
    v, text = ps.vocabulary(PIECES), " internationalisation日本\u0000ab"
    points = np.array([ord(c) for c in text], np.uint32)
    pieces = {b.decode(): i for i, b in enumerate(v.bytes_of) if len(b) > 1 or (b and i in v.ids)}
    edges = ps._edges(v, points, np.arange(len(text)))
    for end in range(len(text)):
        got = {m + 1: int(v.ids[e]) for m, e in enumerate(edges[end]) if e >= 0}
        want = {m: pieces[text[end + 1 - m : end + 1]] for m in range(1, end + 2) if text[end + 1 - m : end + 1] in pieces}
        assert got == want and (edges[end, 0] == -2) == (1 not in want)


def test_spans_begin_where_no_edge_leads_across():
    v, text = ps.vocabulary(PIECES), " the" + "\u0000" * 3 + "and" * 40 + "日\u0000本"
    points, within = np.array([ord(c) for c in text], np.uint32), np.arange(len(text))
    edges = ps._edges(v, points, within)
    starts = set(np.flatnonzero(ps._spans(edges, within)).tolist())
    for p in range(1, len(text)):
        crossing = any(edges[e, m] != -1 and e - m < p <= e for e in range(len(text)) for m in range(v.longest) if m <= e)
        assert (p in starts) == (not crossing)


@pytest.mark.parametrize("theta", [0.0, 20.0])
def test_extreme_weights_in_a_long_text_without_spaces(theta):
    v, text = ps.vocabulary(PIECES, theta), "ab" * 2000 + "\u0000" * 200 + "the" * 1000
    (ids,) = ps.encode_texts(v, [text], seeds(1))
    assert ps.decode_ids(v, ids.tolist()) == text


def test_round_trip_is_one_worker_a_task(spark):
    """Every Python node of a task is a worker of its own, with a vocabulary and a portion of its own."""
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    trip = ps.round_trip(docs, PIECES, theta=0.5, seed=7)
    assert trip._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    encoded = {row["id"]: row["pieces"] for row in ps.encode(docs, PIECES, theta=0.5, seed=7).collect()}
    for row in trip.collect():
        assert row["lossless"] and row["pieces_crc32"] == zlib.crc32(np.array(encoded[row["doc_id"]], "<u4").tobytes())


def test_a_task_holds_little_more_than_a_portion():
    rng = random.Random(3)
    texts = ["".join(rng.choices("abcdefghij ", k=3_000)) for _ in range(700)]
    batch = pa.record_batch([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["id", "text"])
    ps.vocabulary(PIECES)
    tracemalloc.start()
    rows = sum(out.num_rows for out in ps._encode(PIECES, 1.0, 1)(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == len(texts) and peak < 100e6


def by_rows(v, edges, begin, size):
    """The forward filter with the edges into a character as a row: running sums of their shares."""
    sums, alpha = np.zeros(edges.shape, np.float32), np.zeros((len(size), v.longest))
    alpha[:, 0] = 1.0
    for t in range(int(size[0])):
        k, c = int(np.searchsorted(-size, -t)), min(t + 1, v.longest)
        at, alpha = begin[:k] + t, alpha[:k]
        values = np.cumsum(alpha[:, :c] * v.weights[edges[at, :c]], 1)
        sums[at, :c] = values / values[:, -1:]
        alpha[:, 1 : c + 1] = alpha[:, : min(c, v.longest - 1)].copy()
        alpha[:, :1] = values[:, -1:]
        if values[:, -1].min() < 1e-100:
            alpha /= alpha.max(1, keepdims=True)
    return sums


def test_shares_are_those_by_rows_and_cost_less():
    """A portion of words: the whole encoding takes less CPU than 1.8 forward filters by rows (2.3 before, 1.3 now)."""
    v, rng = ps.vocabulary(PIECES), random.Random(5)
    words = ["".join(rng.choices("etaoinshrdlu", k=rng.randint(1, 12))) for _ in range(30_000)] + ["th" * 40, "ab\u0000c"]
    text = " ".join(words)
    points = np.array([ord(c) for c in " " + text], np.uint32)
    begin = np.flatnonzero(points == 32)
    within = np.arange(len(points)) - np.repeat(begin, np.diff(np.append(begin, len(points))))
    edges = ps._edges(v, points, within)
    cut = np.flatnonzero(ps._spans(edges, within))
    size = np.diff(np.append(cut, len(points)))
    order = np.argsort(-size, kind="stable")
    cut, size = cut[order], size[order]
    nodes, sums, at = ps._lattice(v, edges, cut, size)
    rows = np.ascontiguousarray(edges)
    want = by_rows(v, rows, cut, size)
    for t in range(int(size[0])):
        k, c = int((size > t).sum()), min(t + 1, v.longest)
        assert (sums[:c, at[t] : at[t] + k] == want[cut[:k] + t, :c].T).all()
        assert (nodes[:c, at[t] : at[t] + k] == rows[cut[:k] + t, :c].T).all()

    def cpu(work):
        times = []
        for _ in range(5):
            begun = time.process_time()
            work()
            times.append(time.process_time() - begun)
        return min(times)

    assert cpu(lambda: ps.encode_texts(v, [text], seeds(1))) < 1.8 * cpu(lambda: by_rows(v, rows, cut, size))
