import itertools
import random
import tracemalloc
import zlib
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from veilwork.llm import language_id as li
from veilwork.llm.queries import QUERIES

ROOT = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{ROOT}/documents.parquet").select("doc_id", "lang")
    got = QUERIES["op3_language_id"](spark, ROOT).join(docs, "doc_id").toPandas()
    assert len(got) == docs.count()
    assert (got["held_out"] == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got["doc_id"]]).all()
    held = got[got["held_out"]]
    assert (held["lang"] == held["lang_pred"]).mean() > 0.98
    assert got["score"].between(0, 1).all()


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(0)
    sizes = [0, 1, 5, 3, 0, 6]
    at = np.concatenate(([0], np.cumsum(sizes)))
    scores = rng.normal(size=(at[-1], 3)) * 4

    def total(part, path):
        return sum(part[t, p] for t, p in enumerate(path)) - 3.0 * sum(a != b for a, b in itertools.pairwise(path))

    labels = li.viterbi(scores, at, 3.0)
    for a, b in itertools.pairwise(at):
        part = scores[a:b]
        best = max((total(part, p) for p in itertools.product(range(3), repeat=b - a)), default=0)
        assert np.isclose(best, total(part, labels[a:b]))


def test_mixed_scripts_and_edge_cases(spark):
    train = [(i, t, lang) for i, (t, lang) in enumerate([("the cat and the dog", "en"), ("der hund und die katze", "de"), ("кошка и собака", "ru")] * 20)]
    docs = train + [
        (900, "the dog and the cat кошка и собака кошка и собака кошка", None), (901, None, "en"), (902, "", "de"), (903, "123 !?", "ru"),
        (None, "the cat", "en"), (904, "the cat " * 30_000, None), (905, "the cat", None), (905, "the cat", None), (906, "東京", None),
    ]
    frame = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, lang string, spans string")
    got = {}
    for r in li.identify(frame).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert sum(map(len, got.values())) == len(docs)
    assert [(s.lang, s.start, s.end) for s in got[900][0].spans] == [("en", 0, 19), ("ru", 20, 55)]
    assert got[900][0].lang_pred == "ru" and 0.5 < got[900][0].score < 0.8
    assert all(got[i][0].lang_pred == "und" and got[i][0].score == 0 for i in (901, 902, 903))
    assert got[904][0].lang_pred == got[905][1].lang_pred == got[None][0].lang_pred == "en" and got[906][0].lang_pred != "und"
    kept = li.keep_identified(frame)
    assert kept.columns == frame.columns
    assert kept.where("doc_id IN (901, 902, 903)").count() == 0 and kept.count() == len(docs) - 3


def test_nothing_learned(spark):
    frame = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.score) for r in li.identify(frame).collect()] == [("und", 0.0)]
    assert li.identify(frame.where("false")).count() == 0
    assert spark.range(3).select(li.remainder("id", 3).alias("r")).where(F.col("r").isNull()).count() == 0


def test_tasks_hold_little_more_than_a_portion():
    """Peaks of a task's own arrays over 2 MB of text: an executor's workers share what the JVM leaves."""
    rng = random.Random(3)
    texts = ["".join(rng.choices("abcdefghij ", k=3_000)) for _ in range(700)]
    n = 4
    logs = np.random.default_rng(3).normal(size=(li.FEATURES, n)).astype(np.float32)
    barred = np.zeros((len(li.SCRIPT_NAMES), n), np.float32)
    model = SimpleNamespace(value={"langs": list("abcd"), "logs": logs, "barred": barred})
    labelled = pa.record_batch([pa.array(["ab"[i % 2] for i in range(700)]), pa.array(texts)], names=["lang", "text"])
    rows = pa.record_batch([pa.array(range(700), pa.int64()), pa.array(texts)], names=["id", "text"])
    li._letters(), li._lowered()
    for task, batch in ((li._count, labelled), (li._predict(model, 12.0), rows)):
        tracemalloc.start()
        made = sum(out.num_rows for out in task(iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert made and peak < 40e6


def test_parts_of_a_portion_change_nothing(monkeypatch):
    rng = random.Random(3)
    texts = ["", "één 日本", *("".join(rng.choices("abcé日ж .", k=rng.randint(0, 90))) for _ in range(60)), " "]
    rows = pa.record_batch([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["id", "text"])
    logs = np.random.default_rng(3).normal(size=(li.FEATURES, 4)).astype(np.float32)
    model = SimpleNamespace(value={"langs": list("abcd"), "logs": logs, "barred": np.zeros((len(li.SCRIPT_NAMES), 4), np.float32)})
    (whole,) = li._predict(model, 1.0)(iter([rows]))
    for part in (1, 50, 300):
        monkeypatch.setattr(li, "PORTION", part)
        (got,) = li._predict(model, 1.0)(iter([rows]))
        assert got.equals(whole)
