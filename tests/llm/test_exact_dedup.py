import hashlib

import pytest

from veilwork.llm.exact_dedup import ContentTable, grace_dedup, keep_one

A_TO_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs):
    groups = {}
    for doc_id, text in docs:
        groups.setdefault((text or "").translate(A_TO_Z), []).append(doc_id)
    out = []
    for text, ids in groups.items():
        ids.sort(key=lambda v: (v is not None, v))
        sha = hashlib.sha256(text.encode()).hexdigest()
        out += [(i, ids[-1], len(ids), at == len(ids) - 1, sha) for at, i in enumerate(ids)]
    return sorted(out, key=repr)


DOCS = (
    [(i, "Same TEXT") for i in range(40)]
    + [(100 + i, f"text number {i % 25}") for i in range(60)]
    + [(None, "same text"), (None, None), (None, ""), (7, "É"), (8, "é"), (9, "x" * 200_000), (10, "X" * 200_000)]
    + [(500, "again"), (500, "again"), (500, "other")]
)


@pytest.mark.parametrize(
    "limits", [{}, {"bucket_bytes": 40_000, "table_bytes": 200}, {"table_bytes": 1, "combine_bytes": 1, "combine_ids": 3}]
)
def test_brute_force(spark, rows, limits):
    """Production limits, limits that spill over several levels, and tables of one content."""
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").repartition(3)
    assert rows(grace_dedup(docs, **limits)) == brute(DOCS)


def test_empty(spark):
    assert grace_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_keep_one_keeps_columns(spark, rows):
    docs = spark.createDataFrame(
        [(1, "a", "x"), (2, "A", "y"), (3, "b", None), (3, "B", "z"), (None, "c", "n")], "doc_id long, text string, rec string"
    )
    got = keep_one(docs)
    assert got.columns == docs.columns
    assert rows(got) == sorted([(2, "A", "y"), (3, "B", "z"), (None, "c", "n")], key=repr)


def test_table_compares_contents():
    table = ContentTable(1 << 20)
    assert [table.entry(5, b"a"), table.entry(5, b"b"), table.entry(5, b"a"), table.entry(6, b"c")] == [0, 1, 0, 2]
    assert [table.entry(h, b"%d" % h) for h in range(3000)] == [table.entry(h, b"%d" % h) for h in range(3000)]
