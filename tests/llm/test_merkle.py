import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from veilwork.llm import merkle
from veilwork.llm.store import Workspace

A_TO_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def levels_of(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + 8])) for i in range(0, len(levels[-1]), 8)])
    return levels


def path_of(levels, at):
    path = []
    for nodes in levels[:-1]:
        run = at - at % 8
        path.append(("".join(nodes[run:at]), "".join(nodes[at + 1 : run + 8])))
        at //= 8
    return path


def brute(rows):
    """Per row: id, position, leaf, subroot, root, proof, folded root, verified."""
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append(row)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for own in groups.values():
        own.sort(key=lambda r: (r[0] if r[0] is not None else merkle.LEAST, leaf_of(r)))
    trees = {g: levels_of([leaf_of(r) for r in own]) for g, own in groups.items()}
    top = levels_of([trees[g][-1][0] for g in order])
    out = []
    for place, g in enumerate(order):
        for at, row in enumerate(groups[g]):
            path = path_of(trees[g], at) + path_of(top, place)
            other = row
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0 and row[4] is not None:
                other = (*row[:4], row[4].translate(A_TO_Z))
            folded = leaf_of(other)
            for left, right in path:
                folded = sha(left + folded + right)
            proof = sha("".join(a + b for a, b in path))
            out.append((row[0], at, leaf_of(row), trees[g][-1][0], top[-1][0], proof, folded, folded == top[-1][0]))
    return sorted(out, key=repr)


def table(kind):
    if kind == "one":
        return [(5, "s", "en", 1, "A")]
    if kind == "ties":
        same = [(7, "s", "en", 3, "Same")] * 700 + [(7, "s", "en", 3, f"text {i}") for i in range(30)]
        return same + [(None, None, None, None, None)] * 3 + [(i, "s", "en", 1, "x") for i in range(20)]
    if kind == "sparse":
        ids = [merkle.LEAST, -1, 0, 1, (1 << 63) - 1, 1 << 40, -(1 << 40), *[i * 977_777_777_777 for i in range(-40, 40)]]
        return [(i, "s", f"l{k % 3}", k, f"Text {k}") for k, i in enumerate(ids)]
    if kind == "groups":
        return [(i, "s", f"lang {i % 613}", i, "É" * (i % 3)) for i in range(1300)] + [(9_999, "", "", 0, "")]
    rows = [(i * 3, f"src{i % 5}", ["en", "de", None, "é"][(i * i) % 4], i, f"Some TEXT {i}") for i in range(1200)]
    return rows + [(100_000 + i, "s", "en", i, "y") for i in range(4200)] + [(-4, None, "en", None, "z" * 200_000)]


@pytest.mark.parametrize("kind", ["one", "ties", "sparse", "groups", "deep"])
def test_brute_force(spark, rows, kind):
    """One leaf; repeated ids, rows and nulls; ids of any spread; more groups than a block; a tree of two steps."""
    made = table(kind)
    docs = spark.createDataFrame(made, SCHEMA).repartition(3)
    tampered = merkle.lowered_where(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 0)
    assert rows(merkle.manifest(docs, tampered)) == brute(made)


def test_empty(spark):
    assert merkle.manifest(spark.createDataFrame([], SCHEMA)).count() == 0


def test_clashing_columns_are_not_read(spark, rows):
    made = table("sparse")
    docs = spark.createDataFrame(made, SCHEMA)
    for c in ("id", "leaf", "n", "block", "group", "total", "at", "path", "root", "_word"):
        docs = docs.withColumn(c, F.lit("clash"))
    assert [r[:3] for r in rows(merkle.manifest(docs))] == [r[:3] for r in brute(made)]
    assert {r.verified for r in merkle.manifest(docs).collect()} == {True}


def test_ranks_are_counts_of_smaller_keys(spark, rows):
    keys = [(g, k, 1 + (k % 4)) for g in ("a", "b") for k in {*range(-70, 300), 1 << 50, -(1 << 60), merkle.LEAST}]
    got = rows(merkle.ranks(spark.createDataFrame(keys, "g string, k long, c long"), ["g"], "k", "c", "before", "total"))
    want = [(g, k, sum(c for h, j, c in keys if h == g and j < k), sum(c for h, _, c in keys if h == g)) for g, k, _ in keys]
    assert got == sorted(want, key=repr)


def test_no_python_workers_and_bounded_blocks(spark):
    docs = spark.createDataFrame(table("deep"), SCHEMA)
    known = len(Workspace.opened)
    plan = merkle.manifest(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    steps = spark.read.parquet(Workspace.opened[known].path("tree-0"))
    assert steps.agg(F.max(F.size("l0"))).first()[0] == merkle.BLOCK
