import hashlib
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from veilwork.functions import permutation
from veilwork.operators import masking as M


def masks(spark, values, key="k", domain="d"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.m for r in df.select("i", M.permuted(F.col("v"), key, domain).alias("m")).orderBy("i").collect()]


def shape(v):
    return re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub("[0-9]", "0", v)))


@pytest.mark.parametrize("values", [[str(i) for i in range(10)], [f"{i:02d}" for i in range(100)], [f"{a}{b}" for a in "abcdefghijklmnopqrstuvwxyz" for b in range(10)], [f"{i:03d}" for i in range(1000)]])
def test_whole_domains_are_permuted(spark, values):
    got = masks(spark, values)
    assert sorted(got) == sorted(values) and (len(values) < 50 or got != values)


def test_shapes_stay_and_masks_differ(spark):
    rng = random.Random(1)
    values = list({"".join(rng.choice("aZ9-_. ") if rng.random() < 0.5 else rng.choice("bcXY01234") for _ in range(rng.randrange(0, 26))) for _ in range(2000)})
    got = masks(spark, values)
    assert [shape(v) for v in got] == [shape(v) for v in values] and len(set(got)) == len(values)
    assert masks(spark, values, key="other") != got and masks(spark, values, domain="e") != got


def test_other_alphabets_and_long_values_become_hashes(spark):
    values = ["é", "É1", "٣", "a" * 27, "7" * 40, "-" * 50, "", None, "9" * 26, "z" * 26]
    got = masks(spark, values)
    assert all(re.fullmatch("[0-9a-f]{64}", g) for g in got[:5]) and len(set(got[:5])) == 5
    assert got[5:8] == ["-" * 50, "", None] and re.fullmatch("[0-9]{26}", got[8]) and re.fullmatch("[a-z]{26}", got[9])


def test_a_million_keys_have_a_million_masks(spark):
    keys = spark.range(1_000_000).repartition(8).select(F.format_string("K%07d", "id").alias("v"))
    assert keys.select(M.permuted(F.col("v"), "k", "d").alias("m")).agg(F.count_distinct("m")).first()[0] == 1_000_000


def plain_permutation(v, key, domain):
    """The same permutation on whole numbers, one value at a time."""
    symbols = [(10, ord(c) - 48, 48) if c.isdigit() else (26, ord(c.lower()) - 97, 97 if c.islower() else 65) for c in v if c.isalnum()]
    cut = -(-len(symbols) // 2)
    halves, sizes = [], []
    for part in (symbols[:cut], symbols[cut:]):
        n, size = 0, 1
        for r, x, _ in part:
            n, size = n * r + x, size * r
        halves.append(n)
        sizes.append(size)
    (a, b), (ra, rb), form = halves, sizes, shape(v)
    for turn in range(1, M.ROUNDS + 1):
        text = f"{len(key)}:{key}{len(domain)}:{domain}{len(form)}:{form}{turn}:{b}"
        a, b, ra, rb = b, (a + int(hashlib.sha256(text.encode()).hexdigest()[:15], 16)) % ra, rb, ra
    out = []
    for n, part in ((a, symbols[:cut]), (b, symbols[cut:])):
        digits = []
        for r, _, first in reversed(part):
            n, x = divmod(n, r)
            digits.append(chr(first + x))
        out += reversed(digits)
    left = iter(out)
    return "".join(next(left) if c.isalnum() else c for c in v)


def test_equals_whole_number_arithmetic(spark):
    """Halves up to 26**13 lose no digit."""
    rng = random.Random(9)
    values = ["".join(rng.choice("zyxZYX987-/ ") for _ in range(rng.randrange(1, 30))) for _ in range(500)] + ["z" * 26, "Z" * 25, "9" * 26]
    values = [v for v in values if sum(c.isalnum() for c in v) <= M.MOST_SYMBOLS]
    assert masks(spark, values, "key", "dom") == [plain_permutation(v, "key", "dom") for v in values]


def test_batches_and_the_expression_mask_alike(spark, monkeypatch):
    """Shapes that many values have and shapes of one value, in a batch and as an expression."""
    rng = random.Random(10)
    values = [f"L-{rng.randrange(10**6, 10**7)}/{i % 7}" for i in range(300)] + [f"{i}" for i in range(300)] + ["zZ9" * 8 + "aB"] * 5 + ["--"] * 5 + [""] * 5 + [None] * 5
    values += ["".join(rng.choice("zyX98-/ \u00a7") for _ in range(rng.randrange(1, 9))) for _ in range(200)] + ["\u00e9t\u00e9 1"] * 5 + ["7" * 30] * 5
    assert [v for v, m in zip(values[:600], masks(spark, values, "key", "dom"), strict=False) if m != plain_permutation(v, "key", "dom")] == []
    batch = masks(spark, values, "key", "dom")
    monkeypatch.setattr(permutation, "permute", None)
    monkeypatch.setattr(M.F, "arrow_udf", lambda kind: lambda f: lambda value: M.F.lit(None).cast("string"))
    assert masks(spark, values, "key", "dom") == batch


def test_hashes_of_halves_are_kept(monkeypatch):
    """20,000 keys of one shape take few hashes: a half has a hundred values."""
    made, hashes = [], permutation._hashes
    monkeypatch.setattr(permutation, "_tables", {})
    monkeypatch.setattr(permutation, "_hashes", lambda prefix, halves: made.append(len(halves)) or hashes(prefix, halves))
    keys = [f"{i % 10**4:04d}" for i in range(20_000)]
    out = permutation.permute(pa.array(keys), b"1:k1:d", M.ROUNDS, M.MOST_SYMBOLS).to_pylist()
    assert len(set(out)) == 10**4 and sum(made) <= 8 * 100 and out[:100] == [plain_permutation(k, "k", "d") for k in keys[:100]]
    monkeypatch.setattr(permutation, "_tables", {})
    monkeypatch.setattr(permutation, "MOST_KEPT", 150)
    sliced = pa.array([None, "x", *keys[:300]]).slice(1)
    assert permutation.permute(sliced, b"1:k1:d", M.ROUNDS, M.MOST_SYMBOLS).to_pylist() == [None, *out[:300]]
    assert sum(map(len, permutation._tables.values())) <= 150
