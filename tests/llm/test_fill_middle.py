import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from veilwork.llm.fill_middle import PLAIN, PSM, SPM, arrange, fill_middle, restore, restore_texts, reverse, rotate, unit_ends

UNITS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute(doc_id, text):
    text = text or ""
    units = UNITS.findall(text)
    n = len(units)
    key = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(key[i : i + 8], 16) for i in (0, 8, 16, 24))
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 50:
        return (doc_id, n, PLAIN, None, None, text, text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    form = SPM if h4 % 100 < 80 else PSM
    out = f"<S>{s}<P>{p}<M>{m}" if form == SPM else f"<P>{p}<S>{s}<M>{m}"
    return (doc_id, n, form, len(p), len(m), out, text)


TEXTS = [None, "", " ", "\t\n\x0b", "a", " a b  c ", "é ü\x0bñ x 漢字  ", "has <P> in it", "<S>", "near < P> <S <M", "x" * 300_000]
DOCS = [(i, TEXTS[i % len(TEXTS)]) for i in range(120)] + [(i, f"  w{i} zwei\ndrei {'vier ' * (i % 7)}") for i in range(200)]
DOCS += [(None, "no id here"), (None, None), (7, "again"), (7, "again"), (-5, "b c"), (9, "long word " * 40_000)]


def test_brute_force(spark, rows):
    """Nulls, empty and long texts, white space of every kind, texts with sentinels, repeated rows."""
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").repartition(5)
    got = rows(restore_texts(fill_middle(docs)))
    assert got == sorted((brute(*d) for d in DOCS), key=repr)
    assert {r[2] for r in got} == {PLAIN, PSM, SPM}


def test_extra_columns_and_empty(spark):
    docs = spark.createDataFrame([(1, "a b", "f", "o")], "id long, body string, form string, output string")
    assert fill_middle(docs, id_column="id", text_column="body").count() == 1
    assert restore_texts(fill_middle(spark.createDataFrame([], "doc_id long, text string"))).count() == 0


def test_no_shuffle(spark):
    made = restore_texts(fill_middle(spark.createDataFrame(DOCS, "doc_id long, text string")))
    assert "Exchange" not in made._jdf.queryExecution().toString()


@given(st.text("ab <>PSM\n\té漢", max_size=40), st.integers(0, 99), st.integers(0, 99), st.sampled_from([PSM, SPM]))
@settings(max_examples=200, deadline=None)
def test_round_trip(text, a, b, form):
    data = text.encode()
    if any(s in text for s in ("<P>", "<S>", "<M>")):
        return
    ends = [0, *unit_ends(data)]
    first, second = sorted((int(ends[a % len(ends)]), int(ends[b % len(ends)])))
    assert restore(bytes(arrange(data, first, second, form)), form) == data


@pytest.mark.parametrize("sizes", [(0, 5), (5, 0), (3, 4), (70_000, 200_001), (131_072, 1)])
def test_rotation_in_place(sizes):
    left, right = bytes(i % 251 for i in range(sizes[0])), bytes(i % 241 for i in range(sizes[1]))
    buffer = bytearray(b"keep" + left + right)
    rotate(buffer, 4, 4 + len(left), len(buffer))
    assert bytes(buffer) == b"keep" + right + left


def test_reverse_uses_bounded_pieces():
    import numpy as np

    data = np.arange(1_000_003)
    reverse(data, 0, len(data))
    assert (data == np.arange(1_000_003)[::-1]).all()
