"""Fill-in-the-middle documents by block rotation in place, and their exact restoration.

A text is cut at two unit boundaries into prefix P, middle M and suffix S.  A unit is a word with the white space before
it; white space at the end of the text is a unit of its own.  White space is ASCII, so units are found in UTF-8 bytes.

The sentinels go into one bytearray in the order of the text, ``<P>P<M>M<S>S``.  Two neighbouring blocks of it are then
exchanged by three reversals, without a second buffer:

    psm  <P>P<S>S<M>M   exchanges <M>M with <S>S
    spm  <S>S<P>P<M>M   exchanges <P>P<M>M with <S>S

Restoring exchanges the same blocks back and takes the sentinels out.  A sentinel is unmistakable: the text holds none,
and a text next to one makes no other, since ``<`` only begins and ``>`` only ends a sentinel.

Everything happens row by row inside map tasks: no shuffle, and a lost task is repeated with the same result, since the
cuts depend on the seed and the id only.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilwork.llm.text import portions, word_places

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
SWAP = 1 << 16  # bytes that a reversal exchanges at a time
PLAIN, PSM, SPM = "plain", "psm", "spm"
MADE = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def reverse(data: np.ndarray, begin: int, end: int) -> None:
    """Reverse ``data[begin:end]`` in place, by exchanging pieces of at most ``SWAP`` bytes from both ends."""
    while end - begin > 1:
        size = min(SWAP, (end - begin) // 2)
        left = data[begin : begin + size][::-1].copy()
        data[begin : begin + size] = data[end - size : end][::-1]
        data[end - size : end] = left
        begin, end = begin + size, end - size


def rotate(buffer: bytearray, begin: int, between: int, end: int) -> None:
    """Exchange the neighbouring blocks ``[begin, between)`` and ``[between, end)`` by three reversals."""
    data = np.frombuffer(buffer, np.uint8)
    reverse(data, begin, between)
    reverse(data, between, end)
    reverse(data, begin, end)


def unit_ends(text: bytes) -> np.ndarray:
    """The byte behind every unit, in order."""
    _, starts, sizes = word_places(text)
    ends = starts + sizes
    return np.append(ends, len(text)) if len(text) and (not len(ends) or ends[-1] < len(text)) else ends


def arrange(text: bytes, first: int, second: int, form: str) -> bytearray:
    """``text`` with sentinels, cut behind ``first`` and ``second`` bytes, its blocks in the order of ``form``."""
    out = bytearray(text)
    out[second:second] = SUFFIX
    out[first:first] = MIDDLE
    out[:0] = PREFIX
    middle = first + len(PREFIX)
    suffix = second + len(PREFIX) + len(MIDDLE)
    rotate(out, middle if form == PSM else 0, suffix, len(out))
    return out


def restore(output: bytes, form: str) -> bytearray:
    """The text that ``arrange`` was given."""
    out = bytearray(output)
    if form == PLAIN:
        return out
    suffix = out.index(SUFFIX)
    rotate(out, suffix, out.index(MIDDLE if form == PSM else PREFIX), len(out))
    for sentinel in (SUFFIX, MIDDLE, PREFIX):
        at = out.index(sentinel)
        del out[at : at + len(sentinel)]
    return out


def _draws(seed: int, doc_id: int | None) -> list[int]:
    """The first four 32-bit words of the key's digest; a null id counts as no digits."""
    key = sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(key[i : i + 4], "big") for i in (0, 4, 8, 12)]


def _transform(seed: int, rate: int, spm_rate: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in portions(batch, "text"):
                made = []
                for doc, text in zip(rows.column(0).to_pylist(), texts, strict=True):
                    ends, (h1, h2, h3, h4) = unit_ends(text), _draws(seed, doc)
                    n = len(ends)
                    if not n or h3 % 100 >= rate or any(x in text for x in (PREFIX, SUFFIX, MIDDLE)):
                        made.append((doc, n, PLAIN, None, None, text))
                        continue
                    first, second = (int(ends[c - 1]) if c else 0 for c in sorted((h1 % (n + 1), h2 % (n + 1))))
                    form = SPM if h4 % 100 < spm_rate else PSM
                    chars = [len(str(text[a:b], "utf-8")) for a, b in ((0, first), (first, second))]
                    made.append((doc, n, form, *chars, bytes(arrange(text, first, second, form))))
                yield _batch(made, MADE_TYPES)

    return run


MADE_TYPES = {
    "doc_id": pa.int64(), "n": pa.int64(), "form": pa.string(), "prefix_chars": pa.int64(), "middle_chars": pa.int64(),
    "output": pa.binary(),
}


def _batch(made: list[tuple], types: dict[str, pa.DataType]) -> pa.RecordBatch:
    columns = zip(*made, strict=True) if made else [[] for _ in types]
    arrays = [pa.array(x, t) for x, t in zip(columns, types.values(), strict=True)]
    return pa.record_batch([a.cast(pa.string()) if a.type == pa.binary() else a for a in arrays], names=list(types))


def fill_middle(
    docs: DataFrame, seed: int = 42, rate: int = 50, spm_rate: int = 80, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """One row per input row: ``doc_id, n, form, prefix_chars, middle_chars, output``.

    ``n`` counts units; ``rate`` in 100 texts are cut, ``spm_rate`` in 100 of these in the order spm.  The draws are words of
    sha256 of ``seed:doc_id``, so a row's result depends on its id and text only.  Null text counts as empty; an empty
    text, and one that holds a sentinel, stays plain, with null ``prefix_chars`` and ``middle_chars``.  A null id draws
    as no digits.  Equal rows get equal results; any length of text is cut as a whole; an empty table gives no rows;
    other columns are not read.
    """
    narrow = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return narrow.mapInArrow(_transform(seed, rate, spm_rate), MADE)


def _restored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, outputs in portions(batch, "output"):
            forms = rows.column(rows.schema.get_field_index("form")).to_pylist()
            texts = [bytes(restore(x, form)) for x, form in zip(outputs, forms, strict=True)]
            yield rows.append_column("restored", pa.array(texts, pa.binary()).cast(pa.string()))


def restore_texts(made: DataFrame) -> DataFrame:
    """``made`` of ``fill_middle`` with the column ``restored``, rebuilt from ``output`` and ``form`` alone."""
    return made.mapInArrow(_restored, f"{MADE}, restored string")
