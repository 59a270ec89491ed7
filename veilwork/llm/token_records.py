"""Token ids in length-delimited binary records, with an offset index per file.

A record file is a run of records; each is

    8 bytes  length of the payload, little-endian
    4 bytes  masked checksum of the length
    n bytes  payload: 1 flag byte (1: null id, 2: ids of four bytes), 8 bytes id, then the token ids (2 or 4 bytes each)
    4 bytes  masked checksum of the payload

The checksum is crc32, rotated right by 15 bits, plus a constant, so that a checksum of data that holds checksums
stays useful.  The index file has 24 bytes per record: offset in the file, number of tokens, and tokens before it in
the file, so any record is read with one seek.  Files hold ranges of ids in ascending order.  A task writes under
a name of its own attempt; the manifest, a table, names the files that count, so a lost attempt leaves nothing visible.

Words (between ASCII white space) are encoded once by the tokenizers library, kept by hash in a bounded cache, and
put together again: its pre-tokenizer never joins text over white space.
"""

from __future__ import annotations

import math
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilwork.llm.store import Workspace
from veilwork.llm.text import portions, word_places

MANIFEST = "part int, path string, records long, tokens long, bytes long"
READ = "doc_id long, start long, n_tokens long, ids_crc32 long"
NULL_ID, WIDE = 1, 2


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class WordCache:
    """Ids of the words seen so far, by the words' hashes; it starts anew when it holds ``most`` words."""

    def __init__(self, path: str, most: int = 1 << 20):
        self.tokenizer, self.most = _tokenizer(path), most
        self.clear()

    def clear(self) -> None:
        self.hashes, self.at = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.first, self.counts, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _encode(self, texts: list[str]) -> list[list[int]]:
        """A word of ASCII letters is one unit of the pre-tokenizer and goes to the library's model as it is."""
        model = self.tokenizer.model
        own = [[t.id for t in model.tokenize(w.lower())] if w.isascii() and w.isalpha() else None for w in texts]
        rest = [i for i, ids in enumerate(own) if ids is None]
        for i, e in zip(rest, self.tokenizer.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False), strict=True):
            own[i] = e.ids
        return own

    def entries(self, hashes: np.ndarray, text_of) -> np.ndarray:
        """Entry numbers of sorted distinct hashes; ``text_of(places)`` gives the words at places of ``hashes``."""
        if len(self.hashes) > self.most:
            self.clear()
        place = np.searchsorted(self.hashes, hashes)
        known = np.zeros(len(hashes), bool)
        inside = place < len(self.hashes)
        known[inside] = self.hashes[place[inside]] == hashes[inside]
        new = np.flatnonzero(~known)
        if len(new):
            own = self._encode(text_of(new))
            counts = np.fromiter(map(len, own), np.int64, len(own))
            flat = np.fromiter((i for ids in own for i in ids), np.uint32, int(counts.sum()))
            numbers = len(self.first) + np.arange(len(new))
            self.first = np.append(self.first, len(self.flat) + np.cumsum(counts) - counts)
            self.counts, self.flat = np.append(self.counts, counts), np.append(self.flat, flat)
            self.at = np.insert(self.at, place[new], numbers)
            self.hashes = np.insert(self.hashes, place[new], hashes[new])
        return self.at[np.searchsorted(self.hashes, hashes)]


@lru_cache(maxsize=2)
def _cache(path: str) -> WordCache:
    return WordCache(path)


def encode_texts(path: str, texts: list[bytes], end: int) -> list[np.ndarray]:
    """Ids of every text with ``end`` behind them."""
    buffer = b" ".join(texts) + b" "
    hashes, starts, sizes = word_places(buffer)
    bounds = np.concatenate(([0], np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))))
    at = np.searchsorted(starts, bounds)
    distinct, example, kind = np.unique(hashes, return_index=True, return_inverse=True)
    spots = list(zip(starts[example].tolist(), sizes[example].tolist(), strict=True))
    cache = _cache(path)
    entry = cache.entries(distinct, lambda new: [buffer[x : x + n].decode() for x, n in map(spots.__getitem__, new.tolist())])
    flat, first, counts = cache.flat, cache.first[entry], cache.counts[entry]
    per_word = counts[kind]
    before = np.cumsum(per_word) - per_word
    ids = flat[np.arange(int(per_word.sum())) - np.repeat(before - first[kind], per_word)]
    cuts = np.append(before, len(ids))[at[1:]]
    return np.split(np.insert(ids, cuts, np.uint32(end)), (cuts + np.arange(1, len(cuts) + 1))[:-1])


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(key: int | None, ids: np.ndarray) -> bytes:
    wide = len(ids) > 0 and int(ids.max()) > 0xFFFF
    flags = (NULL_ID if key is None else 0) | (WIDE if wide else 0)
    payload = struct.pack("<Bq", flags, key or 0) + ids.astype("<u4" if wide else "<u2").tobytes()
    length = struct.pack("<Q", len(payload))
    return length + struct.pack("<I", masked(length)) + payload + struct.pack("<I", masked(payload))


def unframe(stream) -> tuple[int | None, np.ndarray] | None:
    """The record at the stream's place, None at its end; a damaged one is an error."""
    head = stream.read(12)
    if not head:
        return None
    if len(head) < 12 or struct.unpack("<I", head[8:])[0] != masked(head[:8]):
        raise ValueError("damaged record length")
    size = struct.unpack("<Q", head[:8])[0]
    payload, check = stream.read(size), stream.read(4)
    if len(payload) < size or len(check) < 4 or struct.unpack("<I", check)[0] != masked(payload):
        raise ValueError("damaged record")
    flags, key = struct.unpack("<Bq", payload[:9])
    ids = np.frombuffer(payload[9:], "<u4" if flags & WIDE else "<u2").astype(np.uint32)
    return (None if flags & NULL_ID else key), ids


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:") :]
    return fs.FileSystem.from_uri(uri)


def _write(folder: str, path: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, records, tokens, offset = TaskContext.get().partitionId(), 0, 0, 0
        name = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}"
        system, base = _open(name)
        data = index = None
        for batch in batches:
            for rows, texts in portions(batch, "text", 4 << 20):
                if data is None:
                    data, index = system.open_output_stream(f"{base}.rec"), system.open_output_stream(f"{base}.idx")
                for key, ids in zip(rows.column(0).to_pylist(), encode_texts(path, texts, end), strict=True):
                    record = frame(key, ids)
                    data.write(record)
                    index.write(struct.pack("<QQQ", offset, len(ids), tokens))
                    records, tokens, offset = records + 1, tokens + len(ids), offset + len(record)
        if data is not None:
            data.close()
            index.close()
            yield pa.record_batch(
                [pa.array([x], t) for x, t in zip((part, name, records, tokens, offset), (pa.int32(), pa.string(), *[pa.int64()] * 3), strict=True)],
                names=["part", "path", "records", "tokens", "bytes"],
            )

    return run


def write_records(
    docs: DataFrame,
    tokenizer: str,
    id_column: str = "doc_id",
    text_column: str = "text",
    folder: str | None = None,
    end: int = 1,
    part_chars: int = 64 << 20,
) -> DataFrame:
    """Encode every text (null: empty), append ``end``, write records in ascending order of ids; gives the manifest.

    Null ids come first; rows with equal ids follow each other by a hash of the text.  ``folder`` is a URI that all
    executors reach, in the session's checkpoint folder by default.  An empty table gives an empty manifest.
    """
    space = Workspace(docs.sparkSession, "records")
    rows = docs.select(
        F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text")
    ).withColumn("tie", F.xxhash64("text"))
    total = rows.agg(F.sum(F.length("text") + F.lit(64))).first()[0] or 0
    dealt = rows.repartitionByRange(max(1, math.ceil(total / part_chars)), "id", "tie").sortWithinPartitions("id", "tie")
    files = dealt.drop("tie").mapInArrow(_write(folder or space.root, tokenizer, end), MANIFEST)
    return space.save(files, "manifest")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def batch(out: list) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    for rows in batches:
        for path, start in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True):
            system, base = _open(path)
            out = []
            with system.open_input_stream(f"{base}.rec") as stream:
                while (record := unframe(stream)) is not None:
                    key, ids = record
                    out.append((key, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    start += len(ids)
                    if len(out) == 10_000:
                        yield batch(out)
                        out = []
            if out:
                yield batch(out)


def read_records(manifest: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every record; ``start`` counts the ids of all records before it."""
    # One row per file; a window over them orders metadata only.
    before = F.sum("tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    files = manifest.select("part", "path", F.coalesce(before, F.lit(0)).alias("start"))
    return files.repartition(max(1, manifest.count()), "part").select("path", "start").mapInArrow(_read, READ)


def read_shuffled(manifest: DataFrame, seed: int) -> DataFrame:
    """``doc_id, ids`` of every record, files and the records of a file in an order drawn from ``seed``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for part, path in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True):
                system, base = _open(path)
                with system.open_input_stream(f"{base}.idx") as stream:
                    offsets = np.frombuffer(stream.read(), "<u8").reshape(-1, 3)[:, 0]
                with system.open_input_file(f"{base}.rec") as data:
                    for offset in np.random.default_rng([seed, part]).permutation(offsets):
                        data.seek(int(offset))
                        key, ids = unframe(data)
                        yield pa.record_batch([pa.array([key], pa.int64()), pa.array([ids.tolist()], pa.list_(pa.int64()))], names=["doc_id", "ids"])

    dealt = manifest.select("part", "path").repartition(max(1, manifest.count()), F.xxhash64(F.lit(seed), "part"))
    return dealt.mapInArrow(run, "doc_id long, ids array<long>")
