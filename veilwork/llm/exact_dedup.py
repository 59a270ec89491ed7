"""Grace hash de-duplication over complete contents.

1. Every map task combines its own rows in an open-addressing table, so a text that fills a third of the
   rows leaves the task once per table, with the ids of its copies.  These records are written as a table.
2. Records are dealt to buckets by eight bytes of a digest.  A bucket's task puts them into an open-addressing
   table that compares complete contents.  When the table is full, contents that it does not hold are written
   to the spill table of the level; the next level deals the spilled records by the next bytes of the digest,
   into as many buckets as their bytes need.  The levels end when nothing is spilled.
3. Classes are narrow (record, class) rows from here on: sizes and the largest id are aggregated per class and
   joined back by record, so no join key is as frequent as a text.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilwork.llm.store import Workspace
from veilwork.llm.text import LOWER, portions

RECORD = "rec long, digest binary, ids array<long>, n long, top long, text binary"
LEVEL = "rec long, class long, digest binary, text binary"


class ContentTable:
    """Linear probing over a power-of-two array of entry numbers; an entry is equal only if all bytes are."""

    def __init__(self, most_bytes: int):
        self.most_bytes = most_bytes
        self.clear()

    def clear(self) -> None:
        self.slots = np.full(1024, -1, np.int64)
        self.contents: list[bytes] = []
        self.hashes: list[int] = []
        self.bytes = 0

    def _grow(self) -> None:
        self.slots = np.full(2 * len(self.slots), -1, np.int64)
        mask = len(self.slots) - 1
        for entry, h in enumerate(self.hashes):
            at = h & mask
            while self.slots[at] >= 0:
                at = (at + 1) & mask
            self.slots[at] = entry

    def entry(self, h: int, content: bytes) -> int:
        """The entry of ``content``: put in when new, -1 when new and the table is full."""
        mask = len(self.slots) - 1
        at = h & mask
        while (e := self.slots[at]) >= 0:
            if self.hashes[e] == h and self.contents[e] == content:
                return int(e)
            at = (at + 1) & mask
        if self.contents and self.bytes + len(content) > self.most_bytes:
            return -1
        self.slots[at] = e = len(self.contents)
        self.contents.append(content)
        self.hashes.append(h)
        self.bytes += len(content) + 64
        if 2 * len(self.contents) > len(self.slots):
            self._grow()
        return e


def _part(digest: bytes, level: int) -> int:
    """Eight fresh bytes for each level; past the digest's end, of a digest of the digest."""
    while level >= 4:
        digest, level = hashlib.sha256(digest).digest(), level - 4
    return int.from_bytes(digest[8 * level : 8 * level + 8], "little")


def _combine(most_bytes: int, most_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, made = TaskContext.get().partitionId() << 40, 0
        table, digests, ids, held = ContentTable(most_bytes), [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal made, held
            begin = 0
            while begin < len(digests):
                end, size = begin, 0
                while end < len(digests) and (end == begin or size + len(table.contents[end]) < 16 << 20):
                    size += len(table.contents[end])
                    end += 1
                own = [sorted(x, key=lambda v: (v is not None, v)) for x in ids[begin:end]]
                yield pa.record_batch(
                    [
                        pa.array(range(base + made, base + made + end - begin), pa.int64()),
                        pa.array(digests[begin:end], pa.binary()),
                        pa.array(own, pa.list_(pa.int64())),
                        pa.array([len(x) for x in own], pa.int64()),
                        pa.array([x[-1] for x in own], pa.int64()),
                        pa.array(table.contents[begin:end], pa.binary()),
                    ],
                    names=["rec", "digest", "ids", "n", "top", "text"],
                )
                made += end - begin
                begin = end
            table.clear()
            digests.clear()
            ids.clear()
            held = 0

        for batch in batches:
            for rows, texts in portions(batch, "text"):
                for doc, text in zip(rows.column(0).to_pylist(), texts, strict=True):
                    content = text.translate(LOWER)
                    digest = hashlib.sha256(content).digest()
                    h = _part(digest, 0)
                    e = table.entry(h, content) if held < most_ids else -1
                    if e < 0:
                        yield from flush()
                        e = table.entry(h, content)
                    if e == len(digests):
                        digests.append(digest)
                        ids.append([])
                    ids[e].append(doc)
                    held += 1
        yield from flush()

    return run


def _resolve(level: int, most_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, first = ContentTable(most_bytes), []
        for batch in batches:
            for rows, texts in portions(batch, "text"):
                recs, digests = rows.column(0).to_pylist(), rows.column(1).to_pylist()
                classes = []
                for rec, digest, text in zip(recs, digests, texts, strict=True):
                    e = table.entry(_part(digest, level), text)
                    if e == len(first):
                        first.append(rec)
                    classes.append(first[e] if e >= 0 else None)
                spilled = [c is None for c in classes]
                yield pa.record_batch(
                    [
                        pa.array(recs, pa.int64()),
                        pa.array(classes, pa.int64()),
                        pa.array([d if s else None for d, s in zip(digests, spilled, strict=True)], pa.binary()),
                        pa.array([t if s else None for t, s in zip(texts, spilled, strict=True)], pa.binary()),
                    ],
                    names=["rec", "class", "digest", "text"],
                )

    return run


def grace_dedup(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    bucket_bytes: int = 64 << 20,
    table_bytes: int = 192 << 20,
    combine_bytes: int = 96 << 20,
    combine_ids: int = 1 << 17,
) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical after lower-casing A-Z; null counts as empty.  Of equal texts the row with the
    largest id stays.  Null ids sort below all others; of rows with equal text and equal id exactly one is ``kept``
    (they are told apart only by that flag).  An empty table gives no rows; other columns are not read.
    ``bucket_bytes`` sets the number of buckets, ``table_bytes`` what a table may hold before it spills.
    """
    space = Workspace(docs.sparkSession, "grace")
    narrow = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))
    records = space.save(narrow.mapInArrow(_combine(combine_bytes, combine_ids), RECORD), "records")
    left, level, found = records.select("rec", "digest", "text"), 0, None
    while True:
        size = left.agg(F.sum(F.length("text") + F.lit(64))).first()[0]
        if size is None:
            break
        buckets = max(1, math.ceil(size / bucket_bytes))
        dealt = left.repartition(buckets, F.xxhash64(F.lit(level), "digest"))
        done = space.save(dealt.mapInArrow(_resolve(level, table_bytes), LEVEL), f"level{level}")
        resolved = done.where(F.col("class").isNotNull()).select("rec", "class")
        found = resolved if found is None else found.unionByName(resolved)
        left, level = done.where(F.col("class").isNull()).select("rec", "digest", "text"), level + 1
    if found is None:
        found = left.select("rec", F.col("rec").alias("class"))
    classes = found.join(records.select("rec", "n", "top"), "rec")
    whole = classes.groupBy("class").agg(
        F.max("top").alias("keep_id"), F.sum("n").alias("group_size"), F.max_by("rec", F.struct("top", "rec")).alias("best")
    )
    marked = space.save(found.join(whole, "class"), "marked")
    narrow = space.save(records.select("rec", "digest", "ids"), "narrow")
    for spent in ("records", *[f"level{k}" for k in range(level)]):  # the texts
        space.drop(spent)
    rows = narrow.join(marked, "rec")
    return rows.select("*", F.posexplode("ids").alias("at", "id")).select(
        F.col("id").alias("doc_id"),
        "keep_id",
        "group_size",
        ((F.col("rec") == F.col("best")) & (F.col("at") == F.size("ids") - 1)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def keep_one(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, all columns.  Of rows with equal id and equal text, the least row stays."""
    verdicts = grace_dedup(docs, id_column, text_column)
    own = F.struct(F.col(id_column).cast("long").alias("id"), _digest(text_column).alias("sha"))
    tagged = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), own.alias("key"))
    lost = verdicts.where("not kept")
    again = lost.where(F.col("doc_id").eqNullSafe(F.col("keep_id")))
    gone = lost.where(~F.col("doc_id").eqNullSafe(F.col("keep_id"))).select(
        F.struct(F.col("doc_id").alias("id"), F.col("text_sha256").alias("sha")).alias("key")
    )
    rest = tagged.join(gone.distinct(), "key", "left_anti")
    if not again.isEmpty():
        rest = rest.groupBy("key").agg(F.min("row").alias("row"))
    return rest.select("row.*")


def _digest(text_column: str):
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    return F.sha2(F.translate(text, letters, letters.lower()), 256)
