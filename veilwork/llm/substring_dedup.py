"""Removal of word windows that also start in a document with a smaller id, by level-wise doubling.

A window is ``window`` consecutive words of one document.  Windows repeated at one length alone are extended to twice
that length, until no candidates survive:

* Level 0 has windows of half the length.  Of the seeds inside a longer window only the least by hash is asked for, so
  equal longer windows ask for equal seeds and about two in 27 places are sent.
* Level 1 has the windows of the asked length whose seed occurs in two documents.  What a document loses is decided here.
* Level k + 1 has the windows of twice the length of level k both of whose halves occur in two documents.  These levels
  tell how long a document's repeats are; their candidates become few fast.

**Where the work is.**  The texts are written once, in parts of a few MB, as a table bucketed by part; no later step
shuffles them.  A part asks, once per distinct window, which windows other documents have: its hashes go to buckets of the
hash range, sorted, with the least id.  A bucket answers with two bits per window: it occurs in two documents; it
occurs under a smaller id.  Answers go back by part, where the windows are hashed again.  A window that a third of all
documents hold is one entry of each part, so there is no hot key, and no pairs are formed.

Windows are told apart by 96 bits: a 64-bit hash of both halves' 64-bit hashes, and 32 other bits of them.  Seeds have
56 bits (fewer for windows of over 511 words); two seeds taken for one cost time only.  Every step reads and leaves tables in the shared folder.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilwork.llm.store import Workspace
from veilwork.llm.text import word_places

PARTS = "part long, seq int, bytes long, doc_id long, text string"
ASKED = "part long, level int, bucket int, n long, payload binary"
ANSWER = "part long, level int, bucket int, n long, repeated long, both binary, smaller binary"
KEPT = "doc_id long, n_words long, n_removed long, longest long, kept string"
LEAST = -(1 << 63)
STATE = -1  # the bucket number of a part's own notes, which buckets hand back as they are
_A, _B, _C, _D = (np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xBF58476D1CE4E5B9, 0x9E3779B97F4A7C15, 0x94D049BB133111EB))


def _join(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hashes of the runs made of a left and a right run."""
    out = left * _A
    out += right
    out ^= out >> np.uint64(29)
    out *= _B
    out ^= out >> np.uint64(32)
    return out


class Words:
    """The words of some texts, and hashes of their windows."""

    def __init__(self, texts: list[bytes], ids: np.ndarray):
        sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        self.hashes, starts, _ = word_places(b" ".join([*texts, b""]))
        self.first = np.searchsorted(starts, np.concatenate(([0], np.cumsum(sizes))))
        self.text = np.repeat(np.arange(len(texts)), np.diff(self.first))
        self.ids = ids[self.text]

    def runs(self, length: int) -> np.ndarray:
        """Hash of the run of ``length`` words at every place where one begins, over text ends too."""
        if length == 1:
            return self.hashes
        half = self.runs(length // 2)
        n = max(0, len(self.hashes) - length + 1)
        if length % 2 == 0:
            return _join(half[:n], half[length // 2 : length // 2 + n])
        return _join(_join(half[:n], half[length // 2 : length // 2 + n]), self.hashes[length - 1 : length - 1 + n])

    def inside(self, length: int) -> np.ndarray:
        """Where a window of ``length`` words of one text begins."""
        n = max(0, len(self.hashes) - length + 1)
        return self.text[:n] == self.text[length - 1 : length - 1 + n]


class Ladder:
    """Lengths of the levels, and hashes of their windows.  A window of level k + 1 is two of level k at ``step(k)``."""

    def __init__(self, window: int):
        self.window, self.seed = window, (window + 1) // 2

    def length(self, level: int) -> int:
        return self.seed if level == 0 else self.window << (level - 1)

    def step(self, level: int) -> int:
        return self.length(level + 1) - self.length(level)

    def hashes(self, words: Words, level: int) -> tuple[np.ndarray, np.ndarray]:
        """64 and 32 bits of every window of a level from 1 on."""
        low = words.runs(self.seed)
        for k in range(level):
            step = self.step(k)
            left, right = low[: max(0, len(low) - step)], low[step:]
            low = _join(left, right)
        high = ((left * _C) ^ (right + _D)) * _B
        return low, (high >> np.uint64(32)).astype(np.uint32)

    def seeds(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Windows of level 1, the place of each one's seed, and the seeds' hashes by place."""
        low = words.runs(self.seed).copy()
        places = np.flatnonzero(words.inside(self.window))
        have, want = 1, self.step(0) + 1
        last = np.uint64((1 << max(8, (want - 1).bit_length())) - 1)
        low &= ~last
        least = low | np.arange(len(low), dtype=np.uint64) & last  # the last bits tell the place
        while have < want:
            more = min(have, want - have)
            least = np.minimum(least[: max(0, len(least) - more)], least[more:])
            have += more
        at = places + (((least[places] & last).astype(np.int64) - places) & int(last))
        return places, at, low


class Entries:
    """Distinct windows at some places, sorted, with the least id of each and whether it has several."""

    def __init__(self, low: np.ndarray, high: np.ndarray, ids: np.ndarray):
        order = np.lexsort((high, low))
        low, high, ids = low[order], high[order], ids[order]
        new = np.ones(len(low), bool)
        new[1:] = (low[1:] != low[:-1]) | (high[1:] != high[:-1])
        starts = np.flatnonzero(new)
        self.low, self.high = low[starts], high[starts]
        self.least = np.minimum.reduceat(ids, starts) if len(starts) else ids
        self.several = (np.maximum.reduceat(ids, starts) if len(starts) else ids) > self.least
        self.entry = np.empty(len(order), np.int64)
        self.entry[order] = np.cumsum(new) - 1

    def asked(self, part: int, level: int, bits: int) -> Iterator[tuple]:
        """A row per bucket, that is per range of the hashes' first ``bits`` bits."""
        if not len(self.low):
            return
        buckets = (self.low >> np.uint64(64 - bits)).astype(np.int64)
        ends = np.flatnonzero(np.append(buckets[1:] != buckets[:-1], True)) + 1
        begin = 0
        for end in ends.tolist():
            here = slice(begin, end)
            yield part, level, int(buckets[begin]), end - begin, pack(self.low[here], self.high[here], self.least[here], self.several[here])
            begin = end


def _planes(x: np.ndarray) -> bytes:
    """Bytes of equal rank together, so that the shuffle's compression finds the equal ones."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def _from_planes(data: bytes, at: int, n: int, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.frombuffer(data, np.uint8, n * size, at).reshape(size, n).T.copy().view(kind).ravel()


def pack(low: np.ndarray, high: np.ndarray, least: np.ndarray, several: np.ndarray) -> bytes:
    base = int(least.min())
    span = (least.view(np.uint64) - np.uint64(base & ((1 << 64) - 1))).astype(np.uint64)
    wide = int(span.max()) >> 32 > 0
    head = np.array([base, wide], np.int64).tobytes()
    return head + _planes(low) + _planes(high) + _planes(span if wide else span.astype(np.uint32)) + np.packbits(several).tobytes()


def unpack(n: int, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    base, wide = np.frombuffer(data, np.int64, 2).tolist()
    low = _from_planes(data, 16, n, "u8")
    high = _from_planes(data, 16 + 8 * n, n, "u4")
    span = _from_planes(data, 16 + 12 * n, n, "u8" if wide else "u4").astype(np.uint64)
    least = (span + np.uint64(base & ((1 << 64) - 1))).view(np.int64)
    several = np.unpackbits(np.frombuffer(data, np.uint8, offset=16 + (20 if wide else 16) * n), count=n).astype(bool)
    return low, high, least, several


def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Two bits for each window asked for: two documents have it; a document below the asker's least has it."""
    rows, notes = [], []
    for batch in batches:
        for row in batch.to_pylist():
            if row["bucket"] == STATE:
                notes.append((row["part"], row["level"], STATE, row["n"], 0, row["payload"], None))
            else:
                rows.append(row)
    yield _record(notes, ANSWER_TYPES)
    if not rows:
        return
    sizes = [row["n"] for row in rows]
    low, high, least, several = (np.concatenate(x) for x in zip(*(unpack(row["n"], row.pop("payload")) for row in rows), strict=True))
    order = np.lexsort((high, low))
    low, high = low[order], high[order]
    new = np.ones(len(low), bool)
    new[1:] = (low[1:] != low[:-1]) | (high[1:] != high[:-1])
    starts, group = np.flatnonzero(new), np.empty(len(low), np.int64)
    group[order] = np.cumsum(new) - 1
    del low, high
    first = np.minimum.reduceat(least[order], starts)
    both = np.logical_or.reduceat(several[order], starts) | (np.maximum.reduceat(least[order], starts) > first)
    both, smaller = both[group], first[group] < least
    begin, out = 0, []
    for row, n in zip(rows, sizes, strict=True):
        b, s = both[begin : begin + n], smaller[begin : begin + n]
        out.append((row["part"], row["level"], row["bucket"], n, int(b.sum()), np.packbits(b).tobytes(), np.packbits(s).tobytes()))
        begin += n
    yield _record(out, ANSWER_TYPES)


ANSWER_TYPES = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
ASKED_TYPES = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]
KEPT_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]


def _record(rows: list[tuple], types: list[pa.DataType], names: str = ANSWER) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in types]
    return pa.record_batch(
        [pa.array(x, t) for x, t in zip(columns, types, strict=True)], names=[c.split()[0] for c in names.split(", ")]
    )


class Part:
    """One part's texts, and what its answers say."""

    def __init__(self, texts: pa.Table, answers: pa.Table | None, ladder: Ladder):
        texts = texts.sort_by("seq")
        self.part = texts["part"][0].as_py()
        self.doc_ids = texts["doc_id"]
        self.ids = pc.fill_null(texts["doc_id"], LEAST).to_numpy().astype(np.int64)
        self.texts = [x or b"" for x in texts["text"].cast(pa.large_binary()).to_pylist()]
        self.ladder = ladder
        self.answers = {} if answers is None else {
            (r["level"], r["bucket"]): r for r in answers.sort_by([("level", "ascending"), ("bucket", "ascending")]).to_pylist()
        }

    def bits(self, level: int, name: str) -> np.ndarray:
        found = [np.unpackbits(np.frombuffer(r[name], np.uint8), count=r["n"]) for (k, b), r in self.answers.items() if k == level and b != STATE]
        return np.concatenate(found).astype(bool) if found else np.zeros(0, bool)

    def candidates(self, level: int) -> tuple[np.ndarray, Words, np.ndarray]:
        """Texts that have candidates of the level, their words, and the candidates' places, from the part's notes."""
        note = self.answers.get((level, STATE))
        if note is None:
            return np.zeros(0, np.int64), Words([], self.ids[:0]), np.zeros(0, np.int64)
        data, cut = note["both"], -(-len(self.texts) // 8)
        live = np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8, cut), count=len(self.texts)))
        words = Words([self.texts[i] for i in live.tolist()], self.ids[live])
        return live, words, np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8, offset=cut), count=len(words.hashes)))

    def entries(self, level: int, words: Words, places: np.ndarray) -> Entries:
        low, high = self.ladder.hashes(words, level)
        return Entries(low[places], high[places], words.ids[places])

    def next_candidates(self, level: int) -> tuple[np.ndarray, Words, np.ndarray]:
        """Texts, words and places of the candidates of ``level`` by the answers to the level below."""
        if level == 1:
            every = np.arange(len(self.texts))
            words = Words(self.texts, self.ids)
            places, at, low = self.ladder.seeds(words)
            used = np.unique(at)
            flagged = np.zeros(len(words.hashes), bool)
            flagged[used] = self.bits(0, "both")[Entries(low[used], np.zeros(len(used), np.uint32), words.ids[used]).entry]
            return every, words, places[flagged[at]]
        live, words, places = self.candidates(level - 1)
        if not len(places):
            return live, words, places
        flagged = np.zeros(len(words.hashes), bool)
        flagged[places] = self.bits(level - 1, "both")[self.entries(level - 1, words, places).entry]
        step = self.ladder.step(level - 1)
        here = places[places + step < len(flagged)]
        inside = words.inside(self.ladder.length(level))
        here = here[here < len(inside)]
        return live, words, here[flagged[here] & flagged[here + step] & inside[here]]

    def ask(self, level: int, bits: int) -> Iterator[tuple]:
        if level == 0:
            words = Words(self.texts, self.ids)
            _, at, low = self.ladder.seeds(words)
            used = np.unique(at)
            yield from Entries(low[used], np.zeros(len(used), np.uint32), words.ids[used]).asked(self.part, level, bits)
            return
        live, words, places = self.next_candidates(level)
        if not len(places):
            return
        inner = np.unique(words.text[places])
        mask, marked = np.zeros(len(self.texts), bool), np.zeros(len(words.hashes), bool)
        mask[live[inner]] = True
        marked[places] = True
        kept = marked[np.isin(words.text, inner)]
        yield self.part, level, STATE, len(places), np.packbits(mask).tobytes() + np.packbits(kept).tobytes()
        yield from self.entries(level, words, places).asked(self.part, level, bits)

    def earlier(self, level: int) -> tuple[np.ndarray, Words, np.ndarray]:
        """Texts, words and places of the level's windows that start under a smaller id, too."""
        live, words, places = self.candidates(level)
        if not len(places):
            return live, words, places
        entries = self.entries(level, words, places)
        return live, words, places[self.bits(level, "smaller")[entries.entry] | (entries.least[entries.entry] < words.ids[places])]

    def removed(self) -> dict[int, np.ndarray]:
        """By text, which of its words go."""
        live, words, gone = self.earlier(1)
        ends = np.zeros(len(words.hashes) + 1, np.int64)
        np.add.at(ends, gone, 1)
        np.add.at(ends, gone + self.ladder.window, -1)
        covered = np.cumsum(ends[:-1]) > 0
        touched = np.unique(words.text[gone])
        return {int(live[t]): covered[words.first[t] : words.first[t + 1]] for t in touched.tolist()}

    def longest(self) -> np.ndarray:
        """By text, the length of the last level at which it has a window that starts under a smaller id, too."""
        out = np.zeros(len(self.texts), np.int64)
        for level in sorted({k for k, _ in self.answers if k}):
            live, words, places = self.earlier(level)
            out[live[np.unique(words.text[places])]] = self.ladder.length(level)
        return out


def _asker(level: int, window: int, bits: int):
    def ask(texts: pa.Table, answers: pa.Table | None) -> pa.Table:
        rows = list(Part(texts, answers, Ladder(window)).ask(level, bits)) if len(texts) else []
        return pa.Table.from_batches([_record(rows, ASKED_TYPES, ASKED)])

    def first(texts: pa.Table) -> pa.Table:
        return ask(texts, None)

    def later(texts: pa.Table, answers: pa.Table) -> pa.Table:
        return ask(texts, answers)

    return later if level else first


def _keeper(window: int):
    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(texts):
            return pa.Table.from_batches([_record([], KEPT_TYPES, KEPT)])
        part = Part(texts, answers, Ladder(window))
        removed, longest, rows = part.removed(), part.longest().tolist(), []
        for i, (doc, text) in enumerate(zip(part.doc_ids.to_pylist(), part.texts, strict=True)):
            words = text.split()
            gone = removed.get(i)
            left = words if gone is None else [w for w, out in zip(words, gone.tolist(), strict=True) if not out]
            rows.append((doc, len(words), len(words) - len(left), longest[i], b" ".join(left).decode()))
        return pa.Table.from_batches([_record(rows, KEPT_TYPES, KEPT)])

    return run


def _parts(most: int):
    """Slices of at most ``most`` bytes of text (or one row), numbered within the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() << 32
        for batch in batches:
            size = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            ends, begin = np.cumsum(size), 0
            while begin < len(size):
                end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + most, "right")))
                here, n = slice(begin, end), end - begin
                own = [pa.array(np.full(n, part)), pa.array(np.arange(n, dtype=np.int32)), pa.array(size[here])]
                yield pa.record_batch([*own, *(c.slice(begin, n) for c in batch.columns)], names=["part", "seq", "bytes", "doc_id", "text"])
                begin, part = end, part + 1

    return run


FINER = 2  # buckets are finer than the tasks that they are dealt to, so that tasks are even


def _bits(rows: int, per_task: int) -> int:
    return FINER + max(6, (max(1, rows) // per_task).bit_length())


class Search:
    """The levels of one run: a table of parts, and a table of answers per level."""

    def __init__(self, docs: DataFrame, window: int, part_bytes: int, task_rows: int, id_column: str, text_column: str):
        spark = self.spark = docs.sparkSession
        self.space, self.window, self.task_rows = Workspace(spark, "substrings"), window, task_rows
        narrow = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
        table = f"substrings_{uuid.uuid4().hex}"
        writer = narrow.mapInArrow(_parts(part_bytes), PARTS).write.option("path", self.space.path("parts")).option("compression", "zstd")
        writer.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), "part").saveAsTable(table)
        self.parts = spark.table(table)
        spark.sql(f"DROP TABLE {table}")  # the files stay in the workspace, and the frame knows their buckets
        self.answers: list[DataFrame] = []

    def texts(self) -> DataFrame:
        return self.parts.select("part", "seq", "doc_id", "text")

    def level(self) -> int:
        """Ask and answer the next level; returns how many of its distinct windows, by part, two documents have."""
        level = len(self.answers)
        if level == 0:
            expected = (self.parts.agg(F.sum("bytes")).first()[0] or 0) // (3 * self.window)
        else:
            repeated = self.answers[-1].agg(F.sum("repeated")).first()[0] or 0
            expected = repeated * self.window // 4 if level == 1 else repeated
        bits = _bits(expected, self.task_rows)
        ask, texts = _asker(level, self.window, bits), self.texts().groupBy("part")
        if level == 0:
            asked = texts.applyInArrow(ask, ASKED)
        else:
            asked = texts.cogroup(self.answers[-1].groupBy("part")).applyInArrow(ask, ASKED)
        key = F.when(F.col("bucket") == STATE, F.col("part")).otherwise(F.col("bucket"))
        dealt = asked.repartition(1 << (bits - FINER), key).mapInArrow(answer, ANSWER)
        self.answers.append(self.space.save(dealt, f"level{level}"))
        return self.answers[-1].agg(F.sum("repeated")).first()[0] or 0

    def climb(self) -> list[int]:
        """Levels until no candidates survive; returns what each found."""
        counts: list[int] = []
        while len(counts) < 2 or counts[-1]:
            counts.append(self.level())
        return counts

    def kept(self) -> DataFrame:
        found = self.answers[1]
        for more in self.answers[2:]:
            found = found.unionByName(more)
        found = found.groupBy("part")
        return self.texts().groupBy("part").cogroup(found).applyInArrow(_keeper(self.window), KEPT)


def dedup_substrings(
    docs: DataFrame,
    window: int = 50,
    part_bytes: int = 4 << 20,
    task_rows: int = 1 << 19,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """One row per input row: ``doc_id, n_words, n_removed, longest, kept``, the text left with one space between words.

    A word goes when a window of ``window`` words that covers it also starts in a row with a smaller id; windows are
    judged on the input.  ``longest`` is the greatest of ``window``, twice that and so on at which the row has such a window
    (0: none).  Words are runs of other characters than space and 0x09-0x0D, taken unchanged.  Null and empty
    texts have no words.  Rows with one id are one document to each other: none removes from another.  A null id is the
    smallest.  Equal rows get equal results; a text of any length is searched as a whole, and is a part of its own above
    ``part_bytes``; an empty table gives no rows; other columns are not read.
    """
    search = Search(docs, window, part_bytes, task_rows, id_column, text_column)
    search.climb()
    return search.kept()


def longest_repeats(
    docs: DataFrame, window: int = 50, part_bytes: int = 4 << 20, task_rows: int = 1 << 19, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """``length, windows``: per level from ``window`` on, doubled until no candidates survive, the distinct windows of
    that many words that two documents have.  Counted by part: a window in several parts counts in each."""
    search = Search(docs, window, part_bytes, task_rows, id_column, text_column)
    rows = [(window << k, n) for k, n in enumerate(search.climb()[1:]) if n]
    return docs.sparkSession.createDataFrame(rows, "length long, windows long")
