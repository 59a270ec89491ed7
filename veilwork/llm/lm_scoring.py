"""Language-model scores from a weighted backoff automaton over all words, pairs and triples of the training rows.

States are the empty history, the beginning of a text, every word and every pair that was learned.  An arc carries
the smoothed log-probability of a word and leads to the state of the longest learned history behind it; a failure
arc carries the weight of the shorter history and leads there.  With c the count of an n-gram, h of its history and
k a fixed weight, p(word | history) = (c + k * p(word | shorter history)) / (h + k): an n-gram that was not learned
(c = 0) gets the failure arc's k / (h + k) times the shorter history's probability, and all probabilities of a state
sum to one.  The empty history has add-one probabilities.  There is no cut: the model holds every n-gram.

The whole automaton grows with the corpus, so no task holds it.  Texts are kept in blocks.  A block asks for the
counts of its own distinct n-grams and brings its own counts of them; requests are dealt by the hash of the n-gram,
added up there, and the totals go back to the blocks in the order of the requests.  A block then has the part of the
automaton that its texts can reach, and all of it.  A frequent n-gram is one entry per block, whatever its share of
the corpus.  Requests travel as steps between sorted hashes, a row per block and bucket.  Words are told apart by
64 bits of hash, pairs and triples by 56: among 10**10 of them a given one shares its hash once in seven million.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilwork.llm.language_id import remainder
from veilwork.llm.store import Workspace
from veilwork.llm.text import mix, portions, signed, words

BLOCK = 4 << 20  # bytes of text in a block; a longer text is a block of its own
BUCKET = 1 << 20  # requests added up together, about
PAIR_WEIGHT, TRIPLE_WEIGHT = 128.0, 8.0  # k of the formula above for words and for pairs as histories
END, BEGIN = np.uint64(0x1D8E4E27C47D124F), np.uint64(0xEB44ACCAB455D165)  # hashes that stand for no word
PAIR, TRIPLE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
BLOCKS = (
    "block long, n_words long, n_tokens long, learned_tokens long, learned_texts long,"
    " ids array<long>, learn array<boolean>, scored array<boolean>, sizes array<int>, words binary, tokens binary"
)
REQUESTS = "block long, bucket int, first long, steps binary, n int, low binary, high binary"
REPLIES = "block long, bucket int, learned long, n int, low binary, high binary"
SCORED = "doc_id long, n_tokens long, n_known long, base_score double, score double"


def _tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts, each with an end behind it, and where each text begins."""
    hashes, at = words(texts)
    return np.insert(hashes, at[1:], END), at + np.arange(len(at))


def _blocks(most: int):
    """Texts as numbers of words, frequent words first; the numbers' bytes stand apart, so they compress well."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for rows, texts in portions(batch, "text", most):
                hashes, at = _tokens(texts)
                distinct, number, times = np.unique(hashes, return_inverse=True, return_counts=True)
                order = np.argsort(-times, kind="stable")
                rank = np.empty(len(order), np.uint32)
                rank[order] = np.arange(len(order))
                planes = np.ascontiguousarray(rank[number].view(np.uint8).reshape(-1, 4).T)
                sizes, learn = np.diff(at), rows.column(2).to_numpy(zero_copy_only=False).astype(bool)
                row = {
                    "block": block,
                    "n_words": len(distinct),
                    "n_tokens": len(hashes),
                    "learned_tokens": int(sizes[learn].sum()),
                    "learned_texts": int(learn.sum()),
                    "ids": rows.column(0).to_pylist(),
                    "learn": learn.tolist(),
                    "scored": rows.column(3).to_pylist(),
                    "sizes": sizes.tolist(),
                    "words": distinct[order].tobytes(),
                    "tokens": _squeeze(planes.tobytes()),
                }
                kinds = [pa.int64()] * 5 + [pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.bool_()), pa.list_(pa.int32())]
                kinds += [pa.binary()] * 2
                yield pa.record_batch([pa.array([x], k) for x, k in zip(row.values(), kinds, strict=True)], names=list(row))
                block += 1

    return run


class Block:
    """The tokens of a block, its sorted distinct n-grams, and which of them belong to each token."""

    def __init__(self, batch: pa.RecordBatch, i: int):
        def column(name: str) -> pa.Scalar:
            return batch.column(batch.schema.get_field_index(name))[i]

        self.number = column("block").as_py()
        self.ids, self.scored = column("ids").as_py(), np.array(column("scored").as_py(), bool)
        self.sizes, self.learn = np.array(column("sizes").as_py(), np.int64), np.array(column("learn").as_py(), bool)
        distinct = np.frombuffer(column("words").as_py(), np.uint64)
        planes = np.frombuffer(_stretch(column("tokens").as_py(), 4 * int(self.sizes.sum())), np.uint8).reshape(4, -1)
        token = np.ascontiguousarray(planes.T).view(np.uint32).ravel()
        order = np.argsort(distinct)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.words, self.word_of = distinct[order], place[token]
        self.start = np.cumsum(self.sizes) - self.sizes
        pair, triple, self.inner = self._grams(distinct[token])
        self.grams, self.gram_of = np.unique(np.concatenate([pair, triple[self.inner]]) >> np.uint64(8), return_inverse=True)

    def _grams(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each token: hashes of the pair and triple that end there, and whether there is a triple."""
        before = np.concatenate(([BEGIN], hashes[:-1]))
        before[self.start] = BEGIN
        pair = mix(before * PAIR + hashes)
        triple = mix(np.concatenate((pair[:1], pair[:-1])) * TRIPLE + hashes)
        inner = np.ones(len(hashes), bool)
        inner[self.start] = False
        return pair, triple, inner

    def learned(self) -> tuple[np.ndarray, np.ndarray]:
        """How often the block's learning texts have each word and each longer n-gram."""
        weight = np.repeat(self.learn, self.sizes).astype(np.float64)
        longer = np.bincount(self.gram_of, np.concatenate([weight, weight[self.inner]]), len(self.grams))
        return np.bincount(self.word_of, weight, len(self.words)).astype(np.int64), longer.astype(np.int64)

    def score(self, totals: np.ndarray, total: int, distinct: int, documents: int) -> pa.RecordBatch:
        """One pass over all tokens, left to right; the state behind a token is its longest learned history."""
        counts, longer = totals[: len(self.words)][self.word_of], totals[len(self.words) :]
        pairs, triples = longer[self.gram_of[: len(counts)]], np.zeros(len(counts), np.int64)
        triples[self.inner] = longer[self.gram_of[len(counts) :]]

        def behind(state: np.ndarray, first: int) -> np.ndarray:
            carried = np.concatenate(([0], state[:-1]))
            carried[self.start] = first
            return carried

        word_state, pair_state = behind(counts, documents), behind(pairs, 0)  # counts of the two states before a token
        one = (counts + 1) / (total + distinct + 1)
        two = (pairs + PAIR_WEIGHT * one) / (word_state + PAIR_WEIGHT)
        three = (triples + TRIPLE_WEIGHT * two) / (pair_state + TRIPLE_WEIGHT)
        arc3 = triples > 0
        fail3 = ~arc3 & (pair_state > 0)  # from the pair to its last word
        arc2 = ~arc3 & (pairs > 0)
        fail2 = ~arc3 & ~arc2 & (word_state > 0)  # from the word to the empty history
        log1 = np.log10(one)
        log = np.where(arc3, np.log10(three), np.where(arc2, np.log10(two), log1))
        log[fail3] += np.log10(TRIPLE_WEIGHT / (pair_state[fail3] + TRIPLE_WEIGHT))
        log[fail2] += np.log10(PAIR_WEIGHT / (word_state[fail2] + PAIR_WEIGHT))
        known = np.add.reduceat((counts > 0).astype(np.int64), self.start)
        columns = [self.sizes, known, np.add.reduceat(log1, self.start), np.add.reduceat(log, self.start)]
        ids = pa.array(self.ids, pa.int64()).filter(pa.array(self.scored))
        return pa.record_batch([ids, *(pa.array(c[self.scored]) for c in columns)], names=[c.split()[0] for c in SCORED.split(", ")])


def _squeeze(data: bytes) -> bytes:
    """Compressed, unless that is no shorter."""
    squeezed = pa.compress(data, codec="zstd", asbytes=True)
    return squeezed if len(squeezed) < len(data) else data


def _stretch(data: bytes, size: int) -> bytes:
    return data if len(data) == size else pa.decompress(data, size, codec="zstd", asbytes=True)


def _slices(data: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """A binary value between each two cuts."""
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(cuts.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])


def _pack(counts: np.ndarray, cuts: np.ndarray) -> list[pa.Array]:
    """How many counts, a byte per count, and eight more for counts from 255."""
    large = np.flatnonzero(counts >= 255)
    low = np.minimum(counts, 255).astype(np.uint8).tobytes()
    squeezed = [_squeeze(low[a:b]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
    high = _slices(counts[large].astype(np.int64), 8 * np.searchsorted(large, cuts))
    return [pa.array(np.diff(cuts).astype(np.int32)), pa.array(squeezed, pa.binary()), high]


def _unpack(n: int, low: bytes, high: bytes) -> np.ndarray:
    counts = np.frombuffer(_stretch(low, n), np.uint8).astype(np.int64)
    counts[counts == 255] = np.frombuffer(high, np.int64)
    return counts


def _ask(word_buckets: int, gram_buckets: int):
    def requests(block: int, keys: np.ndarray, bits: int, counts: np.ndarray, buckets: int, first_bucket: int) -> pa.RecordBatch:
        bucket = ((keys >> np.uint64(bits - 32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
        begin = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
        cuts = np.append(begin, len(keys))
        steps = np.diff(keys, prepend=keys[:1])
        steps[begin] = 0
        width = max(1, (int(steps.max()).bit_length() + 7) // 8)
        narrow = np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8)[:, :width]).ravel()
        return pa.record_batch(
            [
                pa.array(np.full(len(begin), block)),
                pa.array((bucket[begin] + first_bucket).astype(np.int32)),
                pa.array(signed(keys[begin])),
                _slices(narrow, cuts * width),
                *_pack(counts, cuts),
            ],
            names=["block", "bucket", "first", "steps", "n", "low", "high"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block = Block(batch, i)
                if block.grams.size:
                    by_word, by_gram = block.learned()
                    yield requests(block.number, block.words, 64, by_word, word_buckets, 0)
                    yield requests(block.number, block.grams, 56, by_gram, gram_buckets, word_buckets)

    return run


def _keys(first: int, steps: bytes, n: int) -> np.ndarray:
    width = len(steps) // n
    wide = np.zeros((n, 8), np.uint8)
    wide[:, :width] = np.frombuffer(steps, np.uint8).reshape(n, width)
    return np.cumsum(wide.view(np.uint64).ravel(), dtype=np.uint64) + np.array([first], np.int64).view(np.uint64)


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Totals of each bucket's requests, in the order of the requests; the rows of a bucket follow each other."""
    now, blocks, keys, counts = None, [], [], []

    def replies() -> pa.RecordBatch:
        cuts = np.concatenate(([0], np.cumsum([len(k) for k in keys])))
        _, at = np.unique(np.concatenate(keys), return_inverse=True)
        totals = np.bincount(at, np.concatenate(counts)).astype(np.int64)
        learned = [int((totals > 0).sum())] + [0] * (len(blocks) - 1)  # once per bucket
        return pa.record_batch(
            [pa.array(blocks, pa.int64()), pa.array([now] * len(blocks), pa.int32()), pa.array(learned, pa.int64()), *_pack(totals[at], cuts)],
            names=["block", "bucket", "learned", "n", "low", "high"],
        )

    for batch in batches:
        for block, bucket, first, steps, n, low, high in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if bucket != now and blocks:
                yield replies()
                blocks, keys, counts = [], [], []
            now = bucket
            blocks.append(block)
            keys.append(_keys(first, steps, n))
            counts.append(_unpack(n, low, high))
    if blocks:
        yield replies()


def _scores(total: int, distinct: int, documents: int):
    """A block's row comes before its replies, and those come in the order of its n-grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, totals = None, []
        for batch in batches:
            buckets, n, low, high = (batch.column(batch.schema.get_field_index(c)) for c in ("bucket", "n", "low", "high"))
            for i, bucket in enumerate(buckets.to_pylist()):
                if bucket >= 0:
                    totals.append(_unpack(n[i].as_py(), low[i].as_py(), high[i].as_py()))
                    continue
                if block:
                    yield block.score(np.concatenate(totals), total, distinct, documents)
                block, totals = Block(batch, i), []
        if block:
            yield block.score(np.concatenate(totals), total, distinct, documents)

    return run


def _score(rows: DataFrame, block_bytes: int) -> DataFrame:
    """Scores of the ``scored`` rows of ``id, text, learn, scored``, learning from the ``learn`` rows."""
    space = Workspace(rows.sparkSession, "lm")
    blocks = space.save(rows.mapInArrow(_blocks(block_bytes), BLOCKS), "blocks")
    sums = [F.coalesce(F.sum(c), F.lit(0)) for c in ("n_words", "n_tokens", "learned_tokens", "learned_texts")]
    n_words, n_tokens, total, documents, n_blocks = blocks.agg(*sums, F.count(F.lit(1))).first()
    word_buckets, gram_buckets = max(16, n_words // BUCKET), max(32, 2 * n_tokens // BUCKET)
    asked = blocks.select("block", "ids", "learn", "scored", "sizes", "words", "tokens").mapInArrow(_ask(word_buckets, gram_buckets), REQUESTS)
    dealt = asked.repartition(word_buckets + gram_buckets, "bucket").sortWithinPartitions("bucket")
    replies = space.save(dealt.mapInArrow(_add_up, REPLIES), "replies")
    distinct = replies.where(F.col("bucket") < word_buckets).agg(F.coalesce(F.sum("learned"), F.lit(0))).first()[0]

    both = blocks.drop("n_words", "n_tokens", "learned_tokens", "learned_texts").withColumn("bucket", F.lit(-1))
    both = both.unionByName(replies.drop("learned"), allowMissingColumns=True)
    gathered = both.repartition(max(16, n_blocks // 2), "block").sortWithinPartitions("block", "bucket")
    scored = gathered.mapInArrow(_scores(total, distinct, documents), SCORED)
    return scored.select("doc_id", "n_tokens", "n_known", F.lit(int(total)).cast("long").alias("train_tokens"), "base_score", "score")


def _rows(docs: DataFrame, id_column: str, text_column: str, learn, scored: bool) -> DataFrame:
    return docs.select(
        F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"), learn.alias("learn"), F.lit(scored).alias("scored")
    )


def score(docs: DataFrame, training: DataFrame, id_column: str = "doc_id", text_column: str = "text", block_bytes: int = BLOCK) -> DataFrame:
    """``doc_id, n_tokens, n_known, train_tokens, base_score, score`` for every row of ``docs``.

    Null counts as empty (one token, the end).  Known words are those of the training rows, at any frequency.  Without
    training rows every token has probability one (its add-one estimate).  Rows with equal ids are scored one by one.
    """
    learned = training.select(F.lit(None).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))
    learned = learned.select("id", "text", F.lit(True).alias("learn"), F.lit(False).alias("scored"))
    return _score(_rows(docs, id_column, text_column, F.lit(False), True).unionByName(learned), block_bytes)


def score_held_out(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", block_bytes: int = BLOCK) -> DataFrame:
    """All rows, learning from those whose id's crc32 leaves another remainder than 2 when divided by 7."""
    scored = _score(_rows(docs, id_column, text_column, remainder(id_column, 7) != 2, True), block_bytes)
    return scored.select("doc_id", (remainder("doc_id", 7) == 2).alias("held_out"), *scored.columns[1:])
