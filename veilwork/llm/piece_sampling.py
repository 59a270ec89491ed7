"""Sampled segmentations over a SentencePiece vocabulary, and lossless decoding.

The lattice of a text has an edge for every vocabulary piece that matches at a place; a character that no piece
holds has an edge of its UTF-8 byte pieces.  Pieces never continue over the beginning of a run of spaces, so the
lattice falls apart into units (spaces and the characters behind them).  Forward filtering sums, place by place,
the weights of all paths into a place; backward sampling draws the last piece of a unit by its share of that sum,
then the piece before it, and so on.  Both steps run for all units of a portion at once, forward filtering once
per distinct unit.  Draws are a function of seed, row key and place: a text gets the same pieces in any partition.

Edges are found by one walk per place, backward through a trie of the pieces' ends, which stops where no piece ends
with the characters read.  Units fall apart further at places that every path passes (no edge leads across), so a long
text without spaces is filtered and sampled in short spans side by side; the shares stay the same.

Weights: exp(score) of unigram vocabularies; the scores of BPE vocabularies are merge ranks r and weigh
1 / (r + 10).  ``theta`` is the exponent of all weights (large: close to the best path; 0: all paths alike).
A text is encoded with a space before it, as the vocabulary expects; decoding takes that space off.  A literal
U+2581 is encoded as bytes, so it is never taken for a space.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilwork.llm.text import mix, portions

SPACE = "▁"
BASE = np.uint64(0x9E3779B97F4A7C15)
ENCODED = "id long, text string, pieces array<int>"
PORTION = 1 << 18  # bytes of text; a portion's arrays take some hundred times that


class Vocabulary:
    """Pieces by a polynomial hash over their code points, last one first; byte pieces; bytes of every piece."""

    def __init__(self, path: str, theta: float):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        plain = [
            i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))
        ]
        texts = {i: model.id_to_piece(i).replace(SPACE, " ") for i in plain}
        texts = {i: t for i, t in texts.items() if " " not in t.lstrip(" ")}
        scores = np.array([model.get_score(i) for i in texts])
        ranks = bool(len(scores)) and bool((scores == np.round(scores)).all())
        logs = -np.log(10.0 - scores) if ranks else scores
        self.longest = max((len(t) for t in texts.values()), default=1)
        self._trie(texts, np.exp(theta * logs))
        low = np.exp(theta * logs.min()) if len(scores) else 1.0
        self.byte_weight = self.weights[-2] = low * 1e-3
        self.bytes_of = [b""] * n
        for i, t in texts.items():
            self.bytes_of[i] = t.encode()
        self.byte_ids = np.full(256, -1, np.int32)
        for i in range(n):
            if model.is_byte(i):
                value = int(model.id_to_piece(i)[1:-1], 16)
                self.byte_ids[value], self.bytes_of[i] = i, bytes([value])
        if (self.byte_ids < 0).any():
            raise ValueError("the vocabulary has no byte pieces; it can't hold every text")
        self.bytes_at = np.array(self.bytes_of, object)

    def _trie(self, texts: dict[int, str], weights: np.ndarray) -> None:
        """All ends of pieces in an open-addressing table by hash: the nodes of a trie read from the last character.

        Slot numbers name the nodes; ``ids`` and ``weights`` have two more entries, for a character without a piece
        (``-2``) and for no edge (``-1``).
        """
        nodes: dict[int, int] = {}
        for k, (i, t) in enumerate(texts.items()):
            h, power = 0, 1
            for c in reversed(t):
                h = (h + (ord(c) + 1) * power) % 2**64
                power = power * int(BASE) % 2**64
                nodes.setdefault(h, -1)
            nodes[h] = k
        bits = max(4, (4 * len(nodes)).bit_length())
        self.shift, self.last_slot = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.used = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, bool)
        keys, piece = np.array(list(nodes), np.uint64), np.array(list(nodes.values()), np.int64)
        slots, at, left = np.empty(len(keys), np.int64), self._slot(keys), np.arange(len(keys))
        while len(left):
            _, first = np.unique(at, return_index=True)
            first = first[~self.used[at[first]]]
            self.keys[at[first]], self.used[at[first]], slots[left[first]] = keys[left[first]], True, at[first]
            wait = np.ones(len(left), bool)
            wait[first] = False
            left, at = left[wait], (at[wait] + 1) & self.last_slot
        self.ids = np.full((1 << bits) + 2, -1, np.int32)
        self.weights = np.zeros((1 << bits) + 2)
        whole = piece >= 0
        self.ids[slots[whole]] = np.array(list(texts), np.int32)[piece[whole]]
        self.weights[slots[whole]] = weights[piece[whole]]

    def _slot(self, hashes: np.ndarray) -> np.ndarray:
        return ((hashes * BASE) >> self.shift).astype(np.int64)

    def nodes(self, hashes: np.ndarray) -> np.ndarray:
        """The node of each hash, -1 where no piece ends so."""
        at = self._slot(hashes)
        out = np.where(self.keys[at] == hashes, at, -1)
        open_ones = np.flatnonzero((out < 0) & self.used[at])
        while len(open_ones):
            at = (at[open_ones] if len(at) != len(open_ones) else at) + 1 & self.last_slot
            hit = self.keys[at] == hashes[open_ones]
            out[open_ones[hit]] = at[hit]
            more = ~hit & self.used[at]
            open_ones, at = open_ones[more], at[more]
        return out

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids (-1: none) and weights (0)."""
        at = self.nodes(hashes)
        return self.ids[at], self.weights[at]


def _hash(text: str) -> int:
    h, power = 0, 1
    for c in reversed(text):
        h += (ord(c) + 1) * power
        power *= int(BASE)
    return h % 2**64


@lru_cache(maxsize=4)
def vocabulary(path: str, theta: float = 1.0) -> Vocabulary:
    return Vocabulary(path, theta)


def _edges(v: Vocabulary, points: np.ndarray, within: np.ndarray) -> np.ndarray:
    """Node of the edge of each length into each character (-1: none); ``within`` counts a unit's characters from 0.

    In memory the edges of one length lie together.
    """
    out = np.full((v.longest, len(points)), -1, np.int32)
    codes = points.astype(np.uint64) + np.uint64(1)
    place, h, power = np.arange(len(points)), np.zeros(len(points), np.uint64), np.uint64(1)
    for m in range(v.longest):
        h = h + codes[place - m] * power
        with np.errstate(over="ignore"):
            power = power * BASE
        node = v.nodes(h)
        out[m, place] = np.where(v.ids[node] >= 0, node, -2 if m == 0 else -1)
        on = np.flatnonzero((node >= 0) & (within[place] > m))
        place, h = place[on], h[on]
        if not len(place):
            break
    return out.T


def _spans(edges: np.ndarray, within: np.ndarray) -> np.ndarray:
    """Characters behind places that every path passes: no edge leads across them."""
    n, longest = edges.shape
    reach = np.zeros(n, np.int32)  # characters before its last one that an edge holds
    for m in range(1, longest):
        np.maximum(reach, (edges[:, m] != -1) * np.int32(m), out=reach)
    crossed = np.bincount(np.arange(n) - reach + 1, minlength=n + 1)
    crossed[1:] -= 1
    return (np.cumsum(crossed)[:n] == 0) | (within == 0)


def _lattice(v: Vocabulary, edges: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nodes and running sums of the shares of the edges of each length into each character; spans are longest first.

    Characters are dealt by their place in the span, then by span, so a place of all spans is one slice; the last array
    is where each place begins.
    """
    more = np.cumsum(np.bincount(size)[:0:-1])[::-1]  # spans of more than t characters
    first = np.concatenate(([0], np.cumsum(more)))
    place = begin[np.arange(first[-1]) - np.repeat(first[:-1], more)] + np.repeat(np.arange(len(more)), more)
    nodes, sums = np.empty((v.longest, len(place)), np.int32), np.empty((v.longest, len(place)), np.float32)
    for m, a in enumerate(first[: min(v.longest, len(more))].tolist()):  # no edge begins before its span
        nodes[m, a:] = edges[:, m][place[a:]]
    top = 2 * v.longest - 1
    alpha = np.empty((top + 1, len(size)))  # of the last places, the newest in row ``top``
    alpha[top] = 1.0
    for t, (a, k) in enumerate(zip(first.tolist(), more.tolist(), strict=False)):
        c = min(t + 1, v.longest)
        values = alpha[top : top + c, :k] * v.weights[nodes[:c, a : a + k]]
        if k < 256:
            values = np.cumsum(values, 0)
        else:  # numpy's own sums go down column by column
            for m in range(1, c):
                values[m] += values[m - 1]
        dead = np.flatnonzero(values[-1] == 0)  # extreme ``theta`` only: all shares too small to tell; one character
        values[:, dead] = 1e-300
        total = values[-1]
        sums[:c, a : a + k] = values / total
        if top == 0:
            older, top = alpha, v.longest + 1
            alpha = np.empty((2 * v.longest, k))
            alpha[top:] = older[: v.longest - 1, :k]
        top -= 1
        alpha[top, :k] = total
        if total.min() < 1e-100 or total.max() > 1e100:  # only shares matter
            last = alpha[top : top + min(t + 2, v.longest), :k]
            last /= last.max(0)
    return nodes, sums, first


def encode_texts(v: Vocabulary, texts: list[str], seeds: np.ndarray) -> list[np.ndarray]:
    """Sampled piece ids of every text; ``seeds`` has a 64-bit number per text."""
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    points = np.frombuffer("".join(" " + t for t in texts).encode("utf-32-le", "surrogatepass"), "<u4")
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    if not len(points):
        return []
    space = points == 32
    start = space.copy()
    start[1:] &= ~space[:-1]
    start[bounds[:-1]] = True
    begin = np.flatnonzero(start)
    size = np.diff(np.append(begin, len(points)))
    text_of = np.searchsorted(bounds, begin, "right") - 1
    ordinal = np.arange(len(begin)) - np.searchsorted(begin, bounds)[text_of]
    # Distinct units, side by side.
    within = np.arange(len(points)) - np.repeat(begin, size)
    powers = np.multiply.accumulate(np.append(np.uint64(1), np.full(int(size.max()), BASE)))
    unit = mix(np.add.reduceat((points.astype(np.uint64) + np.uint64(1)) * powers[within], begin) ^ (size.astype(np.uint64) << np.uint64(40)))
    _, example, kind = np.unique(unit, return_index=True, return_inverse=True)
    own = size[example]
    place = np.cumsum(own) - own
    own_within = np.arange(int(own.sum())) - np.repeat(place, own)
    edges = _edges(v, points[own_within + np.repeat(begin[example], own)], own_within)
    # Their spans, longest first, and the spans of all units.
    cut = np.flatnonzero(_spans(edges, own_within))
    span = np.diff(np.append(cut, len(edges)))
    order = np.argsort(-span, kind="stable")
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    nodes, sums, at = _lattice(v, edges, cut[order], span[order])
    del edges
    first = np.searchsorted(cut, place)
    spans = np.diff(np.append(first, len(cut)))[kind]
    which = np.arange(int(spans.sum())) - np.repeat(np.cumsum(spans) - spans - first[kind], spans)
    row = cut[which] - 1 + np.repeat(begin - place[kind], spans)  # a span's character k is the texts' row + k
    noise = mix(seeds.astype(np.uint64)[text_of] ^ mix(ordinal.astype(np.uint64)))
    noise = np.repeat(noise, spans) + own_within[cut[which]].astype(np.uint64) * BASE
    text_of = np.repeat(text_of, spans)
    # Backward sampling of all spans.
    left, rank, now = span[which], rank[which], np.arange(len(which))
    steps, count = [], np.zeros(len(which), np.int64)
    while len(now):
        k = left[now]
        here = at[k - 1] + rank[now]
        draw = (mix(noise[now] + k.astype(np.uint64) * BASE) >> np.uint64(40)).astype(np.float32) / np.float32(1 << 24)
        length, m = np.zeros(len(now), np.int64), 0
        on = np.flatnonzero(sums[0][here] <= draw)
        while len(on):  # the last share is 1, draws are less
            m += 1
            length[on] = m
            on = on[sums[m][here[on]] <= draw[on]]
        steps.append((now, v.ids[nodes[length, here]], row[now] + k))
        count[now] += 1
        k -= length + 1
        left[now] = k
        now = now[k > 0]
    offset = np.cumsum(count)
    out, char = np.empty(int(count.sum()), np.int32), np.empty(int(count.sum()), np.int64)
    for s, (which, piece, where) in enumerate(steps):
        out[offset[which] - 1 - s] = piece
        char[offset[which] - 1 - s] = where
    per_text = np.bincount(text_of, count, len(texts)).astype(np.int64)
    unknown = np.flatnonzero(out < 0)
    if len(unknown):  # characters without a piece: their bytes
        missing = points[char[unknown]].tolist()
        bytes_of = {c: v.byte_ids[list(chr(c).encode("utf-8", "surrogatepass"))] for c in set(missing)}
        codes = [bytes_of[c] for c in missing]
        extra = np.array([len(c) - 1 for c in codes])
        piece_text = np.repeat(np.arange(len(texts)), per_text)[unknown]
        per_text += np.bincount(piece_text, extra, len(texts)).astype(np.int64)
        wide = np.ones(len(out), np.int64)
        wide[unknown] += extra
        first = (np.cumsum(wide) - wide)[unknown]
        out = np.repeat(out, wide)
        out[np.repeat(first - np.concatenate(([0], np.cumsum(extra + 1)[:-1])), extra + 1) + np.arange(int((extra + 1).sum()))] = np.concatenate(codes)
    return np.split(out, np.cumsum(per_text)[:-1])


def decode_ids(v: Vocabulary, ids) -> str:
    return b"".join(v.bytes_at[np.asarray(ids, np.int64)].tolist()).decode("utf-8", "surrogatepass")[1:]


def _encode(path: str, theta: float, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path, theta)
        for batch in batches:
            for rows, texts in portions(batch, "text", PORTION):
                strings = [t.decode("utf-8") for t in texts]
                keys = np.array([hash_key(k) for k in rows.column(0).to_pylist()], np.uint64)
                pieces = encode_texts(v, strings, mix(keys ^ np.uint64(seed)))
                cuts = np.concatenate(([0], np.cumsum([len(p) for p in pieces]))).astype(np.int32)
                flat = np.concatenate(pieces) if pieces else np.zeros(0, np.int32)
                yield pa.record_batch(
                    [rows.column(0), rows.column(1).cast(pa.string()), pa.ListArray.from_arrays(cuts, pa.array(flat))],
                    names=["id", "text", "pieces"],
                )

    return run


def hash_key(key: int | None) -> int:
    """A null key has a number of its own."""
    return 0x5851F42D4C957F2D if key is None else key % 2**64


def encode(
    docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text", theta: float = 1.0, seed: int = 1
) -> DataFrame:
    """``id, text, pieces`` per row; null and empty texts give the pieces of the space before them.

    ``path`` is a SentencePiece model that all executors have.  Rows with equal id and text get equal pieces.
    """
    return _rows(docs, id_column, text_column).mapInArrow(_encode(path, theta, seed), ENCODED)


def _rows(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    return docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))


def decode(encoded: DataFrame, path: str, id_column: str = "id", pieces_column: str = "pieces") -> DataFrame:
    """``id, text`` per row of piece ids; null pieces give null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                texts = [None if p is None else decode_ids(v, p) for p in part.column(1).to_pylist()]
                yield pa.record_batch([part.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    rows = encoded.select(F.col(id_column).cast("long").alias("id"), F.col(pieces_column).cast("array<int>").alias("pieces"))
    return rows.mapInArrow(run, "id long, text string")


def round_trip(
    docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text", theta: float = 1.0, seed: int = 1
) -> DataFrame:
    """``doc_id, n_pieces, pieces_crc32, text_sha256, lossless`` per row, the last two from the decoded text.

    Encoding and decoding follow each other in one Python worker: two would each hold the vocabulary and a portion.
    """

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib
        import zlib

        v = vocabulary(path)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                out = []
                for doc, text, ids in zip(*(part.column(c).to_pylist() for c in range(2)), part.column(2), strict=True):
                    flat = ids.values.to_numpy(zero_copy_only=False).astype("<u4")
                    back = decode_ids(v, flat)
                    sha = hashlib.sha256(back.encode("utf-8")).hexdigest()
                    out.append((doc, len(flat), zlib.crc32(flat.tobytes()), sha, back == (text or "")))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_())
                columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)]
                yield pa.record_batch(columns, names=["doc_id", "n_pieces", "pieces_crc32", "text_sha256", "lossless"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from check(sample(batches))

    sample = _encode(path, theta, seed)
    schema = "doc_id long, n_pieces long, pieces_crc32 long, text_sha256 string, lossless boolean"
    return _rows(docs, id_column, text_column).mapInArrow(run, schema)
