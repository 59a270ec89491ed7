"""Exact set-similarity join on word n-grams with prefix trees.

Sets are compared only inside families.  For a pair that reaches the threshold the symmetric difference has at
most D elements (D follows from the sizes), so when elements are dealt by hash to more than D parts, one part is
equal in both.  Every set gives a signature per part; sets with an equal signature belong to one family.

* Shingles of passages that many texts share are left out of the parts where the others suffice; else a part of one
  common shingle would make one family of all texts that have the passage.
* Rows with equal signatures inside a map task are linked there, and only the least one goes on, so a signature
  of a third of all rows is a row per map task after that.  Signatures travel as packed arrays per bucket.
* Copies (equal sets) are one node throughout.
* A family is cut into chunks of bounded size, ordered by set size; chunk pairs whose sizes can reach the threshold
  are joined in tasks of their own.  There, one chunk is a path-compressed trie of its sets, in one order of all
  elements (frequent first, so near copies share long paths).  A probing set walks the trie with the overlap of the
  path so far, shared by all sets below, and leaves a subtree when its remaining lengths cannot reach the threshold.
* A pair already connected inside the task is not counted again; no link between components is lost.
* Elements are dealt to the pairs of chunks once; where pairs of a large family repeat them more than twice, the pairs
  are joined in rounds that hold about as much as all sets together, so disk does not grow with a family's square.
* Tables and shuffle files go as soon as they are read for the last time.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilwork.llm.graph import components
from veilwork.llm.store import Workspace, freed_shuffles
from veilwork.llm.text import mix, portions, shingles, signed, words

CELL_BITS = 20
SLICES = 64  # of the cells
SET = "doc_id long, n long, node long, check long"


def _fingerprint(s: np.ndarray) -> tuple[int, int]:
    """Two 64-bit sums over the set's elements; equal sets have equal ones."""
    if not len(s):
        return 0, 0
    a = np.add.reduce(mix(s ^ np.uint64(0x5851F42D4C957F2D)))
    b = np.add.reduce(mix(s + np.uint64(0x14057B7EF767814F)))
    pair = mix(np.array([a + np.uint64(len(s)), b ^ np.uint64(len(s))], np.uint64)).view(np.int64)
    return int(pair[0]), int(pair[1])


def _sets(batches: Iterator[pa.RecordBatch], size: int):
    """Id, set and fingerprint of every row."""
    for batch in batches:
        for rows, texts in portions(batch, "text", 1 << 20):
            hashes, at = words(texts)
            for i, doc in enumerate(rows.column(0).to_pylist()):
                s = shingles(hashes[at[i] : at[i + 1]], size)
                yield doc, s, _fingerprint(s)


def _describe(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for doc, s, (node, check) in _sets(batches, size):
            rows.append((doc, len(s), node, check))
            if len(rows) == 20_000:
                yield _batch(rows)
                rows = []
        if rows:
            yield _batch(rows)

    def _batch(rows):
        return pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["doc_id", "n", "node", "check"])

    return run


class Classes:
    """Size classes: the smaller set of a pair also signs in the class of the larger one."""

    def __init__(self, threshold: Fraction):
        self.t = threshold
        self.bounds = [1]

    def of(self, n: int) -> int:
        while self.bounds[-1] <= n:
            self.bounds.append(max(self.bounds[-1] + 1, self.bounds[-1] * 5 // 4))
        return int(np.searchsorted(self.bounds, n, "right")) - 1

    def for_size(self, n: int) -> range:
        return range(self.of(n), self.of(int(n / self.t)) + 1)

    def parts(self, c: int, n: int) -> tuple[int, int]:
        """Parts of class ``c``, and how many of them a set of ``n`` elements may differ in from one of the class."""
        largest = self.bounds[c + 1] - 1
        most = int(2 * largest * (1 - self.t) / (1 + self.t))
        return most + 1 + (most + 9) // 10, int((n + largest) * (1 - self.t) / (1 + self.t))

    def _parts(self, s: np.ndarray, c: int, m: int, most: int, tag: int) -> tuple[np.ndarray, bool]:
        """Signatures of the non-empty parts of ``s``, and whether they are more than a pair can differ in."""
        part = (mix(s + np.uint64(c)) % np.uint64(m)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        here, first = np.unique(part[order], return_index=True)
        sums = np.zeros(m, np.uint64)
        if len(here):
            sums[here] = np.add.reduceat(mix(s[order] ^ np.uint64(0xA0761D6478BD642F)), first)
        enough = len(here) > most
        chosen = here if enough or not tag else np.arange(m)
        label = chosen.astype(np.uint64) * np.uint64(65536) + np.uint64(c + (tag << 48))
        return mix(sums[chosen] * np.uint64(0xE7037ED1A0B428DB) + label), enough

    def signatures(self, s: np.ndarray, common: np.ndarray | None = None) -> np.ndarray:
        """Signatures over the elements that are not common, and over all elements where those do not suffice.

        A pair differs in at most D elements; each set knows a bound of D from its own size and the class's largest.
        If either set has more non-empty parts of uncommon elements than its bound, one of them is equal in the other
        set, which signs it, too.  If neither has, both sign their whole sets: non-empty parts if more than the bound,
        else all parts.  ``common`` may hold any elements, the same for all sets.
        """
        out = []
        rare = s if common is None else s[~common[(s >> np.uint64(64 - CELL_BITS)).astype(np.int64)]]
        for c in self.for_size(len(s)):
            m, most = self.parts(c, len(s))
            signed_parts, enough = self._parts(rare, c, m, most, 0)
            out.append(signed_parts)
            if not enough:
                out.append(self._parts(s, c, m, most, 1)[0])
        return np.concatenate(out)


def _cells(size: int):
    """How many sets of a task have an element in each cell of hashes, one packed row per slice of cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen = np.zeros(1 << CELL_BITS, np.int32), set()
        for _, s, (node, _) in _sets(batches, size):
            if node not in seen:
                seen.add(node)
                np.add.at(counts, (s >> np.uint64(64 - CELL_BITS)).astype(np.int64), 1)
        if seen:
            packed = [part.tobytes() for part in np.split(counts, SLICES)]
            yield pa.record_batch([pa.array(np.arange(SLICES), pa.int32()), pa.array(packed, pa.binary())], names=["slice", "counts"])

    return run


def _flags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Flags of the cells of each slice that are far above the slice's median; the rows of a slice follow each other."""
    now, counts = None, None

    def row() -> pa.RecordBatch:
        typical = float(np.median(counts))
        flags = np.packbits(counts > typical + 4 * np.sqrt(typical) + 4)
        return pa.record_batch([pa.array([now], pa.int32()), pa.array([flags.tobytes()], pa.binary())], names=["slice", "flags"])

    for batch in batches:
        for which, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if which != now:
                if now is not None:
                    yield row()
                now, counts = which, np.zeros((1 << CELL_BITS) // SLICES, np.int64)
            counts += np.frombuffer(packed, np.int32)
    if now is not None:
        yield row()


def common_cells(narrow: DataFrame, size: int) -> np.ndarray:
    """Cells far above the median: they hold shingles of passages that many texts share."""
    slices = narrow.mapInArrow(_cells(size), "slice int, counts binary").repartition(SLICES, "slice").sortWithinPartitions("slice")
    with freed_shuffles(narrow.sparkSession):
        flags = sorted(slices.mapInArrow(_flags, "slice int, flags binary").collect())  # a bit per cell
    return np.concatenate([np.unpackbits(np.frombuffer(row["flags"], np.uint8)) for row in flags]).astype(bool)


def _stars(sig: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Least node of each signature, and (least, other) edges; equal rows count once."""
    order = np.lexsort((node, sig))
    sig, node = sig[order], node[order]
    fresh = np.ones(len(sig), bool)
    fresh[1:] = (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])
    sig, node = sig[fresh], node[fresh]
    lead = np.ones(len(sig), bool)
    lead[1:] = sig[1:] != sig[:-1]
    hub = node[np.flatnonzero(lead)][np.cumsum(lead) - 1] if len(sig) else node
    edges = np.unique(np.stack([hub[~lead], node[~lead]], 1), axis=0) if (~lead).any() else np.zeros((0, 2), np.int64)
    return sig[lead], node[lead], edges[:, 0], edges[:, 1]


def _sign(size: int, threshold: Fraction, buckets: int, common, most: int = 500_000):
    """Packed (signature, node) pairs per bucket, combined per map task; an edge is a signature of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, sigs, nodes, held, seen = Classes(threshold), [], [], 0, set()

        def flush() -> pa.RecordBatch:
            sig, node, hub, other = _stars(np.concatenate(sigs), np.concatenate(nodes))
            link = mix(mix(hub.view(np.uint64)) + other.view(np.uint64))
            sig, node = np.concatenate([sig, link, link]), np.concatenate([node, hub, other])
            bucket = (sig % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            packed = np.stack([sig[order].view(np.int64), node[order]], 1)
            return pa.record_batch(
                [
                    pa.array(np.arange(buckets), pa.int32()),
                    pa.array([packed[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()),
                ],
                names=["bucket", "pairs"],
            )

        for _, s, (node, _) in _sets(batches, size):
            if not len(s) or node in seen:
                continue
            seen.add(node)
            sig = classes.signatures(s, common.value)
            sigs.append(sig)
            nodes.append(np.full(len(sig), node, np.int64))
            held += len(sig)
            if held > most:
                yield flush()
                sigs, nodes, held = [], [], 0
        if held:
            yield flush()

    return run


def _match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of the signatures of each bucket; the rows of a bucket follow each other."""
    bucket, blobs = None, []

    def edges() -> pa.RecordBatch:
        pairs = np.concatenate([np.frombuffer(x, np.int64).reshape(-1, 2) for x in blobs])
        _, _, hub, other = _stars(pairs[:, 0].view(np.uint64), pairs[:, 1])
        return pa.record_batch([pa.array(hub), pa.array(other)], names=["u", "v"])

    for batch in batches:
        for b, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if b != bucket and blobs:
                yield edges()
                blobs = []
            bucket = b
            blobs.append(blob)
    if blobs:
        yield edges()


class Trie:
    """Path-compressed trie over arrays of element ranks; a node has a run of ranks, children by first rank."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets = sets
        self.root = self._build(sorted(range(len(sets)), key=lambda i: sets[i].tolist()), 0)

    def _build(self, members: list[int], depth: int):
        """(run, leaves, children, sizes below: least and largest, depth behind the run); members are in order."""
        first, last = self.sets[members[0]], self.sets[members[-1]]
        most = min(len(first), len(last))
        same = first[depth:most] == last[depth:most]
        end = depth + (len(same) if same.all() else int(np.argmin(same)))
        leaves = [i for i in members if len(self.sets[i]) == end]
        rest = [i for i in members if len(self.sets[i]) > end]
        children, begin = [], 0
        for at in range(1, len(rest) + 1):
            if at == len(rest) or self.sets[rest[at]][end] != self.sets[rest[begin]][end]:
                children.append((rest[begin:at], end))
                begin = at
        sizes = [len(self.sets[i]) for i in members]
        return [first[depth:end], leaves, children, min(sizes), max(sizes), end]

    def walk(self, probe: np.ndarray, has: np.ndarray, need, visit) -> None:
        """Leaves whose overlap with ``probe`` reaches ``need``; ``has`` is all false before and after."""
        has[probe] = True
        n = len(probe)
        stack = [(self.root, 0)]
        while stack:
            node, overlap = stack.pop()
            run, leaves, children, least, largest, end = node
            overlap += int(has[run].sum())
            for leaf in leaves:
                if overlap >= need(n, end):
                    visit(leaf)
            if not children:
                continue
            last = int(run[-1]) if len(run) else -1
            left = n - int(np.searchsorted(probe, last, "right"))  # elements of the probing set that come later in the order
            if overlap + min(left, largest - end) < need(n, max(least, end + 1)):
                continue
            for k, child in enumerate(children):
                if isinstance(child, tuple):  # built when first reached
                    child = children[k] = self._build(*child)
                stack.append((child, overlap))
        has[probe] = False


def join_sets(left: list[np.ndarray], right: list[np.ndarray] | None, threshold: Fraction) -> list[tuple[int, int]]:
    """Links that connect all sets whose Jaccard similarity reaches the threshold; ``right`` None: within ``left``.

    Positions count through ``left`` and then ``right``.  A pair that earlier links connect is left out.
    """
    every = left + (right or [])
    values, counts = np.unique(np.concatenate(every), return_counts=True)
    rank = np.empty(len(values), np.int64)
    rank[np.argsort(-counts, kind="stable")] = np.arange(len(values))
    ranked = [np.sort(rank[np.searchsorted(values, s)]) for s in every]
    a, b = threshold.numerator, threshold.denominator

    def need(n: int, m: int) -> int:
        return -(-a * (n + m) // (a + b))

    parent = list(range(len(every)))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    trie, links = Trie(ranked[: len(left)]), []
    has = np.zeros(len(values), bool)
    for i in range(len(left) if right is not None else 0, len(every)):

        def visit(leaf: int, i=i) -> None:
            if leaf != i and find(leaf) != find(i):
                parent[find(leaf)] = find(i)
                links.append((leaf, i))

        trie.walk(ranked[i], has, need, visit)
    return links


def _verify(threshold: Fraction):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["left", "node", "check"], ascending=[False, True, True])
        sets = [np.frombuffer(x, np.uint64) for x in frame["elements"]]
        cut = int(frame["left"].sum())
        links = join_sets(sets[:cut], sets[cut:] or None, threshold)
        ids = frame["set_id"].to_numpy()
        return pd.DataFrame(
            {"u": ids[[x for x, _ in links]], "v": ids[[y for _, y in links]]} if links else {"u": [], "v": []}, dtype="int64"
        )

    return run


def jaccard_components(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    size: int = 5,
    threshold: Fraction = Fraction(8, 10),
    chunk_elements: int = 1 << 20,
    chunk_sets: int = 1024,
    broadcast_rows: int = 2_000_000,
    round_elements: int = 1 << 25,
) -> DataFrame:
    """One row per input row: ``doc_id, n_shingles, component_id`` (least id reachable by links, itself included).

    Words are split at white space after lower-casing A-Z; a set is the distinct ``size``-word shingles (64-bit
    hashes), of a shorter text its whole word sequence.  Null, empty and blank texts have an empty set, are linked
    with nothing and are their own component.  A row without an id takes part in links; its component is the least
    id reachable, null if there is none.  Rows with equal ids and different texts have one component each.
    """
    space = Workspace(docs.sparkSession, "jaccard")
    spark = docs.sparkSession
    narrow = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))
    described = space.save(narrow.mapInArrow(_describe(size), SET), "described")
    total = described.agg(F.sum("n")).first()[0] or 0
    if not total:
        return described.select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))

    # Families: sets that share a signature, directly or through others.
    buckets = max(16, total // 1_000_000)  # about 9 MB of pairs each, five times that while they are sorted
    common = spark.sparkContext.broadcast(common_cells(narrow, size))  # one flag per cell
    signed_sets = narrow.mapInArrow(_sign(size, threshold, buckets, common), "bucket int, pairs binary")
    dealt = signed_sets.repartition(buckets, "bucket").sortWithinPartitions("bucket")
    edges = space.save(dealt.mapInArrow(_match, "u long, v long"), "edges")
    families = components(edges, space, "families")

    # One representative per set and family, its elements, and chunks of bounded size within a family.
    nodes = described.where("n > 0").groupBy("node", "check", "n").agg(F.min("doc_id").alias("doc_id"))
    members = nodes.join(families, "node").withColumn("set_id", F.xxhash64("node", "check"))
    members = space.save(members.select("node", "check", "n", "doc_id", "set_id", F.col("component").alias("family")), "members")
    space.drop("edges")
    wanted = members.select(F.col("doc_id").alias("id")).distinct()
    held, all_elements = members.agg(F.count(F.lit(1)), F.sum("n")).first()
    own = F.broadcast(wanted) if held <= broadcast_rows else wanted
    texts = narrow.join(own, narrow["id"].eqNullSafe(own["id"]), "left_semi")
    elements = texts.mapInArrow(_elements(size), "node long, check long, elements binary")
    elements = elements.groupBy("node", "check").agg(F.first("elements").alias("elements"))

    # Chunks by running size inside the family; the offsets come from a histogram of sizes, so no family is one task.
    histogram = members.groupBy("family", "n").agg(F.count(F.lit(1)).alias("sets"))
    by_size = "PARTITION BY family ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    cells = histogram.selectExpr(
        "family",
        "n",
        "sets",
        f"floor((sum(sets) OVER ({by_size}) - sets) / {chunk_sets})"
        f" + floor((sum(sets * n) OVER ({by_size}) - sets * n) / {chunk_elements}) AS chunk_base",
        f"greatest(1, ceil(sets / {chunk_sets}), ceil(sets * n / {chunk_elements})) AS split",
    )
    chunk = F.struct(F.col("chunk_base"), F.when(F.col("split") > 1, F.struct("n", F.pmod("set_id", F.col("split")).alias("k"))).alias("part"))
    placed = members.join(cells, ["family", "n"]).select("node", "check", "set_id", "family", "n", chunk.alias("chunk"))
    placed = space.save(placed.withColumn("chunk", F.xxhash64("chunk")), "placed")
    chunks = placed.groupBy("family", "chunk").agg(
        F.min("n").alias("low"), F.max("n").alias("high"), F.count(F.lit(1)).alias("sets"), F.sum("n").alias("elements")
    )
    chunks = space.save(chunks, "chunks")
    one, two = chunks.alias("a"), chunks.alias("b")
    a, b = threshold.numerator, threshold.denominator
    tasks = one.join(
        two,
        (F.col("a.family") == F.col("b.family"))
        & (F.struct("a.low", "a.chunk") <= F.struct("b.low", "b.chunk"))
        & (F.col("a.high") * b >= F.col("b.low") * a)
        & ((F.col("a.chunk") != F.col("b.chunk")) | (F.col("a.sets") > 1)),
    ).select(
        F.col("a.family").alias("family"),
        F.col("a.chunk").alias("one"),
        F.col("b.chunk").alias("two"),
        (F.col("a.elements") + F.when(F.col("a.chunk") == F.col("b.chunk"), 0).otherwise(F.col("b.elements"))).alias("elements"),
    )
    tasks = space.save(tasks, "tasks")
    repeated, least = tasks.agg(F.sum("elements")).first()[0] or 0, max(all_elements or 0, round_elements)
    rounds = 1 if repeated <= 2 * least else math.ceil(repeated / least)
    if rounds > 1:
        elements = space.save(elements, "sets")
    sides = tasks.select("family", "one", "two", F.explode(F.array_distinct(F.array("one", "two"))).alias("chunk"))
    links = []
    for k in range(rounds):
        now = sides.where(F.pmod(F.xxhash64("family", "one", "two"), F.lit(rounds)) == k)
        now = now.join(placed, ["family", "chunk"]).select(
            "family", "one", "two", (F.col("chunk") == F.col("one")).alias("left"), "node", "check", "set_id"
        )
        pairs = now.join(elements, ["node", "check"]).groupBy("family", "one", "two")
        links.append(space.save(pairs.applyInPandas(_verify(threshold), "u long, v long"), f"links{k}"))
    for spent in ("members", "placed", "chunks", "tasks", "sets")[: 5 if rounds > 1 else 4]:
        space.drop(spent)

    # Components of sets, then the least id of all rows of a component.
    linked = components(reduce(DataFrame.unionByName, links), space, "linked")
    named = nodes.withColumn("set_id", F.xxhash64("node", "check")).join(
        linked.withColumnRenamed("node", "set_id"), "set_id", "left"
    )
    named = named.select("node", "check", "n", "doc_id", F.coalesce("component", "set_id").alias("component"))
    named = space.save(named, "named")
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    final = space.save(named.join(least, "component").select("node", "check", "n", "component_id"), "final")
    space.drop("named")
    full_rows = described.where("n > 0").join(final, ["node", "check", "n"])
    empty = described.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return full_rows.select("doc_id", F.col("n").alias("n_shingles"), "component_id").unionByName(empty)


def _elements(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, out = set(), []
        held = 0

        def flush() -> pa.RecordBatch:
            a, b, c = zip(*out, strict=True)
            return pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.binary())], names=["node", "check", "elements"])

        for _, s, (node, check) in _sets(batches, size):
            if not len(s) or (node, check) in seen:
                continue
            seen.add((node, check))
            out.append((node, check, signed(s).tobytes()))
            held += 8 * len(s)
            if held > 8 << 20:
                yield flush()
                out, held = [], 0
        if out:
            yield flush()

    return run


def keep_one(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` whose id is the least of their component, all columns.

    Rows without an id stay; rows that share an id stay or go together.
    """
    verdict = jaccard_components(docs, id_column, text_column, **how)
    gone = verdict.where("doc_id <> component_id").select(F.col("doc_id").alias("gone")).distinct()
    return docs.join(gone, docs[id_column].cast("long") == gone["gone"], "left_anti")
