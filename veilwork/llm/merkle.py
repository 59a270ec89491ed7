"""Merkle manifest of a dataset, with leaf coordinates from bitmap ranks.

Leaves of a group (a language) ascend by id; every ``FAN`` consecutive nodes become one, level by level, until one is
left, the group's root.  The groups' roots, ordered by group, are the leaves of the top tree.

1. **Coordinates without a sort.**  Ids of a group become bitmaps of 64 bits, one row per word that has a bit; words
   without one do not exist, so sparse ids cost no more than dense ones.  ``bit_or`` merges them with map-side
   combining.  Popcounts are summed over a directory of the words' numbers, digit by digit, so every running sum is over
   the children of one parent: 2**16 rows at most, however the ids lie.  An id's rank is the directory's count before
   its word plus the popcount of the word's lower bits.
2. **Repeated ids** count by a second ranking of the same kind, by leaf digest inside one id.  Equal leaves fill a run of
   consecutive coordinates and travel as one row with the run's length.
3. **Levels by slot arrays.**  Nodes meet by (group, coordinate / 512) in an array keyed by the slot, so a block has 512
   nodes at most, and three levels take one shuffle.  The groups' tree is the same over the groups' positions.
4. **Proofs on the way back.**  Every block hands its nodes the siblings above them, so a proof is a join on
   (group, coordinate / 512) per three levels, never one over the whole path.

All steps are DataFrame expressions; each step is a written table, so a lost executor costs one step.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilwork.functions.ordering import typed_index
from veilwork.llm.store import Workspace

FAN = 8
BLOCK = FAN**3  # nodes of a block: three levels
WORD_BITS = 6  # ids of a bitmap word: 2**6
DIGITS = (45, 29, 13, 0)  # a word's number (58 bits) is cut into digits of 13, 16, 16 and 13 bits
LEAST = -(1 << 63)
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field(value: Column) -> Column:
    """``-`` for null, else the value's UTF-8 bytes behind their count and a colon."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(values: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def ranks(keys: DataFrame, group: Sequence[str], key: str, count: str, name: str, total: str | None = None) -> DataFrame:
    """``group, key`` (one row each in ``keys``) with the sum of ``count`` over the smaller keys of the group as ``name``.

    ``key`` is a long of any sign and spread, ``group`` has no nulls.  ``total`` names a column for the group's sum.
    """
    bit = F.col(key).bitwiseAND(F.lit((1 << WORD_BITS) - 1)).cast("int")
    placed = keys.select(*group, F.col(key), F.col(count).alias("_n"), F.shiftright(key, WORD_BITS).alias("_word"), bit.alias("_bit"))
    more = F.when(F.col("_n") > 1, F.struct("_bit", (F.col("_n") - 1).alias("more")))
    words = placed.groupBy(*group, "_word").agg(
        F.bit_or(F.expr("shiftleft(1L, _bit)")).alias("_bits"),
        F.sum("_n").alias("_n"),
        F.collect_list(more).alias("_more"),  # 64 at most
    )
    for depth, digit in enumerate(DIGITS):
        words = words.withColumn(f"_d{depth}", F.shiftright("_word", digit))
    # counts of the directory's nodes, from the words up
    names = [f"_d{depth}" for depth in range(len(DIGITS))]
    nodes = [words.groupBy(*group, *names[:k]).agg(F.sum("_n").alias("_n")) for k in range(1, len(names))]
    # counts before each node, from the top down
    before = None
    for k, level in enumerate([*nodes, words], 1):
        parent = [*group, *names[: k - 1]]
        running = Window.partitionBy(*parent).orderBy(names[k - 1])
        own = F.coalesce(F.sum("_n").over(running.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
        level = level.withColumn("_own", own)
        if before is None:
            level = level.withColumn("_all", F.sum("_n").over(Window.partitionBy(*group)))
            before = level.select(*group, *names[:k], F.col("_own").alias("_before"), "_all")
            continue
        joined = level.join(before, parent)
        kept = ["_word", "_bits", "_more"] if k == len(names) else []
        before = joined.select(*group, *names[:k], *kept, (F.col("_before") + F.col("_own")).alias("_before"), "_all")
    lower = F.expr("bit_count(_bits & ~shiftleft(-1L, _bit))")
    extra = F.aggregate("_more", F.lit(0).cast("long"), lambda a, m: a + F.when(m["_bit"] < F.col("_bit"), m["more"]).otherwise(0))
    found = placed.join(before.select(*group, "_word", "_bits", "_more", "_before", "_all"), [*group, "_word"])
    sums = [F.col("_all").alias(total)] if total else []
    return found.select(*group, key, (F.col("_before") + lower + extra).alias(name), *sums)


def coordinates(space: Workspace, leaves: DataFrame) -> DataFrame:
    """``leaves(group, id, leaf, n, ...)`` with the first coordinate ``at`` of each row's run and the group's ``total``."""
    ids = space.save(leaves.groupBy("group", "id").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("kinds")), "ids")
    placed = leaves.join(ranks(ids, ["group"], "id", "n", "at", "total"), ["group", "id"])
    tied = leaves.join(ids.where("kinds > 1").select("group", "id"), ["group", "id"]).select(
        "group", "id", "leaf", "n", F.conv(F.substring("leaf", 1, 15), 16, 10).cast("long").alias("head")
    )
    heads = tied.groupBy("group", "id", "head").agg(F.sum("n").alias("n"))
    same = Window.partitionBy("group", "id", "head").orderBy("leaf").rowsBetween(Window.unboundedPreceding, -1)
    inner = (
        tied.withColumn("inside", F.coalesce(F.sum("n").over(same), F.lit(0)))
        .join(ranks(heads, ["group", "id"], "head", "n", "ahead"), ["group", "id", "head"])
        .select("group", "id", "leaf", (F.col("ahead") + F.col("inside")).alias("later"))
    )
    later = space.save(inner, "repeated")
    return placed.join(later, ["group", "id", "leaf"], "left").withColumn("at", F.col("at") + F.coalesce("later", F.lit(0))).drop("later")


def _parents(nodes: Column, done: Column) -> Column:
    """One level up; a single last node stays as it is."""
    runs = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / FAN).cast("int")),
        lambda i: F.sha2(F.array_join(F.slice(nodes, i * FAN + 1, FAN), ""), 256),
    )
    return F.when(done & (F.size(nodes) == 1), nodes).otherwise(runs)


def climb(space: Workspace, blocks: DataFrame, name: str) -> list[DataFrame]:
    """Written tables of ``blocks(group, block, total, l0, ...)``, one per three levels, until each group has one node."""
    steps = []
    while True:
        done = F.col("total") <= BLOCK
        built = blocks
        for level in range(3):
            built = built.withColumn(f"l{level + 1}", _parents(F.col(f"l{level}"), done))
        steps.append(space.save(built.withColumn("top", F.get("l3", F.lit(0))).drop("l3"), f"{name}-{len(steps)}"))
        rest = steps[-1].where(~done)
        if rest.isEmpty():
            return steps
        slots = F.struct(F.pmod("block", F.lit(BLOCK)).alias("slot"), "top")
        blocks = (
            rest.groupBy("group", F.floor(F.col("block") / BLOCK).alias("block"))
            .agg(F.max(F.ceil(F.col("total") / BLOCK)).alias("total"), F.array_sort(F.collect_list(slots)).alias("slots"))
            .select("group", "block", "total", F.col("slots.top").alias("l0"))
        )


def _siblings(nodes: Sequence[Column], slot: Column, done: Column) -> Column:
    """Left and right siblings of a node of a block, one entry per level that hashes."""
    levels = []
    for level, row in enumerate(nodes):
        at = F.floor(slot / FAN**level).cast("int")
        inside = (at % FAN).cast("int")
        left = F.array_join(F.slice(row, at - inside + 1, inside), "")
        right = F.array_join(F.slice(row, at + 2, FAN - 1 - inside), "")
        levels.append(F.when(~(done & (F.size(row) == 1)), F.struct(left.alias("left"), right.alias("right"))))
    return F.filter(F.array(*levels), lambda x: x.isNotNull())


def descend(space: Workspace, steps: list[DataFrame], above: DataFrame, name: str) -> DataFrame:
    """The first step's blocks with ``path``, the siblings from the block's top to the root, and ``tree``, the group's root.

    ``above(group, path, ...)`` has the siblings over each group; its other columns are handed down.
    """
    extra = [c for c in above.columns if c not in ("group", "path")]
    done, upper = F.col("total") <= BLOCK, None
    for k in reversed(range(len(steps))):
        placed = steps[k].where(done).withColumn("tree", F.col("top")).join(above, "group")
        if upper is not None:
            below = steps[k].where(~done).withColumn("_block", F.floor(F.col("block") / BLOCK)).join(upper, ["group", "_block"])
            nodes = [F.col(f"_l{level}") for level in range(3)]
            own = _siblings(nodes, F.pmod("block", F.lit(BLOCK)), F.col("_total") <= BLOCK)
            placed = placed.unionByName(below.withColumn("path", F.concat(own, "_path")).select(*placed.columns))
        if k:
            here = [F.col(c).alias(f"_{c}") for c in ("block", "total", "path", "l0", "l1", "l2")]
            upper = space.save(placed.select("group", *here, "tree", *extra), f"{name}-{k}")
    return placed


def _top_tree(space: Workspace, roots: DataFrame) -> DataFrame:
    """``group, path, root`` for the groups' roots ``group, top``, in the groups' order."""
    total = roots.count()
    numbered = space.save(typed_index(roots, ["group"], name="at"), "groups")
    slots = F.struct(F.pmod("at", F.lit(BLOCK)).alias("slot"), "top", F.col("group").alias("name"))
    blocks = (
        numbered.groupBy(F.floor(F.col("at") / BLOCK).alias("block"))
        .agg(F.array_sort(F.collect_list(slots)).alias("slots"))
        .select(F.lit("").alias("group"), "block", F.lit(total).cast("long").alias("total"), F.col("slots.top").alias("l0"), "slots")
    )
    empty = F.from_json(F.lit("[]"), "array<struct<left string, right string>>")
    over = roots.sparkSession.range(1).select(F.lit("").alias("group"), empty.alias("path"))
    whole = descend(space, climb(space, blocks, "top"), over, "top-path").select("*", F.explode("slots").alias("own"))
    path = F.concat(_siblings([F.col(f"l{i}") for i in range(3)], F.col("own.slot"), F.col("total") <= BLOCK), "path")
    return space.save(whole.select(F.col("own.name").alias("group"), path.alias("path"), F.col("tree").alias("root")), "top-paths")


def manifest(
    docs: DataFrame,
    claimed: Column | None = None,
    text_column: str = "text",
    id_column: str = "doc_id",
    group_column: str = "lang",
    fields: Sequence[str] = FIELDS,
) -> DataFrame:
    """One row per input row: ``doc_id, position, leaf, subroot, root, proof_sha256, folded_root, verified``.

    A leaf is the sha256 of ``fields``; ``position`` is its coordinate among its group's leaves.  ``claimed`` is another
    content of ``text_column`` to be verified against the manifest: ``folded_root`` is recomputed from it and the
    original siblings, and equals ``root`` exactly when the content is the recorded one (null means not changed).

    Null ids come first within a group, the null group comes first among groups.  Rows with one id are ordered by leaf;
    equal rows get neighbouring coordinates.  An empty table gives no rows.  Texts of any length count as a whole;
    columns that are not in ``fields`` are not read, whatever their names.
    """
    space = Workspace(docs.sparkSession, "merkle")
    name = lambda c: F.col(f"`{c}`")
    values = {c: name(c) for c in fields}
    leaf = leaf_digest(list(values.values()))
    other = F.lit(None).cast("string")
    if claimed is not None:
        changed = claimed.isNotNull() & ~claimed.eqNullSafe(name(text_column))
        other = F.when(changed, leaf_digest(list((values | {text_column: claimed}).values())))
    rows = docs.select(
        F.coalesce(F.concat(F.lit("+"), name(group_column).cast("string")), F.lit("")).alias("group"),
        F.coalesce(name(id_column).cast("long"), F.lit(LEAST)).alias("id"),
        name(id_column).cast("long").alias("doc_id"),
        leaf.alias("leaf"),
        other.alias("other"),
    )
    leaves = space.save(
        rows.groupBy("group", "id", "doc_id", "leaf").agg(F.min("other").alias("other"), F.count(F.lit(1)).alias("n")), "leaves"
    )
    base = F.col("block") * BLOCK
    run = F.struct(
        (F.greatest("at", base) - base).cast("int").alias("first"),
        (F.least(F.col("at") + F.col("n"), base + BLOCK) - base - 1).cast("int").alias("last"),
        "doc_id", "leaf", "other",
    )
    touched = F.sequence(F.floor(F.col("at") / BLOCK), F.floor((F.col("at") + F.col("n") - 1) / BLOCK))
    blocks = (
        coordinates(space, leaves)
        .withColumn("block", F.explode(touched))
        .groupBy("group", "block")
        .agg(F.max("total").alias("total"), F.array_sort(F.collect_list(run)).alias("runs"))
    )
    each = F.transform("runs", lambda r: F.array_repeat(r["leaf"], r["last"] - r["first"] + 1))
    steps = climb(space, blocks.withColumn("l0", F.flatten(each)), "tree")
    done = F.col("total") <= BLOCK
    roots = space.save(_union([step.where(done).select("group", "top") for step in steps]), "roots")
    whole = descend(space, steps, _top_tree(space, roots), "path")
    slots = F.flatten(
        F.transform(
            "runs",
            lambda r: F.transform(
                F.sequence(r["first"], r["last"]),
                lambda s: F.struct(s.alias("slot"), r["doc_id"].alias("doc_id"), r["leaf"].alias("leaf"), r["other"].alias("other")),
            ),
        )
    )
    nodes = [F.col(f"l{level}") for level in range(3)]
    placed = F.transform(slots, lambda e: F.struct(e.alias("e"), F.concat(_siblings(nodes, e["slot"], done), F.col("path")).alias("path")))
    fold = lambda x: F.aggregate(
        x["path"],
        F.coalesce(x["e"]["other"], x["e"]["leaf"]),
        lambda acc, p: F.sha2(F.concat(p["left"], acc, p["right"]), 256),
    )
    proof = lambda x: F.sha2(F.array_join(F.transform(x["path"], lambda p: F.concat(p["left"], p["right"])), ""), 256)
    made = F.transform(
        placed,
        lambda x: F.struct(
            x["e"]["doc_id"].alias("doc_id"),
            (base + x["e"]["slot"]).alias("position"),
            x["e"]["leaf"].alias("leaf"),
            proof(x).alias("proof_sha256"),
            fold(x).alias("folded_root"),
        ),
    )
    return whole.select("tree", "root", F.inline(made)).select(
        "doc_id", "position", "leaf", F.col("tree").alias("subroot"), "root", "proof_sha256", "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def _union(frames: Sequence[DataFrame]) -> DataFrame:
    whole = frames[0]
    for frame in frames[1:]:
        whole = whole.unionByName(frame)
    return whole


def lowered_where(condition: Column, text_column: str = "text") -> Column:
    """The tampering of the query: A-Z lower-cased where ``condition`` holds."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(condition, F.translate(F.col(text_column), letters, letters.lower()))
