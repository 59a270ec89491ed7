"""Graph operators over edge tables: schema graphs and any larger relation."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilwork.functions import draws
from veilwork.session import cut_lineage


def schema_graph(columns: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes for tables and columns; edges HAS_COLUMN and RELATES_TO (all foreign keys)."""
    column_id = F.concat_ws(".", "table_name", "column_name")
    nodes = (
        columns.select(F.col("table_name").alias("node"), F.lit("table").alias("node_type"))
        .distinct()
        .unionByName(columns.select(column_id.alias("node"), F.lit("column").alias("node_type")))
    )
    links = columns.select(
        F.col("table_name").alias("source"),
        column_id.alias("target"),
        F.lit("HAS_COLUMN").alias("edge_type"),
        F.lit(None).cast("string").alias("via"),
    ).unionByName(
        edges.select(
            F.col("source_table").alias("source"),
            F.col("target_table").alias("target"),
            F.lit("RELATES_TO").alias("edge_type"),
            F.concat_ws("->", "source_column", "target_column").alias("via"),
        )
    )
    return nodes, links


def neighbors(edges: DataFrame, source: str = "source", target: str = "target") -> DataFrame:
    """(node, neighbor, direction): every edge seen from both of its ends."""
    out = edges.select(F.col(source).alias("node"), F.col(target).alias("neighbor"), F.lit("out").alias("direction"))
    back = edges.select(F.col(target).alias("node"), F.col(source).alias("neighbor"), F.lit("in").alias("direction"))
    return out.unionByName(back).distinct()


def reachable(edges: DataFrame, starts: DataFrame, hops: int = 3, source: str = "source", target: str = "target") -> DataFrame:
    """(start, node, distance) along the edges, for all starts at once.

    Nodes up to ``hops`` steps away are expanded, so the result reaches one step
    further; the start itself appears only when a cycle leads back to it.
    ``starts`` has one column, ``start``.
    """
    links = edges.select(F.col(source).alias("_from"), F.col(target).alias("node")).distinct()
    frontier = starts.select("start", F.col("start").alias("node")).distinct()
    found = None
    for distance in range(1, hops + 2):
        step = (
            frontier.withColumnRenamed("node", "_from")
            .join(links, "_from")
            .select("start", "node")
            .distinct()
        )
        if found is not None:
            step = step.join(found, ["start", "node"], "left_anti")
        step = cut_lineage(step.withColumn("distance", F.lit(distance)))
        found = step if found is None else found.unionByName(step)
        frontier = step.select("start", "node").where(F.col("node") != F.col("start"))
    return found


def focus(edges: DataFrame, starts: DataFrame, hops: int = 1, source: str = "source", target: str = "target"):
    """Nodes within ``hops`` undirected steps of any start, and the edges among them."""
    both = neighbors(edges, source, target).select("node", "neighbor").distinct()
    kept = starts.select(F.col("start").alias("node")).distinct()
    frontier = kept
    for _ in range(hops):
        step = (
            both.join(frontier, "node")
            .select(F.col("neighbor").alias("node"))
            .distinct()
            .join(kept, "node", "left_anti")
        )
        frontier = cut_lineage(step)
        kept = kept.unionByName(frontier)
    inside = edges.join(kept.select(F.col("node").alias(source)), source, "left_semi").join(
        kept.select(F.col("node").alias(target)), target, "left_semi"
    )
    return kept, inside


def dependency_levels(edges: DataFrame, nodes: DataFrame, source: str = "source", target: str = "target") -> DataFrame:
    """(node, level, cyclic): parents (targets) have lower levels than their children.

    Each round levels the nodes whose parents all have a level.  Members of a
    cycle, and what depends on them, end on the last level, marked ``cyclic``.
    """
    waiting = (
        edges.select(F.col(source).alias("node"), F.col(target).alias("parent"))
        .where(F.col("node") != F.col("parent"))
        .distinct()
        .join(nodes.select("node"), "node", "left_semi")
        .join(nodes.select(F.col("node").alias("parent")), "parent", "left_semi")
    )
    waiting = cut_lineage(waiting)
    open_nodes = nodes.select("node").distinct()
    done, level = None, 0
    while True:
        ready = open_nodes.join(waiting, "node", "left_anti").select("node", F.lit(level).alias("level"))
        ready = cut_lineage(ready)
        if ready.isEmpty():
            break
        done = ready if done is None else done.unionByName(ready)
        waiting = cut_lineage(
            waiting.join(ready.select(F.col("node").alias("parent")), "parent", "left_anti")
        )
        open_nodes = cut_lineage(open_nodes.join(ready.select("node"), "node", "left_anti"))
        level += 1
    rest = open_nodes.select("node", F.lit(level).alias("level"), F.lit(True).alias("cyclic"))
    if done is None:
        return rest
    return done.withColumn("cyclic", F.lit(False)).unionByName(rest)


def components(edges: DataFrame, nodes: DataFrame, source: str = "source", target: str = "target") -> DataFrame:
    """(node, component): the smallest node each node is connected to.

    Alternates two steps on the edges, each a grouped minimum: join every larger
    neighbour to the smallest one, then every smaller neighbour likewise.  This
    needs about log(n) rounds, however long the chains are.
    """

    def smallest_neighbor(pairs: DataFrame) -> DataFrame:
        return pairs.groupBy("u").agg(F.min("v").alias("_m")).select("u", F.least("u", "_m").alias("_m"))

    current = cut_lineage(
        edges.select(F.col(source).alias("u"), F.col(target).alias("v")).where("u <> v").distinct()
    )
    while True:  # until a round changes nothing
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (
            both.join(smallest_neighbor(both), "u")
            .where("v > u")
            .select(F.col("v").alias("u"), F.col("_m").alias("v"))
            .where("u <> v")
            .distinct()
        )
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        least = down.groupBy("u").agg(F.min("v").alias("_m"))
        moved = down.join(least, "u").where("v <> _m").select("v", "_m")
        small = (
            least.select("u", F.col("_m").alias("v"))
            .unionByName(moved.select(F.col("v").alias("u"), F.col("_m").alias("v")))
            .where("u <> v")
            .distinct()
        )
        following = cut_lineage(small)
        changed = following.exceptAll(current).isEmpty() and following.count() == current.count()
        current = following
        if changed:
            break
    labels = current.groupBy("u").agg(F.min("v").alias("component"))
    return (
        nodes.select("node")
        .distinct()
        .join(labels.withColumnRenamed("u", "node"), "node", "left")
        .select("node", F.coalesce("component", "node").alias("component"))
    )


def _moves_apart(best: DataFrame) -> DataFrame:
    """Moves that gain and are the best of both the community they leave and the one they join."""
    gaining = best.where(F.col("_more") > 0)
    rank = F.struct(-F.col("_more"), F.col("node"))
    touched = gaining.select("node", "_more", F.explode(F.array("community", "_best")).alias("_touched"))
    first = touched.groupBy("_touched").agg(F.min(rank)["node"].alias("node"))
    both = first.groupBy("node").agg(F.count(F.lit(1)).alias("_n")).where("_n = 2").select("node")
    return gaining.join(both, "node", "left_semi")


def communities(
    edges: DataFrame, nodes: DataFrame, rounds: int | None = None, source: str = "source", target: str = "target"
) -> DataFrame:
    """(node, community) by moving nodes to the neighbouring community of best modularity gain.

    All nodes of one half (by keyed hash) move at the same time, then the other
    half, so two neighbours do not swap for ever.  Ties go to the smaller label.
    Deterministic; ends when no node moves in two half rounds.  Neighbours within
    a half can still move in a cycle.  Once a state comes back, only moves that
    gain and share no community with a better one are made: their gains add up,
    so modularity grows with every step and the run ends.  ``rounds`` ends it
    sooner, with the labels reached by then.
    """
    weighted = (
        edges.select(F.least(source, target).alias("a"), F.greatest(source, target).alias("b"))
        .where("a <> b")
        .groupBy("a", "b")
        .agg(F.lit(1.0).alias("w"))
    )
    links = cut_lineage(
        weighted.select(F.col("a").alias("node"), F.col("b").alias("other"), "w").unionByName(
            weighted.select(F.col("b").alias("node"), F.col("a").alias("other"), "w")
        )
    )
    degree = links.groupBy("node").agg(F.sum("w").alias("k"))
    two_m = links.agg(F.sum("w")).scalar()
    state = cut_lineage(
        nodes.select("node")
        .distinct()
        .join(degree, "node", "left")
        .select("node", F.coalesce("k", F.lit(0.0)).alias("k"), F.col("node").cast("string").alias("community"))
    )
    still, turn, seen, apart = 0, 0, set(), False
    while still < 2 and (rounds is None or turn < 2 * rounds):
        totals = state.groupBy("community").agg(F.sum("k").alias("_tot"))
        half = F.pmod(draws.order_key("half", F.col("node")), F.lit(2)) == turn % 2
        mine = state if apart else state.where(half)
        toward = (
            links.join(state.select(F.col("node").alias("other"), F.col("community").alias("_to")), "other")
            .groupBy("node", "_to")
            .agg(F.sum("w").alias("_in"))
        )
        own = mine.select("node", "k", "community", F.col("community").alias("_to"), F.lit(0.0).alias("_in"))
        options = (
            mine.join(toward, "node")
            .select("node", "k", "community", "_to", "_in")
            .unionByName(own)
            .groupBy("node", "k", "community", "_to")
            .agg(F.sum("_in").alias("_in"))
            .join(totals.withColumnRenamed("community", "_to"), "_to")
        )
        without_me = F.when(F.col("_to") == F.col("community"), F.col("_tot") - F.col("k")).otherwise(F.col("_tot"))
        gain = F.round(F.col("_in") - F.col("k") * without_me / two_m, 9)
        best = options.groupBy("node", "community").agg(
            F.min_by("_to", F.struct(-gain, F.col("_to"))).alias("_best"),
            (F.max(gain) - F.max(F.when(F.col("_to") == F.col("community"), gain))).alias("_more"),
        )
        if apart:
            best = _moves_apart(best)
        moved = cut_lineage(
            state.join(best.select("node", "_best"), "node", "left").select(
                "node", "k", F.coalesce("_best", "community").alias("community"),
                (F.coalesce("_best", "community") != F.col("community")).alias("_moved"),
            )
        )
        changed, mark = moved.agg(F.bool_or("_moved"), F.bit_xor(F.xxhash64("node", "community"))).first()
        still = 0 if changed else 2 if apart else still + 1
        state = moved.drop("_moved")
        turn += 1
        if changed and not apart:
            apart = (turn % 2, mark) in seen
            seen.add((turn % 2, mark))
    return state.select("node", "community")


# Table-name tokens of each business domain, in order of priority.
CLUSTER_DOMAINS = [
    ("customer_management", "CUST|SUBSCR|SVC"),
    ("billing_revenue", "BLNG|INVC|PYMT"),
    ("network_operations", "NTWK|CELL"),
]


# The same domains for single table names, without clustering.
FALLBACK_DOMAINS = [
    ("customer_management", "CUST|SUBSCR|SVC_PLAN|ADDR|CNTCT|IDENT|STAT_HIST"),
    ("billing_revenue", "BLNG|INVC|PYMT|USAGE|CDR"),
    ("network_operations", "NTWK|CELL|SVC_ORD|WRK_ORD|INCDT|FIELD|AGT"),
]
SNAPSHOT_DOMAINS = [
    ("customer_management", "CUST|SUBSCR|SVC_PLAN|ADDR|CNTCT|IDENT"),
    ("billing_revenue", "BLNG|INVC|PYMT|USAGE|CDR|ORD|PRICE|PAYMENT"),
    ("network_operations", "NTWK|CELL|WRK_ORD|INCDT|FIELD|AGT|PROD"),
]


def name_communities(members: DataFrame, overrides: Mapping[str, str] | None = None, domains=CLUSTER_DOMAINS) -> DataFrame:
    """(node, domain): each community takes the first domain any member's name hints at."""
    hints = members.groupBy("community").agg(
        *[F.bool_or(F.upper("node").rlike(tokens)).alias(f"_d{i}") for i, (_, tokens) in enumerate(domains)],
        F.min("node").alias("_first"),
    )
    chosen: Column = F.concat(F.lit("domain_"), F.col("_first").cast("string"))
    for i, (label, _) in reversed(list(enumerate(domains))):
        chosen = F.when(F.col(f"_d{i}"), label).otherwise(chosen)
    named = members.join(hints.select("community", chosen.alias("domain")), "community")
    for table, label in (overrides or {}).items():
        named = named.withColumn("domain", F.when(F.col("node") == table, label).otherwise(F.col("domain")))
    return named.select("node", "domain")


def rule_domain(name: Column, rules=FALLBACK_DOMAINS, otherwise: str = "general") -> Column:
    """Domain of a name by the first matching (label, pattern) rule."""
    chosen: Column = F.lit(otherwise)
    for label, pattern in reversed(list(rules)):
        chosen = F.when(F.upper(name).rlike(pattern), label).otherwise(chosen)
    return chosen


def graph_snapshot(columns: DataFrame, edges: DataFrame, policies: DataFrame, rules=SNAPSHOT_DOMAINS) -> tuple[DataFrame, DataFrame]:
    """Table nodes with domain, column count and PII column count; edges between known tables."""
    pii = policies.groupBy("table_name").agg(
        F.count_if(F.col("pii_classification") != "none").alias("pii_columns")
    )
    nodes = (
        columns.groupBy("table_name")
        .agg(F.count(F.lit(1)).alias("column_count"))
        .join(pii, "table_name", "left")
        .select(
            F.col("table_name").alias("node"),
            rule_domain(F.col("table_name"), rules).alias("domain"),
            "column_count",
            F.coalesce("pii_columns", F.lit(0)).alias("pii_columns"),
        )
    )
    known = nodes.select("node")
    links = edges.join(known.withColumnRenamed("node", "source_table"), "source_table", "left_semi").join(
        known.withColumnRenamed("node", "target_table"), "target_table", "left_semi"
    )
    return nodes, links
