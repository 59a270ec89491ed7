"""Foreign keys, query-log mining, and graph operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import check, read
from veilwork.operators import graph as G
from veilwork.operators import relations as R
from veilwork.sources.tables import statements, union_all

EDGES = [
    R.Edge("NATION", "n_regionkey", "REGION", "r_regionkey"),
    R.Edge("CUSTOMER", "c_nationkey", "NATION", "n_nationkey"),
    R.Edge("SUPPLIER", "s_nationkey", "NATION", "n_nationkey"),
    R.Edge("ORDERS", "o_custkey", "CUSTOMER", "c_custkey"),
    R.Edge("LINEITEM", "l_orderkey", "ORDERS", "o_orderkey"),
    R.Edge("LINEITEM", "l_partkey", "PART", "p_partkey"),
    R.Edge("LINEITEM", "l_suppkey", "SUPPLIER", "s_suppkey"),
    R.Edge("LABELS", "doc_id", "DOCUMENTS", "doc_id"),
]


def tables_of(spark, root, edges=EDGES):
    names = {e.source_table for e in edges} | {e.target_table for e in edges}
    return {n: read(spark, root, n.lower()) for n in sorted(names)}


@check(
    "fk_orphans",
    """SELECT l_orderkey, count(*) AS lines FROM lineitem
       WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY l_orderkey""",
)
def fk_orphans(spark, root):
    finished = read(spark, root, "orders").where("o_orderstatus = 'F'")
    lost = R.orphans(read(spark, root, "lineitem"), "l_orderkey", finished, "o_orderkey")
    return lost.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("lines"))


def _sql_inclusion(e: R.Edge) -> str:
    c, cc, p, pc = e.source_table, e.source_column, e.target_table, e.target_column
    return f"""SELECT '{c}' AS source_table, '{cc}' AS source_column, '{p}' AS target_table, '{pc}' AS target_column,
      (SELECT count(DISTINCT {cc}) FROM {c}) AS child_values,
      (SELECT count(DISTINCT {cc}) FROM {c} WHERE {cc} IN (SELECT {pc} FROM {p})) AS contained_values,
      (SELECT count(DISTINCT {pc}) = count({pc}) FROM {p}) AS parent_unique"""


def _reversed(e: R.Edge) -> R.Edge:
    return R.Edge(e.target_table, e.target_column, e.source_table, e.source_column)


BOTH_WAYS = EDGES + [_reversed(e) for e in EDGES]


@check("fk_inclusion", " UNION ALL ".join(_sql_inclusion(e) for e in BOTH_WAYS))
def fk_inclusion(spark, root):
    return R.check_edges(tables_of(spark, root), BOTH_WAYS).drop("inclusion_ratio")


def query_log(spark, root):
    """One SQL statement per event, of a form that depends on the event type."""
    event = F.col("event_id").cast("string")
    text = (
        F.when(
            F.col("event_type") == "view",
            F.concat(
                F.lit("SELECT e.props FROM EVENTS e\nJOIN CUSTOMER c ON e.USER_ID = c.C_CUSTKEY -- a.x = b.y; not code\nWHERE e.EVENT_ID = "),
                event,
            ),
        )
        .when(
            F.col("event_type") == "click",
            F.concat(
                F.lit("select * from orders o inner join customer AS c on c.c_custkey = o.o_custkey left join nation n on c.c_nationkey = n.n_nationkey where o.note = 'p.q = r.s' and o.o_orderkey = "),
                event,
            ),
        )
        .when(
            F.col("event_type") == "error",
            F.lit("SELECT count(*) FROM LINEITEM l, PART p WHERE l.L_PARTKEY = p.P_PARTKEY AND l.L_QUANTITY > 5 GROUP BY p.P_NAME"),
        )
        .when(
            F.col("event_type") == "purchase",
            F.lit("SELECT 1 FROM LINEITEM l JOIN ORDERS o ON l.L_ORDERKEY = o.O_ORDERKEY AND o.O_ORDERSTATUS = 'F'"),
        )
        .otherwise(F.concat(F.lit("UPDATE EVENTS SET VALUE = "), event))
    )
    return statements(read(spark, root, "events").select(text.alias("value")))


MINED_SQL = """WITH pairs(event_type, source_table, source_column, target_table, target_column) AS (VALUES
    ('view', 'CUSTOMER', 'C_CUSTKEY', 'EVENTS', 'USER_ID'),
    ('click', 'CUSTOMER', 'C_CUSTKEY', 'ORDERS', 'O_CUSTKEY'),
    ('click', 'CUSTOMER', 'C_NATIONKEY', 'NATION', 'N_NATIONKEY'),
    ('error', 'LINEITEM', 'L_PARTKEY', 'PART', 'P_PARTKEY')),
  mined AS (SELECT source_table, source_column, target_table, target_column, count(*) AS join_count,
      CASE WHEN count(*) > 1000 THEN 0.95 WHEN count(*) > 100 THEN 0.8 WHEN count(*) > 10 THEN 0.6 ELSE 0.3 END::DOUBLE AS confidence
    FROM events JOIN pairs USING (event_type) GROUP BY ALL)"""


@check("query_log_joins", MINED_SQL + " SELECT *, 'FK_INFERRED' AS relationship_type FROM mined")
def query_log_joins(spark, root):
    return R.mine_joins(query_log(spark, root))


@check(
    "oriented_joins",
    MINED_SQL
    + """, checked AS (
      SELECT 'EVENTS' AS s, 'USER_ID' AS sc, 'CUSTOMER' AS t, 'C_CUSTKEY' AS tc,
             (SELECT bool_and(user_id IN (SELECT c_custkey FROM customer)) FROM events) AS holds
      UNION ALL SELECT 'ORDERS', 'O_CUSTKEY', 'CUSTOMER', 'C_CUSTKEY', (SELECT bool_and(o_custkey IN (SELECT c_custkey FROM customer)) FROM orders)
      UNION ALL SELECT 'CUSTOMER', 'C_NATIONKEY', 'NATION', 'N_NATIONKEY', (SELECT bool_and(c_nationkey IN (SELECT n_nationkey FROM nation)) FROM customer)
      UNION ALL SELECT 'LINEITEM', 'L_PARTKEY', 'PART', 'P_PARTKEY', (SELECT bool_and(l_partkey IN (SELECT p_partkey FROM part)) FROM lineitem))
    SELECT s AS source_table, sc AS source_column, t AS target_table, tc AS target_column, confidence FROM checked
    JOIN mined ON (source_table, source_column, target_table, target_column) IN ((s, sc, t, tc), (t, tc, s, sc)) WHERE holds""",
)
def oriented_joins(spark, root):
    names = ("events", "customer", "orders", "nation", "lineitem", "part")
    tables = {n.upper(): read(spark, root, n) for n in names}
    mined = R.edge_list(R.mine_joins(query_log(spark, root)))
    return R.edges_frame(spark, R.orient(tables, mined)).drop("relationship_type")


@check(
    "declared_fks",
    """SELECT 'SUPP_' || s_suppkey AS source_table, sc AS source_column, tt AS target_table, tc AS target_column,
              'FK_DECLARED' AS relationship_type, 1.0::DOUBLE AS confidence
       FROM supplier, (VALUES ('NATION_ID', 'NATION', 'N_NATIONKEY'), ('PART_A', 'PARTS', 'A'), ('PART_B', 'PARTS', 'B')) AS v(sc, tt, tc)""",
)
def declared_fks(spark, root):
    ddl = F.concat(
        F.lit("-- supplier; schema\nCREATE TABLE IF NOT EXISTS supp_"),
        F.col("s_suppkey"),
        F.lit(
            " (ID INTEGER PRIMARY KEY, nation_id INTEGER, PART_A INTEGER, PART_B INTEGER,\n"
            " FOREIGN KEY (nation_id) REFERENCES NATION(N_NATIONKEY),\n"
            " foreign key (PART_A, PART_B) references \"PARTS\" (A, B));\nDROP TABLE x;"
        ),
    )
    return R.declared_fks(statements(read(spark, root, "supplier").select(ddl.alias("value"))))


@check(
    "merged_relationships",
    """SELECT n, count(*) AS edges FROM (
         SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN 'FK_INFERRED' ELSE 'FK_DECLARED' END AS n FROM supplier
         UNION ALL SELECT s_suppkey, 'FK_DECLARED' FROM supplier UNION ALL SELECT s_suppkey, 'FK_DECLARED' FROM supplier) GROUP BY n""",
)
def merged_relationships(spark, root):
    declared = declared_fks(spark, root)
    # logs repeat, in other case, the nation key of every supplier in debt
    inferred = (
        read(spark, root, "supplier")
        .where("s_acctbal < 0")
        .select(
            F.concat(F.lit("Supp_"), "s_suppkey").alias("source_table"),
            F.lit("nation_id").alias("source_column"),
            F.lit("Nation").alias("target_table"),
            F.lit("n_nationkey").alias("target_column"),
            F.lit("FK_INFERRED").alias("relationship_type"),
            F.lit(0.3).alias("confidence"),
        )
    )
    merged = R.merge_edges(declared, inferred)
    return merged.groupBy(F.col("relationship_type").alias("n")).agg(F.count(F.lit(1)).alias("edges"))


# ---- graphs drawn from the data ------------------------------------------------


def row_links(spark, root, edges):
    """Row-level graph: one link from each child row to its parent row."""
    keys = {"NATION": "n_nationkey", "CUSTOMER": "c_custkey", "SUPPLIER": "s_suppkey", "ORDERS": "o_orderkey"}
    return union_all(
        read(spark, root, e.source_table.lower()).select(
            F.concat_ws(":", F.lit(e.source_table), keys[e.source_table]).alias("source"),
            F.concat_ws(":", F.lit(e.target_table), e.source_column).alias("target"),
        )
        for e in edges
    )


def _sql_links(edges) -> str:
    keys = {"NATION": "n_nationkey", "CUSTOMER": "c_custkey", "SUPPLIER": "s_suppkey", "ORDERS": "o_orderkey"}
    return " UNION ALL ".join(
        f"SELECT '{e.source_table}:' || {keys[e.source_table]} AS source, '{e.target_table}:' || {e.source_column} AS target FROM {e.source_table}"
        for e in edges
    )


@check(
    "reachable_rows",
    """SELECT 'ORDERS:' || o_orderkey AS start, unnest(['CUSTOMER:' || c_custkey, 'NATION:' || n_nationkey, 'REGION:' || n_regionkey]) AS node,
              unnest([1, 2, 3]) AS distance
       FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
)
def reachable_rows(spark, root):
    links = row_links(spark, root, [EDGES[0], EDGES[1], EDGES[3]])
    starts = read(spark, root, "orders").select(F.concat_ws(":", F.lit("ORDERS"), "o_orderkey").alias("start"))
    return G.reachable(links, starts)


@check(
    "focus_subgraph",
    f"""WITH links AS ({_sql_links([EDGES[0], EDGES[1], EDGES[2]])}),
          both_ways AS (SELECT source AS a, target AS b FROM links UNION SELECT target, source FROM links),
          k0 AS (SELECT 'SUPPLIER:' || s_suppkey AS n FROM supplier WHERE s_acctbal < 0),
          k1 AS (SELECT n FROM k0 UNION SELECT b FROM both_ways WHERE a IN (SELECT n FROM k0)),
          k2 AS (SELECT n FROM k1 UNION SELECT b FROM both_ways WHERE a IN (SELECT n FROM k1))
        SELECT source, target FROM links WHERE source IN (SELECT n FROM k2) AND target IN (SELECT n FROM k2)""",
)
def focus_subgraph(spark, root):
    links = row_links(spark, root, [EDGES[0], EDGES[1], EDGES[2]])
    starts = read(spark, root, "supplier").where("s_acctbal < 0").select(
        F.concat_ws(":", F.lit("SUPPLIER"), "s_suppkey").alias("start")
    )
    return G.focus(links, starts, hops=2)[1]


@check(
    "neighbor_counts",
    """SELECT node, direction, count(*) AS neighbors FROM (
         SELECT DISTINCT 'O' || o_orderkey AS node, 'C' || o_custkey AS other, 'out' AS direction FROM orders
         UNION ALL SELECT DISTINCT 'C' || o_custkey, 'O' || o_orderkey, 'in' FROM orders) GROUP BY ALL""",
)
def neighbor_counts(spark, root):
    links = read(spark, root, "orders").select(
        F.concat(F.lit("O"), "o_orderkey").alias("source"), F.concat(F.lit("C"), "o_custkey").alias("target")
    )
    return G.neighbors(links).groupBy("node", "direction").agg(F.count(F.lit(1)).alias("neighbors"))


def turn_graph(spark, root):
    """Every turn of a conversation depends on the turn before it."""
    turns = read(spark, root, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("node")).distinct()
    return turns, turns.select(F.col("node").alias("source"), (F.col("node") - 1).alias("target"))


@check(
    "dependency_levels",
    """SELECT DISTINCT conv_id * 1000 + turn AS node,
         dense_rank() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS level, false AS cyclic FROM conversations""",
)
def dependency_levels(spark, root):
    nodes, links = turn_graph(spark, root)
    return G.dependency_levels(links, nodes)


@check(
    "connected_components",
    """SELECT conv_id * 1000 + turn AS node, min(conv_id * 1000 + turn) OVER (PARTITION BY conv_id) AS component
       FROM (SELECT DISTINCT conv_id, turn FROM conversations)""",
)
def connected_components(spark, root):
    nodes, links = turn_graph(spark, root)
    known = links.join(nodes.select(F.col("node").alias("target")), "target", "left_semi")
    return G.components(known, nodes)


@check("communities")
def communities(spark, root):
    """Communities of the graph of nations and their customers and suppliers."""
    links = row_links(spark, root, [EDGES[0], EDGES[1], EDGES[2]])
    return G.communities(links, G.neighbors(links).select("node"))


@check(
    "domain_assign",
    """WITH members AS (SELECT 'NTWK_' || s_suppkey AS node, s_nationkey AS k FROM supplier
                        UNION ALL SELECT 'AREA_' || n_nationkey, n_nationkey FROM nation
                        UNION ALL SELECT 'CUST_' || c_custkey, c_nationkey FROM customer WHERE c_acctbal < 0)
       SELECT node, CASE WHEN bool_or(node LIKE '%CUST%') OVER (PARTITION BY k) THEN 'customer_management'
                         WHEN bool_or(node LIKE '%NTWK%') OVER (PARTITION BY k) THEN 'network_operations'
                         ELSE 'domain_' || min(node) OVER (PARTITION BY k) END AS domain FROM members""",
)
def domain_assign(spark, root):
    area = F.concat(F.lit("AREA_"), "k").alias("target")
    links = union_all(
        [
            read(spark, root, "supplier").select(F.concat(F.lit("NTWK_"), "s_suppkey").alias("source"), F.col("s_nationkey").alias("k")),
            read(spark, root, "customer").where("c_acctbal < 0").select(F.concat(F.lit("CUST_"), "c_custkey").alias("source"), F.col("c_nationkey").alias("k")),
        ]
    ).select("source", area)
    areas = read(spark, root, "nation").select(F.concat(F.lit("AREA_"), "n_nationkey").alias("node"))
    nodes = areas.unionByName(links.select(F.col("source").alias("node")))
    members = G.components(links, nodes).withColumnRenamed("component", "community")
    return G.name_communities(members)


@check(
    "table_domains",
    """SELECT word, count(*) AS documents, CASE WHEN regexp_matches(word, 'CUST|SUBSCR|SVC_PLAN|ADDR|CNTCT|IDENT|STAT_HIST') THEN 'customer_management'
         WHEN regexp_matches(word, 'BLNG|INVC|PYMT|USAGE|CDR') THEN 'billing_revenue'
         WHEN regexp_matches(word, 'NTWK|CELL|SVC_ORD|WRK_ORD|INCDT|FIELD|AGT') THEN 'network_operations' ELSE 'general' END AS domain
       FROM (SELECT CASE event_type WHEN 'view' THEN 'CUST_ADDR' WHEN 'click' THEN 'INVC_LN_ITEM' WHEN 'error' THEN 'NTWK_INCDT'
             WHEN 'purchase' THEN 'DEMO_ORDER' ELSE 'SVC_ORD' END AS word FROM events) GROUP BY ALL""",
)
def table_domains(spark, root):
    word = (
        F.when(F.col("event_type") == "view", "CUST_ADDR").when(F.col("event_type") == "click", "INVC_LN_ITEM")
        .when(F.col("event_type") == "error", "NTWK_INCDT").when(F.col("event_type") == "purchase", "DEMO_ORDER").otherwise("SVC_ORD")
    )
    seen = read(spark, root, "events").groupBy(word.alias("word")).agg(F.count(F.lit(1)).alias("documents"))
    return seen.withColumn("domain", G.rule_domain(F.col("word")))
