from pyspark.sql import functions as F

from veilwork.operators import graph as G
from veilwork.operators import relations as R
from veilwork.sources.tables import statements

LOG = """-- the first; with a semicolon
SELECT o.TOTAL FROM ORDERS o JOIN CLIENT k ON o.CLIENT_NO = k.CLIENT_NO WHERE k.REGION = 'N';
SELECT p.TITLE FROM PART p INNER JOIN STOCK s ON p.PART_NO = s.PART_NO WHERE s.STATE = 'GONE';
SELECT v.DAY FROM VISIT v JOIN STOCK s ON v.SITE_NO = s.PART_NO -- other name
WHERE s.KIND = 'BULK';
SELECT k.CLIENT_NO FROM CLIENT k JOIN PLACE a ON k.CLIENT_NO = a.CLIENT_NO JOIN ORDERS o ON k.CLIENT_NO = o.CLIENT_NO WHERE a.MAIN = 'Y';
SELECT 1 FROM A JOIN B ON A.x = B.x AND A.y = B.y;
SELECT 1 FROM T t1, T t2 WHERE t1.p = t2.q AND t1.z = t1.w;
this is not sql ("""


def test_mine_joins(spark, rows):
    log = statements(spark.createDataFrame([(LOG,)], "value string"))
    assert rows(R.mine_joins(log), *R.END_COLUMNS, "join_count", "confidence") == sorted([
        ("CLIENT", "CLIENT_NO", "ORDERS", "CLIENT_NO", 2, 0.3),
        ("PART", "PART_NO", "STOCK", "PART_NO", 1, 0.3),
        ("STOCK", "PART_NO", "VISIT", "SITE_NO", 1, 0.3),
        ("CLIENT", "CLIENT_NO", "PLACE", "CLIENT_NO", 1, 0.3),
        ("T", "P", "T", "Q", 1, 0.3),
    ], key=repr)


def test_declared_fks(spark, rows):
    ddl = """CREATE TABLE SUBSCR_ACCT ( SUBSCR_ID INTEGER PRIMARY KEY, CUST_ID INTEGER NOT NULL, -- child; of
      FOREIGN KEY (CUST_ID) REFERENCES CUST_MSTR(CUST_ID));
      create table "X" (A INT, B INT, foreign key (A, B) references Y (C, D)); CREATE INDEX i ON X(A);"""
    got = R.declared_fks(statements(spark.createDataFrame([(ddl,)], "value string")))
    assert rows(got, *R.END_COLUMNS) == sorted([
        ("SUBSCR_ACCT", "CUST_ID", "CUST_MSTR", "CUST_ID"), ("X", "A", "Y", "C"), ("X", "B", "Y", "D")], key=repr)


def test_inclusion_orientation_and_orphans(spark, rows):
    parent = spark.createDataFrame([(1,), (2,), (3,), (None,)], "pid int")
    child = spark.createDataFrame([(1, 1), (2, 1), (3, 9), (4, None)], "cid int, fk int")
    tables = {"P": parent, "C": child}
    assert rows(R.inclusion(child, "fk", parent, "pid")) == [(2, 1, 0.5, True)]
    assert rows(R.orphans(child, "fk", parent, "pid")) == [(3, 9)]  # a NULL parent hides nothing
    mined = [R.Edge("P", "pid", "C", "fk", "FK_INFERRED", 0.3)]
    assert R.orient(tables, mined) == []
    assert R.orient(tables, mined, least=0.5) == [R.Edge("C", "fk", "P", "pid", "FK_INFERRED", 0.3)]
    assert R.orient(tables, mined, [R.Edge("C", "fk", "P", "pid")], least=0.5) == []


def test_merge_restrict_junction(spark, rows):
    declared = R.edges_frame(spark, [R.Edge("A", "x", "B", "y"), R.Edge("A", "z", "C", "w")])
    inferred = R.edges_frame(spark, [R.Edge("a", "X", "b", "Y", "FK_INFERRED", 0.6)])
    merged = R.merge_edges(declared, inferred)
    assert rows(merged, "relationship_type") == [("FK_DECLARED",), ("FK_INFERRED",)]
    assert rows(R.restrict(merged, ["a", "c"]), "target_table") == [("C",)]
    counts = spark.createDataFrame([("A", 6), ("Q", 3)], "table_name string, column_count int")
    assert rows(R.junction_tables(declared, counts), "table_name") == [("A",)]


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "source string, target string")


def test_reachable_goes_one_step_past_the_hops_and_sees_cycles(spark, rows):
    chain = edges(spark, [(str(i), str(i + 1)) for i in range(8)])
    start = spark.createDataFrame([("0",)], "start string")
    assert rows(G.reachable(chain, start, hops=3), "node", "distance") == [(str(i), i) for i in range(1, 5)]
    loop = edges(spark, [("a", "b"), ("b", "a")])
    assert rows(G.reachable(loop, spark.createDataFrame([("a",)], "start string")), "node", "distance") == [("a", 2), ("b", 1)]


def test_focus(spark, rows):
    e = edges(spark, [("a", "b"), ("c", "b"), ("c", "d"), ("d", "e")])
    nodes, inside = G.focus(e, spark.createDataFrame([("a",)], "start string"), hops=2)
    assert rows(nodes) == [("a",), ("b",), ("c",)] and rows(inside, "source", "target") == [("a", "b"), ("c", "b")]


def test_dependency_levels_with_a_cycle(spark, rows):
    e = edges(spark, [("order", "cust"), ("line", "order"), ("line", "part"), ("x", "y"), ("y", "x"), ("z", "x"), ("cust", "cust")])
    nodes = spark.createDataFrame([(n,) for n in ("order", "cust", "line", "part", "x", "y", "z")], "node string")
    assert rows(G.dependency_levels(e, nodes), "node", "level", "cyclic") == [
        ("cust", 0, False), ("line", 2, False), ("order", 1, False), ("part", 0, False), ("x", 3, True), ("y", 3, True), ("z", 3, True)]


def test_components_of_chains_stars_and_loners(spark, rows):
    pairs = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(201, 200)]
    e = spark.createDataFrame(pairs, "source int, target int")
    nodes = spark.createDataFrame([(n,) for p in pairs for n in p] + [(999,)], "node int")
    got = dict(rows(G.components(e, nodes), "node", "component"))
    assert {got[i] for i in range(41)} == {0} and {got[i] for i in range(100, 130)} == {100}
    assert got[200] == got[201] == 200 and got[999] == 999


def test_communities_split_two_cliques(spark):
    import itertools

    pairs = list(itertools.combinations("abcd", 2)) + list(itertools.combinations("wxyz", 2)) + [("d", "w")]
    e = edges(spark, pairs)
    nodes = spark.createDataFrame([(n,) for n in "abcdwxyz"], "node string")
    for partitions in (1, 4):
        got = {r["node"]: r["community"] for r in G.communities(e.repartition(partitions), nodes).collect()}
        assert len({got[n] for n in "abcd"}) == 1 and len({got[n] for n in "wxyz"}) == 1 and got["a"] != got["z"]


def test_communities_run_until_no_move_gains(spark):
    """Pairs whose ends share a half swap for ever in half steps; a path needs many moves."""
    pairs = [(2 * i, 2 * i + 1) for i in range(20)] + [(100 + i, 101 + i) for i in range(60)]
    nodes = sorted({n for p in pairs for n in p})
    e = spark.createDataFrame(pairs, "source int, target int")
    got = {r["node"]: r["community"] for r in G.communities(e, spark.createDataFrame([(n,) for n in [*nodes, 999]], "node int")).collect()}
    assert all(got[2 * i] == got[2 * i + 1] for i in range(20)) and got.pop(999) == "999"
    near = {n: [b if a == n else a for a, b in pairs if n in (a, b)] for n in nodes}
    total = {c: sum(len(near[n]) for n in nodes if got[n] == c) for c in set(got.values())}

    def gain(n, c):
        rest = total[c] - (len(near[n]) if got[n] == c else 0)
        return sum(got[o] == c for o in near[n]) - len(near[n]) * rest / (2 * len(pairs))

    assert all(gain(n, got[o]) <= gain(n, got[n]) + 1e-8 for n in nodes for o in near[n])


def test_domains_and_schema_graph(spark, rows):
    members = spark.createDataFrame([("CUST_MSTR", 1), ("INVC", 1), ("PYMT", 2), ("ZZ", 3)], "node string, community int")
    assert rows(G.name_communities(members, {"INVC": "special"})) == [
        ("CUST_MSTR", "customer_management"), ("INVC", "special"), ("PYMT", "billing_revenue"), ("ZZ", "domain_ZZ")]
    columns = spark.createDataFrame([("A", "x"), ("B", "y")], "table_name string, column_name string")
    fks = R.edges_frame(spark, [R.Edge("A", "x", "B", "y"), R.Edge("A", "z", "B", "w")])
    nodes, links = G.schema_graph(columns, fks)
    assert nodes.count() == 4 and links.groupBy("edge_type").count().where("edge_type = 'RELATES_TO'").first()["count"] == 2
    assert rows(G.neighbors(edges(spark, [("a", "b")]))) == [("a", "b", "out"), ("b", "a", "in")]
    policies = spark.createDataFrame([("A", "uncertain")], "table_name string, pii_classification string")
    snap, kept = G.graph_snapshot(columns, fks, policies)
    assert rows(snap, "node", "pii_columns") == [("A", 1), ("B", 0)] and kept.count() == 2
    assert spark.range(1).select(G.rule_domain(F.lit("wrk_ord"))).first()[0] == "network_operations"
