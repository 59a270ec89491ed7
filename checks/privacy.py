"""Personal-data scan, policies, masking."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import check, read, sql_list
from checks.relations import EDGES
from veilwork.operators import masking as M
from veilwork.operators import pii
from veilwork.operators import policies as P
from veilwork.operators.validation import format_failures
from veilwork.sources.tables import union_all

TEXTS = {"documents": ["text", "source"], "conversations": ["text"], "pages": ["html", "url"], "customer": ["c_name"]}


def scans(spark, root):
    return union_all(
        pii.pii_scan(read(spark, root, t), columns).select(F.lit(t.upper()).alias("table_name"), "*")
        for t, columns in TEXTS.items()
    )


LUHN = (
    "(list_sum(list_transform(range(1, length({d}) + 1), lambda i: CASE WHEN (length({d}) - i) % 2 = 0"
    " THEN CAST(substr({d}, i, 1) AS INT) ELSE (CAST(substr({d}, i, 1) AS INT) * 2) // 10 + (CAST(substr({d}, i, 1) AS INT) * 2) % 10 END)) % 10 = 0)"
)


def _sql_spans(text: str, e: pii.Entity) -> str:
    pattern = e.pattern.replace("'", "''")
    spans = f"regexp_extract_all({text}, '{pattern}')"
    if e.luhn:
        luhn = LUHN.format(d="regexp_replace(m, '[^0-9]', '', 'g')")
        spans = f"list_filter({spans}, lambda m: {luhn})"
    return spans


# a value may hold several entities, so distinct values are counted by the row's key
KEYS = {"documents": "doc_id", "conversations": "conv_id * 1000 + turn", "pages": "page_id", "customer": "c_custkey"}


def _sql_hits() -> str:
    return " UNION ALL ".join(
        f"SELECT '{t.upper()}' AS table_name, '{c}' AS column_name, '{e.name}' AS entity, {e.score}::DOUBLE AS score,"
        f" {KEYS[t]} AS k FROM {t} WHERE len({_sql_spans(c, e)}) > 0"
        for t, columns in TEXTS.items()
        for c in columns
        for e in pii.ENTITIES
    )


_COLUMNS_SQL = ", ".join(f"('{t.upper()}', '{c}')" for t, cs in TEXTS.items() for c in cs)
SQL_SCAN = f"""WITH hits AS ({_sql_hits()}),
  counted AS (SELECT table_name, column_name, entity, score, count(*) AS n FROM hits GROUP BY ALL),
  best AS (SELECT table_name, column_name, entity, score FROM counted
           QUALIFY row_number() OVER (PARTITION BY table_name, column_name ORDER BY score DESC, n DESC, entity) = 1),
  matched AS (SELECT table_name, column_name, count(DISTINCT k) AS matching_values FROM hits GROUP BY ALL),
  scan AS (SELECT c.table_name, c.column_name, entity IS NOT NULL AS pii_detected, entity AS pii_type,
       coalesce(score, 0) AS confidence, coalesce(matching_values, 0) AS matching_values
     FROM (VALUES {_COLUMNS_SQL}) AS c(table_name, column_name)
     LEFT JOIN best USING (table_name, column_name) LEFT JOIN matched USING (table_name, column_name))
"""


@check("pii_scan_columns", SQL_SCAN + "SELECT * FROM scan")
def pii_scan_columns(spark, root):
    return scans(spark, root).drop("sample_matches")


@check(
    "pii_findings",
    " UNION ALL ".join(
        f"""SELECT doc_id, '{e.name}' AS pii_type, unnest({_sql_spans("text", e)}) AS match, {e.score}::DOUBLE AS score FROM documents"""
        for e in pii.ENTITIES
    ),
)
def pii_findings(spark, root):
    return pii.pii_findings(read(spark, root, "documents"), ["doc_id"], "text")


GIVEN = [
    P.ColumnPolicy("CUSTOMER", "c_name", "sensitive_business", "substitute_realistic", dedup_mode="entity", confidence=0.9),
    P.ColumnPolicy("DOCUMENTS", "source", "none", "passthrough", business_importance="low", confidence=0.5),
]


def derived(spark, root):
    found = scans(spark, root)
    return P.derive_policies(found.select("table_name", "column_name"), found, P.policies_frame(spark, GIVEN))


SQL_POLICIES = (
    SQL_SCAN
    + """, policies AS (SELECT table_name, column_name,
      CASE WHEN pii_detected THEN 'sensitive_business' WHEN column_name = 'c_name' THEN 'sensitive_business' WHEN column_name = 'source' THEN 'none' ELSE 'uncertain' END AS pii_classification,
      CASE WHEN pii_detected THEN CASE WHEN pii_type IN ('EMAIL_ADDRESS', 'PHONE_NUMBER', 'IP_ADDRESS', 'URL', 'DATE_TIME') THEN 'substitute_realistic'
             WHEN pii_type IN ('CREDIT_CARD', 'SSN', 'IMSI', 'SUBSCRIBER_ID') THEN 'format_preserving' ELSE 'suppress' END
           WHEN column_name = 'c_name' THEN 'substitute_realistic' ELSE 'passthrough' END AS masking_strategy,
      CASE WHEN pii_detected OR column_name = 'c_name' THEN 'important' ELSE 'low' END AS business_importance,
      CASE WHEN pii_detected OR column_name = 'c_name' THEN 'entity' ELSE 'reference' END AS dedup_mode,
      CASE WHEN pii_detected THEN 1.0 WHEN column_name = 'c_name' THEN 0.9 WHEN column_name = 'source' THEN 0.5 ELSE 0.0 END::DOUBLE AS confidence,
      CASE WHEN pii_detected THEN 'scan' WHEN column_name IN ('c_name', 'source') THEN 'rule' ELSE 'fallback' END AS pii_source
    FROM scan)
"""
)
POLICY_COLUMNS = [
    "table_name", "column_name", "pii_classification", "masking_strategy", "business_importance", "dedup_mode",
    "confidence", "pii_source",
]


@check("column_policies", SQL_POLICIES + f"SELECT {', '.join(POLICY_COLUMNS)} FROM policies")
def column_policies(spark, root):
    return derived(spark, root).select(*POLICY_COLUMNS)


@check("review_queue", SQL_POLICIES + "SELECT table_name, column_name, confidence FROM policies WHERE confidence < 0.6")
def review_queue(spark, root):
    return P.review_queue(derived(spark, root)).select("table_name", "column_name", "confidence")


# ---- masking -------------------------------------------------------------------

KEY = "demo-key"


def sql_mask_digest(domain: str, value: str) -> str:
    return f"sha256(concat_ws('|', '{KEY}', '{domain}', {value}))"


def _w(d: str, i: int, size: int) -> str:
    return f"(('0x' || substr({d}, {1 + 8 * i}, 8))::BIGINT % {size})"


def _of(values, d: str, i: int) -> str:
    return f"({sql_list(values)})[{_w(d, i, len(values))} + 1]"


def _pad(d: str, i: int, width: int, low: int = 0) -> str:
    return f"lpad(CAST({_w(d, i, 10**width - low)} + {low} AS VARCHAR), {width}, '0')"


def _abc(d: str, i: int, n: int) -> str:
    number = f"('0x' || substr({d}, {1 + 8 * i}, 8))::BIGINT"
    return " || ".join(f"substr('abcdefghijklmnopqrstuvwxyz', (({number}) // {32**j}) % 26 + 1, 1)" for j in range(n))


def people(spark, root):
    """Customers with one column per kind of personal data, all made from the name."""
    kinds = ("CUST_FRST_NM", "CUST_LST_NM", "CUST_EMAIL", "CUST_PHONE", "ADDR_LN_1", "ADDR_CITY_NM", "ADDR_ST_CD",
             "ADDR_ZIP_CD", "LAST_IP", "HOME_URL", "FULL_NM", "NOTE")
    return read(spark, root, "customer").select("c_custkey", *[F.col("c_name").alias(k) for k in kinds]), kinds


def _sql_people() -> str:
    def d(column):
        return sql_mask_digest(column, "c_name")

    first, last = M.FIRST_NAMES, M.LAST_NAMES
    columns = {
        "CUST_FRST_NM": _of(first, d("CUST_FRST_NM"), 0),
        "CUST_LST_NM": _of(last, d("CUST_LST_NM"), 1),
        "CUST_EMAIL": f"lower({_of(first, d('CUST_EMAIL'), 0)}) || '.' || lower({_of(last, d('CUST_EMAIL'), 1)}) || {_pad(d('CUST_EMAIL'), 2, 4)} || '@example.com'",
        "CUST_PHONE": f"{_pad(d('CUST_PHONE'), 2, 3, 200)} || '-' || {_pad(d('CUST_PHONE'), 3, 3, 200)} || '-' || {_pad(d('CUST_PHONE'), 4, 4)}",
        "ADDR_LN_1": f"CAST({_w(d('ADDR_LN_1'), 2, 9900)} + 100 AS VARCHAR) || ' ' || {_of(M.STREETS, d('ADDR_LN_1'), 3)} || ' Street'",
        "ADDR_CITY_NM": _of(M.CITIES, d("ADDR_CITY_NM"), 0),
        "ADDR_ST_CD": _of(M.STATES, d("ADDR_ST_CD"), 0),
        "ADDR_ZIP_CD": _pad(d("ADDR_ZIP_CD"), 0, 5),
        "LAST_IP": "'10.' || " + " || '.' || ".join(f"CAST({_w(d('LAST_IP'), i, 256)} AS VARCHAR)" for i in range(3)),
        "HOME_URL": f"'https://www.example.com/' || {_abc(d('HOME_URL'), 0, 6)}",
        "FULL_NM": f"{_of(first, d('FULL_NM'), 0)} || ' ' || {_of(last, d('FULL_NM'), 1)}",
        "NOTE": f"{_abc(d('NOTE'), 0, 4)} || {_pad(d('NOTE'), 1, 4)}",
    }
    # LAST_IP holds LAST, which comes first in the token order
    columns["LAST_IP"] = _of(last, d("LAST_IP"), 1)
    return "SELECT c_custkey, " + ", ".join(f"{v} AS {k}" for k, v in columns.items()) + " FROM customer"


@check("mask_substitute", _sql_people())
def mask_substitute(spark, root):
    df, kinds = people(spark, root)
    return M.mask(df, [P.ColumnPolicy("C", k, masking_strategy="substitute_realistic") for k in kinds], KEY)


def _sql_number(d: str, digits: int) -> str:
    low = 10 ** (digits - 1)
    return f"CAST(('0x' || substr({d}, 1, 15))::BIGINT % {9 * low} + {low} AS VARCHAR)"


def _sql_preserved(column: str, value: str) -> str:
    """Letters and digits by pairs of hex digits, 32 characters per digest."""
    stream = (
        f"array_to_string(list_transform(range(0, CAST(floor((length({value}) - 1) / 32) AS BIGINT) + 1), lambda b: "
        f"sha256(concat_ws('|', '{KEY}', '{column}', {value}, b))), '')"
    )
    n = "('0x' || substr(s, 2 * i - 1, 2))::INT"
    c = f"substr({value}, i, 1)"
    return f"""(SELECT array_to_string(list_transform(range(1, length({value}) + 1), lambda i:
        CASE WHEN regexp_matches({c}, '^\\p{{Nd}}$') THEN CAST({n} % 10 AS VARCHAR)
             WHEN regexp_matches({c}, '^\\p{{Lu}}$') THEN substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ', {n} % 26 + 1, 1)
             WHEN regexp_matches({c}, '^\\p{{L}}$') THEN substr('abcdefghijklmnopqrstuvwxyz', {n} % 26 + 1, 1)
             ELSE {c} END), '') FROM (SELECT {stream} AS s))"""


FORMATS = ("CUST_SSN", "SUBSCR_IMSI_NO", "SUBSCR_ICCID_NO", "CREDIT_CARD_NO", "ACCT_NO", "PAY_CC", "c_name")


def _sql_formats() -> str:
    def d(column):
        return sql_mask_digest(column, "c_name")

    iccid = d("SUBSCR_ICCID_NO")
    columns = {
        "CUST_SSN": _sql_number(d("CUST_SSN"), 9),
        "SUBSCR_IMSI_NO": _sql_number(d("SUBSCR_IMSI_NO"), 15),
        "SUBSCR_ICCID_NO": f"{_sql_number(iccid, 16)} || lpad(CAST(('0x' || substr({iccid}, 17, 8))::BIGINT % 10000 AS VARCHAR), 4, '0')",
        "CREDIT_CARD_NO": _sql_number(d("CREDIT_CARD_NO"), 16),
        "ACCT_NO": _sql_preserved("ACCT_NO", "long_name"),
        "PAY_CC": _sql_number(d("PAY_CC"), 16),
        "c_name": _sql_preserved("c_name", "c_name"),
    }
    return (
        "SELECT c_custkey, " + ", ".join(f"{v} AS {k}" for k, v in columns.items())
        + " FROM (SELECT *, c_name || ' Ünit/é ' || c_mktsegment || ' no. ' || c_custkey AS long_name FROM customer)"
    )


def formats(spark, root):
    long_name = F.concat("c_name", F.lit(" Ünit/é "), "c_mktsegment", F.lit(" no. "), F.col("c_custkey"))
    return read(spark, root, "customer").select(
        "c_custkey", *[(long_name if k == "ACCT_NO" else F.col("c_name")).alias(k) for k in FORMATS]
    )


def format_policies():
    return [P.ColumnPolicy("C", k, masking_strategy="format_preserving") for k in FORMATS]


@check("mask_format_preserving", _sql_formats())
def mask_format_preserving(spark, root):
    return M.mask(formats(spark, root), format_policies(), KEY)


@check(
    "mask_generalise",
    """SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'NEGATIVE' WHEN c_acctbal < 25 THEN '0-25' WHEN c_acctbal < 50 THEN '25-50'
         WHEN c_acctbal < 75 THEN '50-75' WHEN c_acctbal < 100 THEN '75-100' ELSE '100+' END AS c_acctbal,
         CASE WHEN c_nationkey < 25 THEN '0-25' ELSE '25-50' END AS c_nationkey, 'REDACTED' AS c_mktsegment FROM customer""",
)
def mask_generalise(spark, root):
    chosen = [P.ColumnPolicy("C", c, masking_strategy="generalise") for c in ("c_acctbal", "c_nationkey", "c_mktsegment")]
    chosen.append(P.ColumnPolicy("C", "c_name", masking_strategy="suppress"))
    return M.mask(read(spark, root, "customer"), chosen, KEY)


@check(
    "mask_consistency",
    """SELECT c_mktsegment, count(*) AS orders, count(DISTINCT c_custkey) AS customers FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1""",
)
def mask_consistency(spark, root):
    """Orders joined to customers by masked keys: both ends share a key domain."""
    customers = read(spark, root, "customer").withColumn("CUST_ICCID_NO", F.col("c_custkey").cast("string"))
    orders = read(spark, root, "orders").withColumn("ORD_ICCID_NO", F.col("o_custkey").cast("string"))
    edge = type(EDGES[0])("ORDERS", "ORD_ICCID_NO", "CUSTOMER", "CUST_ICCID_NO")
    masked = [
        M.mask(df, [P.ColumnPolicy(t, c, masking_strategy="format_preserving")], KEY, M.key_domains([edge], t))
        for df, t, c in ((customers, "CUSTOMER", "CUST_ICCID_NO"), (orders, "ORDERS", "ORD_ICCID_NO"))
    ]
    return (
        masked[0]
        .join(masked[1], F.col("CUST_ICCID_NO") == F.col("ORD_ICCID_NO"))
        .groupBy("c_mktsegment")
        .agg(F.count(F.lit(1)).alias("orders"), F.count_distinct("CUST_ICCID_NO").alias("customers"))
    )


@check(
    "mask_keys_one_to_one",
    """SELECT count(*) AS lines, count(DISTINCT (l_orderkey, l_linenumber)) AS line_keys, count(DISTINCT l_partkey) AS parts, sum(p_size)::BIGINT AS sizes,
        count(*) FILTER (CAST(l_partkey AS VARCHAR) <> '') AS shaped FROM lineitem JOIN part ON p_partkey = l_partkey""",
)
def mask_keys_one_to_one(spark, root):
    """Lines joined to parts by masked keys; masks keep the keys' shape and their number."""
    line_key = F.concat(F.lit("L-"), "l_orderkey", F.lit("/"), "l_linenumber")
    lines = read(spark, root, "lineitem").select(line_key.alias("LINE_CD"), F.col("l_partkey").cast("string").alias("PART_CD"), F.col("l_partkey").alias("was"))
    parts = read(spark, root, "part").select(F.col("p_partkey").cast("string").alias("PART_NO"), "p_size")
    edges = [type(EDGES[0])("LINES", "PART_CD", "PARTS", "PART_NO"), type(EDGES[0])("X", "LINE_CD", "LINES", "LINE_CD")]
    kinds = {"LINE_CD": "format_preserving", "PART_CD": "substitute_realistic", "PART_NO": "format_preserving"}
    policies = [P.ColumnPolicy("T", c, masking_strategy=s) for c, s in kinds.items()]
    masked = M.mask(lines, policies, KEY, M.key_domains(edges, "LINES"))
    shape = (F.length("PART_CD") == F.length(F.col("was").cast("string"))) & F.col("PART_CD").rlike("^[0-9]+$") & F.col("LINE_CD").rlike("^[A-Z]-[0-9]+/[0-9]$")
    return masked.join(M.mask(parts, policies, KEY, M.key_domains(edges, "PARTS")), F.col("PART_CD") == F.col("PART_NO")).agg(
        F.count(F.lit(1)).alias("lines"), F.count_distinct("LINE_CD").alias("line_keys"), F.count_distinct("PART_CD").alias("parts"),
        F.sum("p_size").alias("sizes"), F.count_if(shape).alias("shaped"),
    )


@check(
    "format_check",
    "SELECT 0 AS bad_ssn, 0 AS bad_card, count(*) AS bad_name, count(*) AS n FROM customer WHERE c_name NOT LIKE '1%'",
)
def format_check(spark, root):
    masked = M.mask(formats(spark, root), format_policies(), KEY)
    return masked.agg(
        format_failures(masked, "CUST_SSN", r"\d{9}$").alias("bad_ssn"),
        format_failures(masked, "CREDIT_CARD_NO", r"\d{16}$").alias("bad_card"),
        format_failures(masked, "c_name", r"\d").alias("bad_name"),
        F.count(F.lit(1)).alias("n"),
    )
