import pytest
from pyspark.sql import functions as F

from veilwork.operators import masking as M
from veilwork.operators import pii
from veilwork.operators import policies as P
from veilwork.operators.relations import Edge

KEY = "k"


@pytest.mark.parametrize("text,entity", [
    ("mail ann.b@example.co.uk now", "EMAIL_ADDRESS"), ("call (555) 123-4567", "PHONE_NUMBER"), ("+1 555-123-4567", "PHONE_NUMBER"),
    ("card 4111 1111 1111 1111", "CREDIT_CARD"), ("GB82 WEST 1234 5698 7654 32", "IBAN_CODE"), ("from 10.0.200.7.", "IP_ADDRESS"),
    ("imsi 310150123456789 end", "IMSI"), ("id SUB-12345678", "SUBSCRIBER_ID"), ("ssn 123-45-6789", "SSN"),
    ("see https://a.example.org/x?y=1", "URL"), ("on 2024-02-03", "DATE_TIME"), ("lic AB1234567", "MEDICAL_LICENSE")])
def test_entities(spark, text, entity):
    got = pii.pii_findings(spark.createDataFrame([(1, text)], "k int, t string"), ["k"], "t").collect()
    assert entity in {r["pii_type"] for r in got}


def test_no_false_cards_or_addresses(spark):
    df = spark.createDataFrame([(1, "4111 1111 1111 1112"), (2, "999.1.1.1.1"), (3, "plain words"), (4, None)], "k int, t string")
    assert {r["pii_type"] for r in pii.pii_findings(df, ["k"], "t").collect()} <= {"IP_ADDRESS"}


def test_scan_takes_the_best_entity_and_three_examples(spark):
    df = spark.createDataFrame([(f"u{i}@x.org", str(i), "10.0.0.1 a@b.org") for i in range(5)], "m string, n string, both string")
    got = {r["column_name"]: r for r in pii.pii_scan(df, ["m", "n", "both"]).collect()}
    assert got["m"].pii_type == "EMAIL_ADDRESS" and got["m"].matching_values == 5 and 1 <= len(got["m"].sample_matches) <= 3 and set(got["m"].sample_matches) <= {f"u{i}@x.org" for i in range(5)}
    assert not got["n"].pii_detected and got["n"].confidence == 0.0
    assert got["both"].pii_type == "EMAIL_ADDRESS"
    assert pii.pii_scan(df, ["both"], threshold=0.97).first()["pii_type"] == "EMAIL_ADDRESS"


@pytest.mark.parametrize("raw,expected", [
    (None, []), ([1, None, 2], [1, 2]), ({"a": 1, "b": None}, [1]), ("range(1, 10, 3)", [1, 4, 7]), ("range(2,4)", [2, 3]),
    ("['A','B']", ["A", "B"]), ("", []), ("plain text", ["plain text"]), ("{'x': 'y'}", ["y"]), (5, [5])])
def test_allowed_list(raw, expected):
    assert P.allowed_list(raw) == expected


def test_derive_policies(spark):
    columns = spark.createDataFrame([("T", "MAIL"), ("T", "X_ID"), ("T", "BIRTH_DT_NO"), ("T", "G"), ("T", "O")], "table_name string, column_name string")
    scans = spark.createDataFrame([("T", "MAIL", "EMAIL_ADDRESS", 1.0), ("T", "X_ID", "DATE_TIME", 0.9), ("T", "BIRTH_DT_NO", "DATE_TIME", 0.9), ("T", "O", "URL", 0.5)],
                                  "table_name string, column_name string, pii_type string, confidence double")
    given = P.policies_frame(spark, [P.ColumnPolicy("T", "G", masking_strategy="generalise", confidence=0.4, allowed_values="range(1,3)")])
    derived = P.derive_policies(columns, scans, given)
    got = {r["column_name"]: r for r in derived.collect()}
    assert got["MAIL"].masking_strategy == "substitute_realistic" and got["MAIL"].dedup_mode == "entity"
    assert got["X_ID"].pii_classification == "uncertain"  # a date in an id column is implausible
    assert got["BIRTH_DT_NO"].pii_source == "scan" and got["O"].pii_source == "fallback"
    assert got["G"].masking_strategy == "generalise" and got["G"].allowed_values == ["1", "2"]
    assert {r["column_name"] for r in P.review_queue(derived).collect()} == {"X_ID", "G", "O"}
    decisions = spark.createDataFrame(
        [("T", "G", "approve", ("none", "passthrough"), None, 1), ("T", "O", "correct", None, ("sensitive_business", "suppress"), 2)],
        "table_name string, column_name string, action string, best_guess struct<pii_classification:string,masking_strategy:string>,"
        " corrected struct<pii_classification:string,masking_strategy:string>, decided_at int")
    fixed = {r["column_name"]: r for r in P.apply_reviews(derived, decisions).collect()}
    assert fixed["G"].pii_source == "human_review" and fixed["O"].masking_strategy == "suppress" and fixed["O"].confidence == 1.0
    assert len(P.policy_list(derived, "T")) == 5
    assert P.policies_of(derived, "T", "pii").count() == 4 and P.policies_of(derived, pii="clean").count() == 1


def test_policy_upkeep(spark, rows):
    p = spark.createDataFrame([("s", "T", "a"), ("s", "T", "gone"), ("s", "_X", "a"), ("other", "T", "q")], "source_name string, table_name string, column_name string")
    catalog = spark.createDataFrame([("s", "T", "a")], "source_name string, table_name string, column_name string")
    assert rows(P.prune_policies(p, catalog)) == [("other", "T", "q"), ("s", "T", "a")]
    modes = spark.createDataFrame([("T", "event", 1), ("T", "entity", 2), ("U", "entity", 1)], "table_name string, dedup_mode string, ordinal int")
    assert rows(P.dominant_dedup_mode(modes)) == [("T", "event"), ("U", "entity")]
    assert rows(P.backfill_source(spark.createDataFrame([(None,), ("x",)], "source_name string"), "d")) == [("d",), ("x",)]
    strategies = spark.createDataFrame([("T", "billing")], "table_name string, domain string")
    assert P.policies_of_domain(p, strategies, "billing").count() == 3
    failed = spark.createDataFrame([("T", "KS Test: a", False), ("T", "FK Integrity: b", False), ("T", "JSD: c", True)], "table_name string, check_name string, passed boolean")
    assert P.failure_types(failed).first()["failure_types"] == ["lineage", "statistical"]
    known = spark.createDataFrame([("A", "old", 1)], "token string, expansion string, added_at int")
    assert rows(P.add_abbreviation(known, spark.createDataFrame([("A", "new", 2)], known.schema)), "expansion") == [("new",)]


def people(spark):
    return spark.createDataFrame([(1, "Ann", "12-AB", 30.0), (2, "Bob", None, None), (3, "Ann", "12-AB", -1.0)], "id int, CUST_FRST_NM string, DOC_NO string, BAL double")


def policy(column, strategy):
    return P.ColumnPolicy("T", column, masking_strategy=strategy)


def test_masking_is_consistent_and_keeps_nulls_and_shapes(spark):
    df = people(spark)
    masked = M.mask(df, [policy("CUST_FRST_NM", "substitute_realistic"), policy("DOC_NO", "format_preserving"), policy("BAL", "generalise"), policy("id", "passthrough")], KEY)
    a, b, c = masked.orderBy("id").collect()
    assert a.CUST_FRST_NM == c.CUST_FRST_NM and a.CUST_FRST_NM in M.FIRST_NAMES
    assert a.DOC_NO == c.DOC_NO and b.DOC_NO is None
    assert a.DOC_NO[:2].isdigit() and a.DOC_NO[2] == "-" and a.DOC_NO[3:].isupper()
    assert (a.BAL, b.BAL, c.BAL, a.id) == ("25-50", None, "NEGATIVE", 1)
    other = M.mask(df, [policy("DOC_NO", "format_preserving")], "another key").orderBy("id").first()
    assert other.DOC_NO != a.DOC_NO
    assert "DOC_NO" not in M.mask(df, [policy("DOC_NO", "suppress")], KEY).columns


def test_short_tokens_match_whole_name_parts(spark):
    df = spark.createDataFrame([("x",)], "SHIP_TXT string")
    whole = M.mask(df, [policy("SHIP_TXT", "substitute_realistic")], KEY).first()[0]
    anywhere = M.mask(df, [policy("SHIP_TXT", "substitute_realistic")], KEY, substring_tokens=True).first()[0]
    assert "." not in whole and anywhere.startswith("10.")


def test_long_and_foreign_text_keeps_its_shape(spark):
    text = "Ünïcode é1 " * 9
    df = spark.createDataFrame([(text,), ("",)], "NOTE string")
    got = [r[0] for r in M.mask(df, [policy("NOTE", "format_preserving")], KEY).collect()]
    assert got[1] == "" and len(got[0]) == len(text)
    assert all(a.isdigit() == b.isdigit() and a.isspace() == b.isspace() and a.isupper() == b.isupper() for a, b in zip(text, got[0]))


def test_key_domains_are_shared_along_edges():
    edges = [Edge("C", "fk", "P", "id"), Edge("P", "id", "G", "gid")]
    assert M.key_domains(edges, "C")["fk"] == M.key_domains(edges, "P")["id"] == M.key_domains(edges, "G")["gid"]
    assert M.key_domains(edges, "Z") == {}


def test_training_frame(spark):
    frame = M.training_frame(people(spark), [policy("CUST_FRST_NM", "substitute_realistic"), policy("BAL", "generalise"), policy("DOC_NO", "suppress")], KEY)
    assert frame.columns == ["id", "CUST_FRST_NM", "BAL"] and frame.schema["BAL"].dataType.simpleString() == "double"
