"""Personal-data scan with built-in regular expressions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilwork.session import spread


@dataclass(frozen=True)
class Entity:
    name: str
    pattern: str
    score: float
    luhn: bool = False
    needs: str | None = None  # text every match holds, or None for a digit


# Patterns use only what Java and RE2 read alike: no look-around, no back-references.
# The IMSI and SUBSCRIBER_ID patterns and scores.
ENTITIES = (
    Entity("CREDIT_CARD", r"\b[0-9](?:[ -]?[0-9]){12,18}\b", 1.0, luhn=True),
    Entity("EMAIL_ADDRESS", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}", 1.0, needs="@"),
    Entity("IBAN_CODE", r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b", 0.9),
    Entity("SUBSCRIBER_ID", r"\bSUB-\d{8}\b", 0.9, needs="SUB-"),
    Entity("IMSI", r"\b\d{15}\b", 0.85),
    Entity("IP_ADDRESS", r"\b(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\b", 0.95),
    Entity("MEDICAL_LICENSE", r"\b[A-Z]{2}[0-9]{7}\b", 0.75),
    Entity("PHONE_NUMBER", r"(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|\b[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}\b", 0.75),
    Entity("SSN", r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", 0.85),
    Entity("URL", r"https?://[A-Za-z0-9.-]+\.[A-Za-z]{2,}[^ \t\r\n\"'<>)]*", 0.85, needs="://"),
    Entity("DATE_TIME", r"\b[0-9]{4}-[0-9]{2}-[0-9]{2}\b|\b[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}\b", 0.85),
)


EXAMPLES = 3


def luhn_valid(text: Column) -> Column:
    digits = F.regexp_replace(text, "[^0-9]", "")
    return F.call_function("luhn_check", digits)


def matches(text: Column, entity: Entity) -> Column:
    """All spans of the entity in the text."""
    spans = F.regexp_extract_all(text, F.lit(entity.pattern), F.lit(0))
    return F.filter(spans, luhn_valid) if entity.luhn else spans


def may_match(text: Column, entity: Entity) -> Column:
    """A cheap test that every text with a match passes."""
    return F.contains(text, F.lit(entity.needs)) if entity.needs else text.rlike("[0-9]")


def has_match(text: Column, entity: Entity) -> Column:
    """Whether the text holds the entity: a plain regex test unless a check digit is due."""
    found = may_match(text, entity) & text.rlike(entity.pattern)
    return found & (F.size(matches(text, entity)) > 0) if entity.luhn else found


def pii_findings(df: DataFrame, keys: Sequence[str], column: str, entities: Sequence[Entity] = ENTITIES) -> DataFrame:
    """(…keys, pii_type, match, score): one row per span found in the whole text."""
    def findings(e: Entity) -> Column:
        return F.transform(
            matches(F.col(column), e),
            lambda m: F.struct(F.lit(e.name).alias("pii_type"), m.alias("match"), F.lit(e.score).alias("score")),
        )

    found = F.flatten(F.array(*[findings(e) for e in entities]))
    return spread(df).select(*keys, F.explode(found).alias("f")).select(*keys, "f.*")


def pii_scan(df: DataFrame, columns: Sequence[str], threshold: float = 0.7, entities: Sequence[Entity] = ENTITIES) -> DataFrame:
    """One row per column: best-scoring entity, its score, matching values, example spans.

    Every value of the table is tested in a single pass.  Values without a hit go
    no further than the scan; the rest is counted before anything is shuffled.  The
    examples (at most three) are the smallest spans of three hash classes.
    """
    used = [e for e in entities if e.score >= threshold]
    hits = []
    for c in columns:
        value = F.col(c).cast("string")
        tests = F.array(*[F.when(has_match(value, e), F.lit(i)) for i, e in enumerate(used)])
        hits.append(
            F.struct(
                F.lit(c).alias("column_name"),
                value.alias("value"),
                F.filter(tests, lambda i: i.isNotNull()).alias("found"),
            )
        )
    flat = spread(df).select(F.explode(F.array(*hits)).alias("h")).select("h.*").where(F.size("found") > 0)
    sample = F.lit(None).cast("string")
    for i, e in reversed(list(enumerate(used))):
        sample = F.when(F.element_at("found", 1) == i, F.regexp_extract("value", e.pattern, 0)).otherwise(sample)
    # entity -1 stands for any entity; only it carries an example
    marked = flat.select(
        "column_name", sample.alias("sample"), F.explode(F.concat("found", F.array(F.lit(-1)))).alias("i")
    ).withColumn("sample", F.when(F.col("i") == -1, F.col("sample")))
    third = F.pmod(F.xxhash64("sample"), F.lit(EXAMPLES))
    counted = marked.groupBy("column_name", "i").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.min(F.when(third == j, F.col("sample"))).alias(f"_e{j}") for j in range(EXAMPLES)],
    )
    names = F.array(*[F.lit(e.name) for e in used])
    scores = F.array(*[F.lit(e.score) for e in used])
    real = F.col("i") >= 0
    entity = F.when(real, F.get(names, F.col("i")))
    score = F.when(real, F.get(scores, F.col("i")))
    # highest score first, then the more frequent entity, then the name
    found = counted.withColumn("entity", entity).withColumn("score", score).groupBy("column_name").agg(
        F.min_by("entity", F.when(real, F.struct(-F.col("score"), -F.col("n"), "entity"))).alias("pii_type"),
        F.max("score").alias("confidence"),
        F.max(F.when(~real, F.col("n"))).alias("matching_values"),
        F.array_compact(F.array(*[F.max(f"_e{j}") for j in range(EXAMPLES)])).alias("sample_matches"),
    )
    empty = df.sparkSession.createDataFrame([(c,) for c in columns], "column_name string")
    return empty.join(found, "column_name", "left").select(
        "column_name",
        F.col("pii_type").isNotNull().alias("pii_detected"),
        "pii_type",
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
        F.coalesce("matching_values", F.lit(0)).alias("matching_values"),
        "sample_matches",
    )
