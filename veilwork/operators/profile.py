"""Column profiles, value counts, and the generation profile of a table."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilwork.functions import names
from veilwork.session import spread
from veilwork.sources.tables import union_all

FLOATS = (T.DoubleType, T.FloatType)
STAMPS = (T.TimestampType, T.TimestampNTZType, T.DateType)


def is_numeric(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType)


def clean(field: T.StructField) -> Column:
    """The column with NaN read as NULL and -0.0 as 0.0."""
    column = F.col(f"`{field.name}`")
    if isinstance(field.dataType, FLOATS):
        return F.when(~F.isnan(column), column + F.lit(0.0))
    return column


def as_text(field: T.StructField) -> Column:
    if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(clean(field))
    return clean(field).cast("string")


def fields_of(df: DataFrame, columns: Sequence[str] | None = None) -> list[T.StructField]:
    wanted = None if columns is None else set(columns)
    return [f for f in df.schema.fields if wanted is None or f.name in wanted]


def long_form(df: DataFrame, columns: Sequence[str] | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """(…keep, column_name, value) with every column's value as text, one scan."""
    fields = fields_of(df, columns)
    df = spread(df)
    pairs = F.array(
        *[F.struct(F.lit(f.name).alias("column_name"), as_text(f).alias("value")) for f in fields]
    )
    return df.select(*keep, F.explode(pairs).alias("_p")).select(*keep, "_p.column_name", "_p.value")


def value_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column_name, value, frequency, share), NULLs left out.

    Repeated values shrink to one row per map task before the shuffle, so a value
    held by a third of the rows costs no more than any other.
    """
    counted = (
        long_form(df, columns)
        .where(F.col("value").isNotNull())
        .groupBy("column_name", "value")
        .agg(F.count(F.lit(1)).alias("frequency"))
    )
    totals = counted.groupBy("column_name").agg(F.sum("frequency").alias("_total"))
    return counted.join(totals, "column_name").select(
        "column_name", "value", "frequency", (F.col("frequency") / F.col("_total")).alias("share")
    )


def top_values(df: DataFrame, columns: Sequence[str] | None = None, n: int = 10) -> DataFrame:
    """The ``n`` most frequent values of each column; ties go to the smaller text.

    Spark keeps only ``n`` candidates per column and task before the shuffle
    (window group limit), so a column of unique keys does not fill one task.
    """
    counted = (
        long_form(df, columns)
        .where(F.col("value").isNotNull())
        .groupBy("column_name", "value")
        .agg(F.count(F.lit(1)).alias("frequency"))
    )
    window = Window.partitionBy("column_name").orderBy(F.desc("frequency"), "value")
    return counted.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= n)


def clean_sql(field: T.StructField) -> str:
    name = f"`{field.name}`"
    return f"CASE WHEN NOT isnan({name}) THEN {name} + 0.0D END" if isinstance(field.dataType, FLOATS) else name


def sketched_distinct(field: T.StructField) -> str:
    """SQL for an estimate of the distinct values, about 2 % off; one small buffer per task."""
    value = clean_sql(field)
    if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
        value = f"to_json({value})"
    return f"coalesce(hll_sketch_estimate(hll_sketch_agg(CAST({value} AS STRING))), 0)"


def _moments(df: DataFrame, fields: Sequence[T.StructField]) -> DataFrame:
    """Null counts and numeric moments: one pass, nothing shuffled but one row per task."""
    aggregates = ["count(1) AS _n"]
    rows = []
    for i, f in enumerate(fields):
        value = clean_sql(f)
        aggregates.append(f"count({value}) AS _c{i}")
        if is_numeric(f.dataType):
            number = f"CAST({value} AS DOUBLE)"
            aggregates.append(
                f"named_struct('lo', min({number}), 'hi', max({number}), 'mean', avg({number}),"
                f" 'std', stddev_samp({number})) AS _m{i}"
            )
            moments = ", ".join(f"'{out}', _m{i}.{part}" for out, part in MOMENTS)
        else:
            moments = ", ".join(f"'{out}', CAST(NULL AS DOUBLE)" for out, _ in MOMENTS)
        rows.append(
            f"named_struct('column_name', '{f.name}', 'data_type', '{f.dataType.simpleString()}',"
            f" 'ordinal', {i + 1}, 'row_count', _n, 'null_count', _n - _c{i}, {moments})"
        )
    return df.selectExpr(*aggregates).selectExpr(f"inline(array({', '.join(rows)}))")


MOMENTS = (("min_value", "lo"), ("max_value", "hi"), ("mean_value", "mean"), ("std_value", "std"))


SKETCH_LOG = 14  # a theta sketch of 2**14 entries counts up to so many values exactly, more within about 1%
NEAR = 0.05
BOOLEANS = ["Y", "N", "TRUE", "FALSE", "0", "1"]  # fixed values


def _near_a_limit(distinct: int, present: int, rows: int) -> bool:
    """Whether an estimate may fall on the wrong side of a limit that column roles test."""
    limits = (0.95 * present, 0.35 * present, 0.02 * rows, present)
    return any(abs(distinct - limit) <= NEAR * limit for limit in limits)


def _sketched(df: DataFrame, fields: Sequence[T.StructField]) -> DataFrame:
    """Moments, and counts by sketches: one pass, one row per task is all that moves.

    Only columns whose estimate lies near a limit are counted exactly, in a second pass over them alone.
    """
    aggregates = [F.count(F.lit(1)).alias("rows")]
    for i, f in enumerate(fields):
        text = as_text(f)
        number = clean(f).cast("double") if is_numeric(f.dataType) else F.lit(None).cast("double")
        aggregates += [
            F.count(text).alias(f"n{i}"),
            F.coalesce(F.theta_sketch_estimate(F.theta_sketch_agg(text, SKETCH_LOG)), F.lit(0)).alias(f"d{i}"),
            F.coalesce(F.bool_and(F.upper(text).isin(BOOLEANS)), F.lit(False)).alias(f"b{i}"),
            *[how(number).alias(f"{name}{i}") for name, how in (("lo", F.min), ("hi", F.max), ("mean", F.avg), ("std", F.stddev_samp))],
        ]
    row = spread(df.select(*[F.col(f"`{f.name}`") for f in fields])).agg(*aggregates).first()
    sure = {f.name: row[f"d{i}"] < 1 << SKETCH_LOG for i, f in enumerate(fields)}
    near = [f.name for i, f in enumerate(fields) if not sure[f.name] and _near_a_limit(row[f"d{i}"], row[f"n{i}"], row["rows"])]
    exact = {r["column_name"]: r["distinct_count"] for r in _exact_counts(df, near).collect()} if near else {}  # a row per column
    found = [
        (
            f.name, f.dataType.simpleString(), i + 1, row["rows"], row["rows"] - row[f"n{i}"], row[f"lo{i}"], row[f"hi{i}"], row[f"mean{i}"],
            row[f"std{i}"], exact.get(f.name, row[f"d{i}"]), row[f"b{i}"], sure[f.name] or f.name in exact,
        )
        for i, f in enumerate(fields)
    ]
    return df.sparkSession.createDataFrame(
        found,
        "column_name string, data_type string, ordinal int, row_count long, null_count long, min_value double, max_value double,"
        " mean_value double, std_value double, distinct_count long, boolean_like boolean, distinct_exact boolean",
    )


def _exact_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return (
        long_form(df, columns)
        .where(F.col("value").isNotNull())
        # long values are compared by digest, which keeps the shuffle narrow
        .withColumn("value", F.when(F.length("value") <= 40, F.col("value")).otherwise(F.concat(F.lit("md5:"), F.md5("value"))))
        .groupBy("column_name", "value")
        .agg(F.lit(1).alias("_one"))
        .groupBy("column_name")
        .agg(
            F.count(F.lit(1)).alias("distinct_count"),
            F.bool_and(F.upper("value").isin(BOOLEANS)).alias("boolean_like"),
            F.lit(True).alias("distinct_exact"),
        )
    )


def profile(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    sample_rows: int | None = None,
    distinct: str = "sketch",
) -> DataFrame:
    """One row per column: nulls, distinct values, range, mean, deviation.

    Distinct values come from mergeable sketches in the one pass, so neither the table nor its values are shuffled:
    exact up to 2**14 values and wherever a role depends on the count, else within about 1% (``distinct_exact`` tells).
    ``distinct="exact"`` shuffles the distinct values of every column; ``"approx"`` never reads the table twice.
    """
    if sample_rows is not None:
        df = df.limit(sample_rows)
    fields = fields_of(df, columns)
    if distinct == "sketch" and fields:
        return _finished(_sketched(df, fields))
    moments = _moments(df, fields)
    if distinct == "approx":
        rows = ", ".join(
            f"named_struct('column_name', '{f.name}', 'distinct_count', _d{i}, 'boolean_like', CAST(NULL AS BOOLEAN), 'distinct_exact', false)"
            for i, f in enumerate(fields)
        )
        counts = df.selectExpr(*[f"{sketched_distinct(f)} AS _d{i}" for i, f in enumerate(fields)]).selectExpr(
            f"inline(array({rows}))"
        )
    else:
        counts = _exact_counts(df, [f.name for f in fields])
    return _finished(moments.join(counts, "column_name", "left"))


def _finished(stats: DataFrame) -> DataFrame:
    return stats.selectExpr(
        "column_name", "data_type", "ordinal", "row_count", "null_count",
        "CAST(coalesce(distinct_count, 0) AS BIGINT) AS distinct_count",
        "min_value", "max_value", "mean_value", "std_value",
        "coalesce(boolean_like, false) AS boolean_like",
        "coalesce(try_divide(null_count, row_count), 0D) AS null_rate",
        "coalesce(try_divide(distinct_count, row_count - null_count), 0D) AS unique_ratio",
        "coalesce(distinct_exact, true) AS distinct_exact",
    )


def profile_tables(tables: dict[str, DataFrame], **options) -> DataFrame:
    """Profiles of several tables, with their ``table_name``, in one frame."""
    return union_all(
        profile(df, **options).select(F.lit(name).alias("table_name"), "*") for name, df in tables.items()
    )


NUMERIC_TYPES = r"^(?:tinyint|smallint|int|bigint|float|double|decimal.*)$"


def value_pattern(stats: DataFrame, tops: DataFrame) -> DataFrame:
    """Add ``pattern_type`` to a profile, judged from the name and the top values."""
    leading = tops.groupBy("column_name").agg(
        F.count(F.lit(1)).alias("_shown"),
        F.bool_and(
            F.when(F.col("rank") <= 5, F.regexp_replace("value", r"[.\-]", "").rlike("^[0-9]+$"))
        ).alias("_digits"),
    )
    name = F.col("column_name")
    kind = (
        F.when(F.col("_shown").isNull(), "unknown")
        .when((F.col("_shown") <= 10) & name.rlike("_CD|STAT"), "finite_categorical")
        .when(F.col("_digits"), "numeric_measure")
        .otherwise("high_cardinality_string")
    )
    return stats.join(leading, "column_name", "left").withColumn("pattern_type", kind).drop("_shown", "_digits")


def identifier_like() -> Column:
    """Profile columns that only identify a row; fidelity checks leave them out."""
    name = F.col("column_name")
    return names.ends_with_any(name, names.IDENTIFIER_SUFFIXES) | (
        (F.col("unique_ratio") >= 0.95) & names.any_token(name, names.UNIQUE_ID_TOKENS)
    )


def column_roles(stats: DataFrame, policies: DataFrame, key_columns: Iterable[tuple[str, str]] = ()) -> DataFrame:
    """Split profiles into structural and modeled columns, and mark sensitive ones.

    ``stats`` as from ``profile_tables``; ``policies`` needs table_name, column_name,
    masking_strategy, business_importance and dedup_mode; ``key_columns`` are the
    (table, column) ends of all edges.
    """
    name = F.col("column_name")
    keys = [f"{t}.{c}" for t, c in key_columns]
    numeric = F.col("data_type").rlike(NUMERIC_TYPES)
    stamp = F.col("data_type").rlike("^(?:timestamp|date)") | names.any_token(name, names.DATE_TOKENS)
    id_like = names.ends_with_any(name, ["_ID"]) | F.concat_ws(".", "table_name", name).isin(keys)
    unique_id = (F.col("unique_ratio") >= 0.95) & names.any_token(name, names.UNIQUE_ID_TOKENS)
    low = F.col("distinct_count") <= F.greatest(F.lit(12), F.floor(F.col("row_count") * 0.02))
    long_text = ~F.col("_num") & ~F.col("_date") & (F.col("unique_ratio") >= 0.35) & (F.col("distinct_count") >= 50)
    metric = F.col("_num") | names.any_token(name, names.METRIC_TOKENS)
    masked = F.coalesce(F.col("masking_strategy"), F.lit("passthrough")) != "passthrough"
    entity = F.coalesce(F.col("dedup_mode") == "entity", F.lit(False))
    reference = F.coalesce(F.col("dedup_mode") == "reference", F.lit(False))
    ident = F.col("_date") | F.col("_id") | F.col("_unique")
    masked_id = masked & ~metric & (entity | ident | long_text)
    structural = (
        masked_id | ident | low | reference | F.col("boolean_like") | names.any_token(name, names.STATUS_TOKENS)
    )
    chosen = policies.select("table_name", "column_name", "masking_strategy", "business_importance", "dedup_mode")
    tested = stats.join(chosen, ["table_name", "column_name"], "left").select(
        "*", numeric.alias("_num"), stamp.alias("_date"), id_like.alias("_id"), unique_id.alias("_unique")
    )
    return tested.select(
        "table_name",
        "column_name",
        "ordinal",
        "data_type",
        "row_count",
        "masking_strategy",
        "business_importance",
        "dedup_mode",
        F.when(structural, "structural").otherwise("modeled").alias("role"),
        masked.alias("sensitive"),
    )


def generation_profile(roles: DataFrame) -> DataFrame:
    """One row per table: the three column lists and a fingerprint of the decision."""

    def listed(condition: str, name: str) -> Column:
        return F.expr(
            f"transform(array_sort(collect_list(CASE WHEN {condition} THEN struct(ordinal, column_name) END)),"
            f" s -> s.column_name) AS {name}"
        )

    described = (
        "concat_ws(':', column_name, data_type, role, coalesce(masking_strategy, ''),"
        " coalesce(business_importance, ''), coalesce(dedup_mode, ''))"
    )
    return roles.groupBy("table_name").agg(
        listed("role = 'structural'", "structural_columns"),
        listed("role = 'modeled'", "modeled_columns"),
        listed("sensitive", "sensitive_columns"),
        F.max("row_count").alias("row_count"),
        F.expr(f"sha2(concat_ws('|', table_name, array_sort(collect_list({described}))), 256) AS fingerprint"),
    )


def route_tier(
    profiles: DataFrame, large: int = 5000, medium: int = 200, override: str = "tier_override"
) -> DataFrame:
    """Generation tier of each table from its size and column mix."""
    modeled, structural = F.size("modeled_columns"), F.size("structural_columns")
    forced = F.col(override) if override in profiles.columns else F.lit(None).cast("string")
    rules = (
        (modeled == 0)
        | ((modeled == 1) & (structural >= 8))
        | ((F.col("row_count") >= 6000) & (modeled <= 3) & (structural >= 10))
    )
    return profiles.withColumn(
        "tier",
        F.when(rules, "rule_based")
        .when(forced.isNotNull(), forced)
        .when(F.col("row_count") >= max(large, 5000), "ctgan")
        .when(F.col("row_count") >= medium, "tvae")
        .otherwise("rule_based"),
    )


def jaccard(left: Column, right: Column) -> Column:
    """Similarity of two name lists; two empty lists are equal."""
    union = F.size(F.array_union(left, right))
    return F.when(union == 0, F.lit(1.0)).otherwise(
        F.size(F.array_intersect(left, right)) / union
    )


def profile_similarity(pairs: DataFrame, accept: float = 0.75) -> DataFrame:
    """Score ``pairs`` of profiles held in struct columns ``a`` and ``b``."""
    rows_a, rows_b = F.col("a.row_count"), F.col("b.row_count")
    closeness = F.when((rows_a == 0) | (rows_b == 0), F.lit(0.5)).otherwise(
        F.try_divide(F.least(rows_a, rows_b), F.greatest(rows_a, rows_b))
    )
    score = (
        0.65 * jaccard(F.col("a.modeled_columns"), F.col("b.modeled_columns"))
        + 0.25 * jaccard(F.col("a.structural_columns"), F.col("b.structural_columns"))
        + 0.10 * closeness
    )
    return pairs.withColumn("score", F.round(score, 4)).withColumn("compatible", F.col("score") >= accept)


def multiplicity(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Children per parent key: mean, deviation, least and most, for each key column."""
    counted = (
        long_form(df, keys)
        .where(F.col("value").isNotNull())
        .groupBy("column_name", "value")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    return counted.groupBy("column_name").agg(
        F.count(F.lit(1)).alias("parents"),
        F.avg("_n").alias("mean_count"),
        F.coalesce(F.stddev_samp("_n"), F.lit(0.0)).alias("std_count"),
        F.min("_n").alias("min_count"),
        F.max("_n").alias("max_count"),
    )
