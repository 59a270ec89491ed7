"""The row rules and the hash de-duplication on unbounded tables.

Row rules hold no state, so they are the same filter on a stream; duplicate
hashes are forgotten once the watermark has passed them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from veilwork.operators.dedup import compared_columns, record_hash
from veilwork.operators.defects import Rule, row_json, scan_table


def scan_stream(stream: DataFrame, table: str, rules: Sequence[Rule]) -> DataFrame:
    """Defective rows of a stream by the rules that need no other table."""
    local = [(i, r) for i, r in enumerate(rules) if r.table == table and r.parent is None]
    hits = scan_table(stream, table, local, {})
    return hits.select(
        "table_name", "rule_key", "column_name", "defect_type", "pk_value", "bad_value", "reason", "severity",
        row_json(hits).alias("example_row"),
    )


def dedup_stream(stream: DataFrame, mode: str, time: str, delay: str, fk_columns: Sequence[str] = (), ignore: Sequence[str] = ()) -> DataFrame:
    """First row of each record hash within the watermark ``delay`` on ``time``."""
    if mode == "reference":
        return stream
    hashed = stream.withColumn("record_hash", record_hash(stream, compared_columns(stream, mode, fk_columns, ignore)))
    return hashed.withWatermark(time, delay).dropDuplicatesWithinWatermark(["record_hash"])
