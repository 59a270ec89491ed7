"""Repairs after generation: foreign keys, allowed values, date order, uniqueness, types."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilwork.functions import draws, names
from veilwork.functions.ordering import cell_offsets, range_splitters, with_range
from veilwork.operators.fetching import RID, Draw, fetch
from veilwork.operators.policies import ColumnPolicy, Strategy, allowed_list
from veilwork.operators.profile import is_numeric
from veilwork.operators.relations import Edge


def key_groups(table: str, child: DataFrame, edges: Iterable[Edge], generated: dict[str, DataFrame]) -> list[tuple[str, dict[str, str]]]:
    """(parent, {child column: parent column}): keys of several columns stay together; the last edge of a column wins.

    Two columns that point at one parent column are two keys.
    """
    last: dict[str, Edge] = {}
    for e in edges:
        parent = generated.get(e.target_table)
        if e.source_table.upper() == table.upper() and e.source_column in child.columns and parent is not None:
            if e.target_column in parent.columns:
                last[e.source_column] = e
    groups: list[tuple[str, dict[str, str]]] = []
    for column, e in last.items():
        open_group = next((g for t, g in groups if t == e.target_table and e.target_column not in g.values()), None)
        if open_group is None:
            groups.append((e.target_table, {column: e.target_column}))
        else:
            open_group[column] = e.target_column
    return groups


def stitch_foreign_keys(table: str, child: DataFrame, edges: Iterable[Edge], generated: dict[str, DataFrame], seed: int | str = 42) -> DataFrame:
    """Replace every non-null foreign key by the key of a parent row drawn with replacement.

    All columns of a key come from one parent row.  The child meets all drawn keys by row number, so it is
    shuffled once however many parents it has.
    """
    order, kinds, fixed = child.columns, dict((f.name, f.dataType) for f in child.schema.fields), {}
    narrow = child
    for i, (name, group) in enumerate(key_groups(table, child, edges, generated)):
        parent = generated[name]
        values = parent.where(reduce(and_, [F.col(c).isNotNull() for c in group.values()]))
        size = values.agg(F.count(F.lit(1))).scalar()
        some = reduce(or_, [F.col(c).isNotNull() for c in group])
        position = F.when(some, draws.pick(size, seed, next(iter(group)), F.col(RID)))
        unique = [RID] if RID in parent.columns else list(group.values())
        drawn = fetch(narrow.select(RID, *group), values, unique, seed, [Draw(position, tuple(group.values()))])
        drawn = drawn.select(RID, *[F.col(theirs).alias(f"_k{i}_{own}") for own, theirs in group.items()])
        child = child.join(drawn, RID, "left")
        fixed |= {c: F.when(F.col(c).isNotNull(), F.col(f"_k{i}_{c}").cast(kinds[c])) for c in group}
    return child.withColumns(fixed).select(*order) if fixed else child


def enforce_allowed(df: DataFrame, policies: Iterable[ColumnPolicy], seed: int | str = 42) -> DataFrame:
    """Redraw values outside a column's allowed list; NULL stays."""
    fixed = {}
    for p in policies:
        values = allowed_list(p.allowed_values)
        if not values or p.column_name not in df.columns:
            continue
        kind = df.schema[p.column_name].dataType
        typed = [F.lit(v).try_cast(kind) for v in values]
        column = F.col(p.column_name)
        redrawn = draws.pick_from(values, seed, "allowed", p.column_name, F.col(RID)).try_cast(kind)
        fixed[p.column_name] = F.when(column.isNull() | column.isin(*typed), column).otherwise(redrawn)
    return df.withColumns(fixed) if fixed else df


def as_moment(df: DataFrame, column: str) -> Column:
    """The column as a timestamp; text that is no date gives NULL."""
    if isinstance(df.schema[column].dataType, T.StringType):
        return F.try_to_timestamp(F.col(column))
    return F.col(column).try_cast("timestamp")


def enforce_date_order(df: DataFrame, strategy: Strategy) -> DataFrame:
    """Swap two dates where the earlier one lies after the later one."""
    for earlier, later in strategy.temporal:
        if earlier in df.columns and later in df.columns:
            wrong = as_moment(df, earlier) > as_moment(df, later)
            df = df.withColumns(
                {
                    earlier: F.when(wrong, F.col(later)).otherwise(F.col(earlier)),
                    later: F.when(wrong, F.col(earlier)).otherwise(F.col(later)),
                }
            )
    return df


def duplicated_columns(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """The columns in which any value occurs twice, NULL counting as a value; all are tested in one aggregate."""
    if not columns:
        return []
    pairs = F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"`{c}`").cast("string").alias("v")) for i, c in enumerate(columns)])
    counted = df.select(F.explode(pairs).alias("_p")).groupBy("_p.i", "_p.v").agg(F.count(F.lit(1)).alias("n"))
    again = {r["i"] for r in counted.where("n > 1").select("i").distinct().collect()}  # a row per column
    return [c for i, c in enumerate(columns) if i in again]


def _present_numbers(df: DataFrame, columns: Sequence[str], order: str) -> DataFrame:
    """``order`` and, per column, how many rows up to this one have a value there; only these narrow columns are sorted."""
    flags = {f"_n{i}": F.col(f"`{c}`").isNotNull().cast("long") for i, c in enumerate(columns)}
    narrow = df.select(order, *[v.alias(n) for n, v in flags.items()])
    if order == RID:
        celled = narrow.withColumn("_cell", F.floor(F.col(RID) / ROWS_PER_CELL))
    else:
        celled = with_range(narrow, [order], range_splitters(narrow, [order], narrow.count()), "_cell")
    sizes = celled.groupBy("_cell").agg(*[F.sum(n).alias(n) for n in flags])
    for n in flags:
        sizes = cell_offsets(sizes, [], ["_cell"], n, f"_o{n}")
    upto = Window.partitionBy("_cell").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = celled.select(order, "_cell", *[F.sum(n).over(upto).alias(n) for n in flags])
    placed = summed.join(sizes.select("_cell", *[f"_o{n}" for n in flags]), "_cell")
    return placed.select(order, *[(F.col(n) + F.col(f"_o{n}")).alias(n) for n in flags])


def enforce_unique(df: DataFrame, policies: Iterable[ColumnPolicy], edges: Iterable[Edge], order: str = RID, counted: DataFrame | None = None) -> DataFrame:
    """Renumber entity identifiers that hold a duplicate: 1..k, or ``COLUMN_000001`` for text; NULLs keep their place.

    ``counted`` is a frame with the same identifiers in which looking for duplicates is cheaper, such as a written
    table ``df`` was made from.  Nothing is sorted or joined where no identifier holds a duplicate; else the numbers of
    all that do are made from ``order`` (unique) and meet the rows in one join.
    """
    foreign = {e.source_column for e in edges}
    chosen = [
        p.column_name
        for p in policies
        if p.column_name in df.columns
        and p.column_name not in foreign
        and p.dedup_mode == "entity"
        and names.has_token(p.column_name, names.ENTITY_ID_TOKENS)
        and not names.has_token(p.column_name, names.DATE_TOKENS)
    ]
    seen = df if counted is None else counted
    again = duplicated_columns(seen, list(dict.fromkeys(chosen)))
    if not again:
        return df
    kinds, fresh = {f.name: f.dataType for f in df.schema.fields}, {}
    for i, c in enumerate(again):
        number = F.col(f"_n{i}")
        text = number.cast("string")
        padded = F.concat(F.lit(f"{c}_"), F.lpad(text, F.greatest(F.length(text), F.lit(6)), F.lit("0")))
        fresh[c] = F.when(F.col(f"`{c}`").isNotNull(), number.cast(kinds[c]) if is_numeric(kinds[c]) else padded)
    return df.join(_present_numbers(seen, again, order), order).withColumns(fresh).select(*df.columns)


def restore_types(df: DataFrame, source: DataFrame) -> DataFrame:
    """Cast generated columns to the source's types; what does not fit becomes NULL."""
    types = {f.name: f.dataType for f in source.schema.fields}
    return df.select(*[F.col(c).try_cast(types[c]).alias(c) if c in types else F.col(c) for c in df.columns])


ROWS_PER_CELL = 1 << 20


def repair(table: str, df: DataFrame, edges: Iterable[Edge], generated: dict[str, DataFrame], policies: Iterable[ColumnPolicy], strategy: Strategy, seed: int | str = 42) -> DataFrame:
    """Foreign keys, then allowed values, then date order, then uniqueness."""
    edges, policies = list(edges), list(policies)
    drawn = df
    df = stitch_foreign_keys(table, df, edges, generated, seed)
    df = enforce_allowed(df, policies, seed)
    df = enforce_date_order(df, strategy)
    # identifiers are no foreign keys or dates, so only allowed lists can have changed them
    changed = any(p.dedup_mode == "entity" and allowed_list(p.allowed_values) for p in policies)
    own = [e for e in edges if e.source_table.upper() == table.upper()]
    return enforce_unique(df, policies, own, counted=None if changed else drawn)
