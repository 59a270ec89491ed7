r"""Chat formatting in budgeted windows, in DataFrame functions.

Prefix sums of turn tokens (words plus four for the marks) place every turn; turns whose sums begin in the same stride
form a window.  The stride is the budget less the system turn, less the repeated turns and one turn more at the
conversation's longest, so a window keeps to the budget whenever its turns allow (``over_budget`` marks the others:
turns are never cut).  A window holds the system turn, the last ``history`` turns before it (both marked as seen),
and its own turns.  Only own assistant texts are under the loss mask, so every target counts once.

Prefix sums run in blocks of 1024 turn numbers and then over block totals, so a conversation of a third of all rows
is spread over tasks; repeated turns are fetched by an equi-join on conversation and place.

Template: ``<|turn|>role<|text|>text<|end|>`` (``<|seen|>`` for repeated turns).  In roles and texts ``\`` is written
``\s``, ``<`` is written ``\l`` and ``[`` is written ``\b``: no control string survives inside, and it reads back exactly.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilwork.llm.store import Workspace

TURN, SEEN, TEXT, END = "<|turn|>", "<|seen|>", "<|text|>", "<|end|>"
BLOCK = 1024
DIGEST = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long"
)


def escape(text: Column) -> Column:
    for plain, written in (("\\", "\\s"), ("<", "\\l"), ("[", "\\b")):
        text = F.replace(text, F.lit(plain), F.lit(written))
    return text


def unescape(text: Column) -> Column:
    for plain, written in (("[", "\\b"), ("<", "\\l"), ("\\", "\\s")):
        text = F.replace(text, F.lit(written), F.lit(plain))
    return text


def format_windows(
    conversations: DataFrame,
    conv_column: str = "conv_id",
    turn_column: str = "turn",
    role_column: str = "role",
    text_column: str = "text",
    budget: int = 1024,
    history: int = 2,
) -> DataFrame:
    """``conv_id, window, n_tokens, over_budget, formatted, loss`` per window.

    ``loss`` has start and end (code points, end exclusive) of every target in ``formatted``.  Null roles and texts
    count as empty; rows without a conversation are one conversation; turns are ordered by number (null first), then
    role, then text, so ties and repeated rows have a defined place.
    """
    space = Workspace(conversations.sparkSession, "chat")
    turn = F.col(turn_column).cast("long")
    rows = conversations.select(
        F.col(conv_column).cast("long").alias("conv"),
        turn.alias("turn"),
        F.floor(turn / BLOCK).alias("block"),
        F.coalesce(F.col(role_column).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"),
    ).withColumn("tokens", F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")) + 4)
    inside = Window.partitionBy("conv", "block").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumns({"at": F.row_number().over(inside.rowsBetween(Window.unboundedPreceding, 0)), "sum": F.sum("tokens").over(inside)})
    placed = space.save(placed, "placed")
    system = F.when(F.col("role") == "system", F.struct("at", "tokens"))
    totals = placed.groupBy("conv", "block").agg(
        F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("all"), F.max("tokens").alias("longest"), F.min(system).alias("system")
    )
    blocks = Window.partitionBy("conv")
    before = blocks.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumns(
        {
            "n_before": F.coalesce(F.sum("n").over(before), F.lit(0)),
            "sum_before": F.coalesce(F.sum("all").over(before), F.lit(0)),
            "longest": F.max("longest").over(blocks),
        }
    )
    first = F.when(F.col("system").isNotNull(), F.struct((F.col("n_before") + F.col("system.at") - 1).alias("place"), F.col("system.tokens").alias("tokens")))
    offsets = offsets.withColumn("first", F.min(first).over(blocks)).select(
        F.col("conv").alias("c"), F.col("block").alias("b"), "n_before", "sum_before", "longest", "first"
    )
    offsets = space.save(offsets, "offsets")
    stride = F.greatest(F.lit(1), F.lit(budget) - F.coalesce("first.tokens", F.lit(0)) - (history + 1) * F.col("longest"))
    turns = placed.join(offsets, placed["conv"].eqNullSafe(offsets["c"]) & placed["block"].eqNullSafe(offsets["b"])).select(
        "conv",
        (F.col("n_before") + F.col("at") - 1).alias("place"),
        F.floor((F.col("sum_before") + F.col("sum") - F.col("tokens")) / stride).alias("window"),
        F.col("first.place").alias("system"),
        "tokens",
        (F.col("role") == "assistant").alias("target"),
        escape(F.col("role")).alias("role"),
        escape(F.col("text")).alias("text"),
    )
    turns = space.save(turns, "turns")
    windows = turns.groupBy("conv", "window").agg(F.min("place").alias("start"), F.first("system").alias("system"))
    earlier = F.filter(F.sequence(F.col("start") - history, F.col("start") - 1), lambda p: p >= 0) if history else F.array().cast("array<long>")
    kept = F.when(F.col("system") < F.col("start") - history, F.array("system")).otherwise(F.array().cast("array<long>"))
    wanted = windows.select(F.col("conv").alias("c"), "window", F.explode(F.concat(kept, earlier)).alias("p"))
    plain = turns.select("conv", "place", "tokens", "role", "text")
    seen = wanted.join(plain, wanted["c"].eqNullSafe(plain["conv"]) & (wanted["p"] == plain["place"])).select(
        "conv", "window", "place", "tokens", "role", "text", F.lit(False).alias("target"), F.lit(SEEN).alias("mark")
    )
    own = turns.select("conv", "window", "place", "tokens", "role", "text", "target", F.lit(TURN).alias("mark"))
    item = F.struct(
        "place",
        F.concat("mark", "role", F.lit(TEXT)).alias("head"),
        F.concat("text", F.lit(END)).alias("tail"),
        "target",
    )
    grouped = own.unionByName(seen).groupBy("conv", "window").agg(
        F.sum("tokens").alias("n_tokens"), F.sort_array(F.collect_list(item)).alias("items")
    )

    def mask(so_far: Column, x: Column) -> Column:
        start = so_far["at"] + F.length(x["head"])
        end = start + F.length(x["tail"])
        span = F.array(F.struct(start.alias("start"), (end - len(END)).alias("end")))
        return F.struct(end.alias("at"), F.when(x["target"], F.concat(so_far["out"], span)).otherwise(so_far["out"]).alias("out"))

    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))
    return grouped.select(
        F.col("conv").alias("conv_id"),
        "window",
        "n_tokens",
        (F.col("n_tokens") > budget).alias("over_budget"),
        F.array_join(F.transform("items", lambda x: F.concat(x["head"], x["tail"])), "").alias("formatted"),
        F.aggregate("items", empty, mask, lambda s: s["out"]).alias("loss"),
    )


def read_back(windows: DataFrame) -> DataFrame:
    """``conv_id, window, turns, targets, formatted_chars``: own turns (role, text) and targets, read from the output."""
    parts = F.split("formatted", r"<\|end\|>", -1)
    own = F.filter(parts, lambda p: p.startswith(TURN))

    def turn(p: Column) -> Column:
        body = F.substring(p, F.lit(len(TURN) + 1), F.length(p))
        role, text = F.substring_index(body, TEXT, 1), F.substring_index(body, TEXT, -1)
        return F.struct(unescape(role).alias("role"), unescape(text).alias("text"))

    whole = F.col("formatted")
    return windows.select(
        "conv_id",
        "window",
        F.transform(own, turn).alias("turns"),
        F.transform("loss", lambda s: unescape(F.substring(whole, s["start"] + 1, s["end"] - s["start"]))).alias("targets"),
        F.length("formatted").alias("formatted_chars"),
    )


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by conversation and window: hashes grow along, a conversation is never held whole."""
    key, state = (), None

    def row() -> pa.RecordBatch:
        n, turns, chars, loss, formatted, windows = state
        values = (key[0], n, turns.hexdigest(), chars, loss.hexdigest(), formatted, windows)
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
        names = [f.split()[0] for f in DIGEST.split(", ")]
        return pa.record_batch([pa.array([v], t) for v, t in zip(values, kinds, strict=True)], names=names)

    for batch in batches:
        for r in batch.to_pylist():
            if key != (r["conv_id"],):
                if state:
                    yield row()
                key, state = (r["conv_id"],), [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
            for t in r["turns"]:
                state[1].update(f"{t['role']}\n{t['text']}\n".encode())
            for t in r["targets"]:
                state[2] += len(t)
                state[3].update(t.encode())
            state[0] += len(r["turns"])
            state[4] += r["formatted_chars"]
            state[5] += 1
    if state:
        yield row()


def digests(windows: DataFrame) -> DataFrame:
    """One row per conversation, from its windows as read back."""
    ordered = read_back(windows).repartition("conv_id").sortWithinPartitions("conv_id", "window")
    return ordered.mapInArrow(_digest, DIGEST)
