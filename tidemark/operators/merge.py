"""Set maintenance of event logs: duplicates, change sets, merges. Keys without a value count as the empty string."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .carry import numbered

#: Equal rows that are written from one row at once.
_REPEATS = 10_000
#: Two events are the same observation whatever device reported them.
EVENT_KEY = ("tenant_id", "timestamp", "event_kind", "category", "name")


def _key(df: DataFrame, apart: Sequence[str] = ()) -> DataFrame:
    """df with its event key; the expressions `apart` tell equal events apart, as columns _apart0 and so on."""
    blank = {"category", "name"}
    key = F.struct(*[(F.coalesce(c, F.lit("")) if c in blank else F.col(c)).alias(c) for c in EVENT_KEY])
    return df.select("*", key.alias("_key"), *[F.expr(x).alias(n) for x, n in zip(apart, _names(apart), strict=True)])


def _names(apart: Sequence[str]) -> list[str]:
    return [f"_apart{i}" for i in range(len(apart))]


def canonical_ids(events: DataFrame) -> DataFrame:
    """tenant_id, id, canonical_id: the smallest id of each event's duplicates."""
    low = _key(events).groupBy("_key").agg(F.min("id").alias("canonical_id"))
    return _key(events).join(low, "_key").select("tenant_id", "id", "canonical_id")


def deduplicate(events: DataFrame, apart: Sequence[str] = ()) -> DataFrame:
    """Of equal events the one with the smallest id."""
    low = F.min_by(F.struct(*events.columns), "id")
    return _key(events, apart).groupBy("_key", *_names(apart)).agg(low.alias("e")).select("e.*")


def new_events(incoming: DataFrame, stored: DataFrame, apart: Sequence[str] = ()) -> DataFrame:
    """Incoming events without those stored already; of repeats the first. Equal events that differ in an expression of
    `apart` are no repeats."""
    keys = ["_key", *_names(apart)]
    fresh = _key(deduplicate(incoming, apart), apart).join(_key(stored, apart).select(keys).distinct(), keys, "left_anti")
    return fresh.drop(*keys)


def judge_incoming(stored: DataFrame, incoming: DataFrame, apart: Sequence[str] = ()) -> DataFrame:
    """A row for each distinct event of the import: first (the one with the smallest id), n (how often it comes), whether the
    stored events have it already, and whether it counts as new. One scan of each table and one shuffle of keys.

    Equal events that differ in an expression of `apart` are distinct; only the one with the smallest id, stored ones
    included, counts as new."""
    columns = incoming.columns
    row = F.struct(*columns)
    keys = ["_key", *_names(apart)]
    both = _key(incoming, apart).select(*keys, row.alias("row"), "id", F.lit(1).alias("n"), F.lit(False).alias("old"))
    nothing = F.lit(None).cast(both.schema["row"].dataType)
    both = both.unionByName(_key(stored, apart).select(*keys, nothing.alias("row"), "id", F.lit(0).alias("n"), F.lit(True).alias("old")))
    first = F.min_by("row", F.when(~F.col("old"), F.col("id")))
    found = (both.repartition("_key") if apart else both).groupBy(*keys)
    judged = found.agg(first.alias("first"), F.sum("n").alias("n"), F.bool_or("old").alias("known"), F.min("id").alias("low"))
    new = ~F.col("known")
    if apart:
        new &= F.col("low") == F.min("low").over(Window.partitionBy("_key"))
    return judged.withColumn("new", new).filter("n > 0").drop(*keys, "low")


def repoint(table: DataFrame, ids: DataFrame, columns: list[str]) -> DataFrame:
    """table with its event ids replaced by their canonical ones."""
    for c in columns:
        table = table.join(ids.select("tenant_id", F.col("id").alias(c), F.col("canonical_id").alias("_new")), ["tenant_id", c], "left").withColumn(c, F.coalesce("_new", c)).drop("_new")
    return table


def import_counts(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Per tenant: rows of the import, new ones, duplicates, first and last time."""
    total = incoming.groupBy("tenant_id").agg(F.count("*").alias("total"), F.min("timestamp").alias("first_timestamp"), F.max("timestamp").alias("last_timestamp"))
    new = new_events(incoming, stored).groupBy("tenant_id").agg(F.count("*").alias("new"))
    out = total.join(new, "tenant_id", "left").withColumn("new", F.coalesce("new", F.lit(0)))
    return out.withColumn("duplicates", F.col("total") - F.col("new"))


def _judged_changes(events: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events after the changes, before equal ones are merged; all rows with the reason of a rejection)."""
    values = [c for c in events.columns if c not in ("tenant_id", "id", "revision")]
    new = changes.select("tenant_id", "id", "op", "expected_revision", *[F.col(c).alias(f"new_{c}") for c in values])
    both = events.join(new, ["tenant_id", "id"], "full_outer")
    stale = F.col("op").isNotNull() & ~F.col("revision").eqNullSafe(F.col("expected_revision"))
    nothing = (F.col("op") == "delete") & F.col("revision").isNull()
    state = both.withColumn("reason", F.when(nothing, "missing").when(stale, "stale revision"))
    changed = (F.col("op") == "upsert") & F.col("reason").isNull()
    picked = [F.when(changed, F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) for c in values]
    kept = state.filter(F.col("revision").isNotNull() | changed).filter(~F.coalesce((F.col("op") == "delete") & F.col("reason").isNull(), F.lit(False)))
    revision = F.when(changed, F.coalesce("revision", F.lit(0)) + 1).otherwise(F.col("revision"))
    return kept.select("tenant_id", "id", *picked, revision.alias("revision")).select(events.columns), state


def apply_changes(events: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events after the changes, rejected changes). changes: tenant_id, id, op (upsert or delete), expected_revision and new
    values; a stale revision or a deletion of nothing is rejected. An event that becomes equal to another merges into it."""
    kept, state = _judged_changes(events, changes)
    return deduplicate(kept), state.filter("reason is not null").select("tenant_id", "id", "op", "expected_revision", "revision", "reason")


def redirects(events: DataFrame, changes: DataFrame) -> DataFrame:
    """tenant_id, id, canonical_id: where the ids went that apply_changes merges into others. With repoint(), every table that
    names an event follows."""
    return canonical_ids(_judged_changes(events, changes)[0]).filter("id <> canonical_id")


def then(first: DataFrame, second: DataFrame) -> DataFrame:
    """The redirects of two change sets, one after the other, as one: chains end at the last id."""
    onward = second.select("tenant_id", F.col("id").alias("canonical_id"), F.col("canonical_id").alias("_last"))
    moved = first.join(onward, ["tenant_id", "canonical_id"], "left").select("tenant_id", "id", F.coalesce("_last", "canonical_id").alias("canonical_id"))
    return moved.unionByName(second.join(first.select("tenant_id", "id"), ["tenant_id", "id"], "left_anti").select("tenant_id", "id", "canonical_id"))


def gone_ids(events: DataFrame, changes: DataFrame) -> DataFrame:
    """tenant_id, id: events that the changes delete, so that no redirect leads on from them."""
    kept, _ = _judged_changes(events, changes)
    return events.select("tenant_id", "id").join(kept.select("tenant_id", "id"), ["tenant_id", "id"], "left_anti")


def relabel(events: DataFrame, where: Column, category: Column, name: Column) -> DataFrame:
    hit = F.coalesce(where, F.lit(False))
    changed = events.withColumns({"category": F.when(hit, category).otherwise(F.col("category")), "name": F.when(hit, name).otherwise(F.col("name"))})
    return deduplicate(changed)


def delete_where(events: DataFrame, where: Column) -> DataFrame:
    return events.filter(~F.coalesce(where, F.lit(False)))


def remove_chunk_events(events: DataFrame, chunks: DataFrame) -> DataFrame:
    """events without the two source events of each chunk."""
    ids = chunks.select("tenant_id", F.explode(F.array("start_event_id", "end_event_id")).alias("id")).distinct()
    return events.join(ids, ["tenant_id", "id"], "left_anti")


def upsert_by(stored: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Incoming rows replace stored ones of the same keys with the next revision."""
    old = stored.select(*keys, F.col("revision").alias("_old"))
    new = incoming.join(old, keys, "left").withColumn("revision", F.coalesce(F.col("_old") + 1, F.lit(1).cast("long"))).drop("_old")
    return stored.join(incoming.select(keys), keys, "left_anti").unionByName(new.select(stored.columns))


def append_new_rows(master: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming rows that the master lacks. Equal rows are counted, so a row that occurs more often than in the master is new
    that many times."""
    columns = incoming.columns
    counted = lambda df, n: df.groupBy(*columns).agg(F.count("*").alias(n))
    old = counted(master.select(columns), "_old").withColumnsRenamed({c: f"_{c}" for c in columns})
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in columns])
    more = counted(incoming, "_new").join(old, same, "left").withColumn("_more", F.col("_new") - F.coalesce("_old", F.lit(0))).filter("_more > 0")
    # in two steps, so that no list grows with the count
    blocks = more.select(*columns, "_more", F.explode(F.sequence(F.lit(0), F.expr(f"(_more - 1) div {_REPEATS}"))).alias("_block"))
    each = F.least(F.lit(_REPEATS), F.col("_more") - F.col("_block") * _REPEATS)
    return blocks.select(*columns, F.explode(F.sequence(F.lit(1).cast("long"), each))).select(columns)


def append_observations(stored: DataFrame, incoming: DataFrame, order: list[str]) -> DataFrame:
    """stored points, annotations or context with the incoming rows, whose ids follow the tenant's largest in the given
    order, which begins with the time."""
    last = stored.groupBy("tenant_id").agg(F.max("id").alias("_last"))
    new = numbered(incoming, ["tenant_id"], order, "_n").join(last, "tenant_id", "left").withColumn("id", F.coalesce("_last", F.lit(0)) + F.col("_n"))
    return stored.unionByName(new.drop("_n", "_last"), allowMissingColumns=True).select(stored.columns)


def union_frames(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def delete_markers(markers: DataFrame, doomed: DataFrame, keys: list[str]) -> DataFrame:
    return markers.join(doomed.select(keys).distinct(), keys, "left_anti")
