"""Sales joined to the version of their client that was valid when they were made, as a stateful stream.

Sales and changes come in numbered batches.  ``enrich_sales`` writes them under the shared
folder and starts one streaming query anew for each batch on one checkpoint.  Both tables
have a watermark; Spark's minimum policy makes the smaller one the query's (H).  Rows carry
the largest time of their table's batches so far as event time, so no row is ever late for
Spark, an empty batch (which has one tick row) moves nothing back, and a watermark covers
earlier batches only.

The state holds clients' versions and the sales that wait for H.  Event-time timers fire
where H has passed a waiting sale (it is emitted) or a version (older ones are pruned), also
for clients without rows in a batch.  A Python call for each client would cost more than its
work, so a state key is a group of clients, with the earliest timer of them.

Hot clients (more than ``HOT_SHARE`` of all rows) are cut into ``SLICES`` slices of time at
quantiles of their own times, each a state key.  A slice answers by itself and reports its
count and last version for each batch in which it is called; ``_whole_clients`` puts the
slices together: a slice is dead from the batch after the first one in which a later slice
holds a version at or before H, since that version prunes all of it.  Slices are as even as
times are: equal times of one client stay together.

Spark's watermarks and timers count milliseconds.  Rounded down, they may wake a group too
early, never too late; H itself comes with each start in microseconds, and a group raises if
Spark's watermark isn't H.  Their clock runs from 1900 to 2190; times beyond wake a group as
the ends do.

Handling: changes without ``valid_at`` are ignored; repeated changes (equal in all columns)
count once; changes of equal time and id are ordered by op and cents.  A sale without
``sold_at`` is emitted in its own batch and matches nothing.  Null clients match nothing and
hold nothing.  Null ids come back null (among versions they sort first), a null or infinite
balance gives null cents.  Repeated sales are emitted each for itself.  A batch number below
0 counts as 0.  Empty tables give an empty result.  Other columns are not read, but for the
comparison of repeated changes.  No text is read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from draftmetrics.llm.shared import drop_table, shared_path

#: Rows of all batches that one group of clients holds, about.
GROUP_ROWS = 20_000
#: A client with a larger share of all rows (and more rows than this) is cut into slices of time.
HOT_SHARE, HOT_ROWS, SLICES = 1 / 1024, 10_000, 64
#: Milliseconds from 1900 to 1970, and the clock's end.
SHIFT, TOP = 2_208_988_800_000, 9_200_000_000_000
SALE, CHANGE, LATE, TICK, END, SLICE = range(6)
ID, CLIENT, TIME, CENTS, HIT, HIT_ID, HIT_CENTS, REACHED = (1 << k for k in range(8))

ROW = "grp long, kind int, flags int, client long, t long, id long, cents long, op string, clock timestamp"
OUT = "kind int, flags int, id long, batch long, client long, grp long, n_held long, n_after long, change_id long, cents long, op string"
_VERSION, _WAITING = ["client", "t", "id", "flags", "cents", "op"], ["client", "t", "id", "flags"]
_EMPTY = pd.DataFrame({c: pd.Series(dtype=object if c == "op" else "int64") for c in _VERSION})
_STREAMING = {
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",  # a watermark takes effect with the next batch only
    "spark.sql.streaming.multipleWatermarkPolicy": "min",
    "spark.sql.streaming.minBatchesToRetain": "2",
}


def micros(t: Column) -> Column:
    """Microseconds since 1970 of a timestamp's own reading (with or without a zone, in any session zone)."""
    seconds = F.datediff(t.cast("date"), F.lit("1970-01-01").cast("date")).cast("long") * 86_400 + F.hour(t) * 3_600 + F.minute(t) * 60
    return seconds * 1_000_000 + (F.extract(F.lit("SECOND"), t) * 1_000_000).cast("long")


def clock(t):
    """Microseconds since 1970 (numbers or arrays) as milliseconds of watermarks and timers, rounded down."""
    return np.clip(np.asarray(t, np.int64) // 1000 + SHIFT, 1, TOP)


# -- state of one group ---------------------------------------------------------------


def _pack(df: pd.DataFrame) -> bytes:
    t = pa.Table.from_pandas(df, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, t.schema) as out:
        out.write_table(t)
    return sink.getvalue().to_pybytes()


def _unpack(raw: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(raw).read_pandas()


def _last_version(versions: pd.DataFrame, sales: pd.DataFrame) -> np.ndarray:
    """For each sale the row number of its client's last version at or before its time; -1 without one.

    ``versions`` are in order of (client, time, id).
    """
    n, m = len(versions), len(sales)
    client = np.concatenate([versions["client"].to_numpy(), sales["client"].to_numpy()])
    t = np.concatenate([versions["t"].to_numpy(), sales["t"].to_numpy()])
    order = np.lexsort((np.arange(n + m), t, client))  # versions before sales of their time, in their own order
    last = np.maximum.accumulate(np.where(order < n, np.arange(n + m), -1))
    at = np.where(last >= 0, order[last], -1)
    at[(at >= 0) & (client[at] != client[order])] = -1
    out = np.empty(n + m, np.int64)
    out[order] = at
    usable = (sales["flags"].to_numpy() & (CLIENT | TIME)) == CLIENT | TIME
    return np.where(usable, out[n:], -1)


def _emitted(due: pd.DataFrame, versions: pd.DataFrame, batch: int, grp: int) -> pd.DataFrame:
    """Rows of the sales that leave, with what their clients hold."""
    at = _last_version(versions, due)
    clients, counts = np.unique(versions["client"].to_numpy(), return_counts=True)
    place = np.minimum(np.searchsorted(clients, due["client"].to_numpy()), max(len(clients) - 1, 0))
    known = (due["flags"].to_numpy() & CLIENT) > 0
    held = np.where(known & (clients[place] == due["client"].to_numpy()), counts[place], 0) if len(clients) else np.zeros(len(due), np.int64)
    hit = at >= 0
    chosen = versions.iloc[np.maximum(at, 0)] if len(versions) else None
    pick = lambda c, none: np.where(hit, chosen[c].to_numpy(), none) if chosen is not None else np.full(len(due), none)
    theirs = pick("flags", 0).astype(np.int64)
    flags = due["flags"].to_numpy() | np.where(hit, HIT, 0) | np.where(theirs & ID, HIT_ID, 0) | np.where(theirs & CENTS, HIT_CENTS, 0)
    return _out(SALE, flags, due["id"].to_numpy(), batch, due["client"].to_numpy(), grp, held, 0, pick("id", 0), pick("cents", 0), pick("op", None))


def _out(kind, flags, ids, batch, client, grp, n_held, n_after, change_id, cents, op) -> pd.DataFrame:
    values = dict(zip([x.split()[0] for x in OUT.split(", ")], (kind, flags, ids, batch, client, grp, n_held, n_after, change_id, cents, op)))
    out = pd.DataFrame({"id": ids})
    for name, v in values.items():
        out[name] = v
    return out[list(values)].astype({"kind": "int32", "flags": "int32"} | {c: "int64" for c in ("id", "batch", "client", "grp", "n_held", "n_after", "change_id", "cents")} | {"op": object})


def fold_group(batch: int, groups: int, h: int | None):
    """The function of ``applyInPandasWithState`` for one start; keys from ``groups`` on are slices of hot clients."""
    horizon = np.iinfo(np.int64).min if h is None else h
    expected = 0 if h is None else int(clock(h)) + 1

    def fold(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        grp = int(key[0])
        mark = max(state.getCurrentWatermarkMs(), 0)
        if mark != expected:
            raise ValueError(f"batch {batch}: the watermark is {mark}, not {expected}")
        rows = None if state.hasTimedOut else pd.concat(list(frames), ignore_index=True)
        versions, waiting = map(_unpack, state.get) if state.exists else (_EMPTY, _EMPTY[_WAITING])
        end = False
        if rows is not None:
            late = rows[rows["kind"] == LATE]
            if len(late):
                yield _out(LATE, late["flags"].to_numpy(), late["id"].to_numpy(), batch, late["client"].to_numpy(), grp, 0, 0, 0, 0, None)
            end = bool((rows["kind"] == END).any())
            new = rows.loc[rows["kind"] == CHANGE, _VERSION]
            if len(new):
                versions = pd.concat([versions, new]) if len(versions) else new
                versions = versions.assign(rank=np.where(versions["flags"] & ID, 1, 0), word=versions["op"].fillna("")).sort_values(["client", "t", "rank", "id", "word", "cents"], ignore_index=True)[_VERSION]
            sales = rows.loc[rows["kind"] == SALE, _WAITING]
            if len(sales):
                waiting = pd.concat([waiting, sales], ignore_index=True) if len(waiting) else sales.reset_index(drop=True)
        if len(waiting):
            due = ((waiting["flags"].to_numpy() & TIME) == 0) | (waiting["t"].to_numpy() < horizon) | end
            if due.any():
                yield _emitted(waiting[due], versions, batch, grp)
                waiting = waiting[~due]
        if end:
            state.remove()
            return
        held = len(versions)
        if held:
            passed = versions["t"].to_numpy() <= horizon
            client = versions["client"].to_numpy()
            # a version goes if the next one of its client is at or before H as well (rows are in order)
            older = np.append(passed[1:] & (client[1:] == client[:-1]), False)
            versions = versions[~older]
            if grp >= groups:
                last = versions.iloc[-1]
                flags = int(last["flags"]) | (REACHED if passed.any() else 0)
                yield _out(SLICE, [flags], [0], batch, [int(last["client"])], grp, held, len(versions), int(last["id"]), int(last["cents"]), [last["op"]])
        if not len(versions) and not len(waiting):
            if state.exists:
                state.remove()
            return
        state.update((_pack(versions), _pack(waiting)))
        ahead = versions["t"].to_numpy().astype(np.int64)
        wake = np.concatenate([ahead[ahead > horizon], waiting["t"].to_numpy().astype(np.int64)])
        if len(wake):
            state.setTimeoutTimestamp(max(int(clock(wake.min())), mark, 1))  # it fires where the watermark is larger

    return fold


# -- batches on disk -------------------------------------------------------------------


def _highest(rows: DataFrame, batches: int) -> list[int | None]:
    """The largest time of each batch and those before it."""
    found = {r["batch"]: r["t"] for r in rows.groupBy("batch").agg(F.max("t").alias("t")).collect()}  # a row for each batch
    out: list[int | None] = []
    for k in range(batches):
        seen = [x for x in (found.get(k), out[-1] if out else None) if x is not None]
        out.append(max(seen) if seen else None)
    return out


def _hot_clients(rows: DataFrame, n: int, share: float, least: int) -> DataFrame:
    """(client, hot, bounds): clients with many rows (fewer than 1 / share), numbered, with the ends of their slices."""
    many = [r["client"] for r in rows.filter("client IS NOT NULL").groupBy("client").count().filter(F.col("count") > max(least, int(n * share))).collect()]  # fewer than 1 / share
    at = F.percentile_approx("t", [k / SLICES for k in range(1, SLICES)], 1000)
    bounds = rows.filter(F.col("client").isin(many)).groupBy("client").agg(at.alias("bounds"))
    return bounds.select("client", (F.row_number().over(Window.orderBy("client")) - 1).alias("hot"), F.coalesce("bounds", F.array().cast("array<long>")).alias("bounds"))


def _groups(rows: DataFrame, hot: DataFrame, groups: int) -> DataFrame:
    """``rows`` with their state key."""
    placed = rows.join(F.broadcast(hot), "client", "left")  # 1 / HOT_SHARE rows of SLICES numbers at most
    index = F.size(F.filter("bounds", lambda b: b <= F.coalesce(F.col("t"), F.lit(-(1 << 62)))))
    plain = F.pmod(F.xxhash64(F.coalesce("client", "id", F.lit(0))), F.lit(groups))
    return placed.withColumn("grp", F.when(F.col("hot").isNotNull(), groups + F.col("hot") * SLICES + index).otherwise(plain).cast("long")).drop("hot", "bounds")


def _flag(bit: int, c: Column) -> Column:
    return F.when(c.isNotNull(), bit).otherwise(0)


def _write(rows: DataFrame, top: list[int | None], batches: int, path: str, extra: DataFrame | None = None) -> None:
    """One folder for each batch, with the largest time so far as event time and at least a tick."""
    spark = rows.sparkSession
    marks = F.array(*[F.lit(0 if x is None else int(clock(x)) + 1) for x in [*top, top[-1]]])
    zero = lambda kind: [F.lit(kind).alias("kind"), F.lit(0).alias("flags"), *[F.lit(0).cast("long").alias(c) for c in ("client", "t", "id", "cents")], F.lit(None).cast("string").alias("op")]
    ticks = spark.range(batches + 1).select(F.lit(0).cast("long").alias("grp"), *zero(TICK), F.col("id").alias("batch"))
    flags = _flag(ID, F.col("id")) + _flag(CLIENT, F.col("client")) + _flag(TIME, F.col("t")) + _flag(CENTS, F.col("cents"))
    full = rows.select("grp", "kind", flags.alias("flags"), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("client", "t", "id", "cents")], "op", "batch").unionByName(ticks)
    if extra is not None:
        full = full.unionByName(extra.select("grp", *zero(END), F.lit(batches).cast("long").alias("batch")))
    # a millisecond above the watermark that it makes, so it is never late
    event = F.timestamp_millis(F.element_at(marks, F.col("batch").cast("int") + 1) + 1)
    full.withColumn("clock", event).select(*[x.split()[0] for x in ROW.split(", ")], "batch").write.partitionBy("batch").option("compression", "zstd").parquet(path)


# -- slices of hot clients ----------------------------------------------------------------


def _whole_clients(out: DataFrame, groups: int, batches: int) -> DataFrame:
    """Rows of hot clients' sales with the count and version of the whole client (see the module's text)."""
    own = out.withColumn("slice", F.pmod(F.col("grp") - groups, F.lit(SLICES)))
    said = own.filter(F.col("kind") == SLICE)
    last = F.struct(*[F.col(c).alias(c) for c in ("flags", "change_id", "cents", "op")])
    each = said.groupBy("client", "slice").agg(F.min(F.when(F.col("flags").bitwiseAND(REACHED) > 0, F.col("batch"))).alias("reached"))
    above = Window.partitionBy("client").orderBy("slice").rowsBetween(1, Window.unboundedFollowing)
    # every slice and batch: HOT clients x SLICES x batches rows
    grid = each.select("client").distinct().withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1)))).withColumn("slice", F.col("slice").cast("long")).join(each, ["client", "slice"], "left").withColumn("dies", F.min("reached").over(above))
    grid = grid.withColumn("batch", F.explode(F.sequence(F.lit(0), F.lit(batches)))).withColumn("batch", F.col("batch").cast("long"))
    grid = grid.join(said.select("client", "slice", "batch", "n_held", "n_after", last.alias("last")), ["client", "slice", "batch"], "left")
    so_far = Window.partitionBy("client", "slice").orderBy("batch")
    grid = grid.withColumn("held", F.coalesce("n_held", F.last("n_after", True).over(so_far.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("last", F.last("last", True).over(so_far.rowsBetween(Window.unboundedPreceding, 0))).withColumn("alive", F.col("dies").isNull() | (F.col("dies") >= F.col("batch")))
    all_of_it = Window.partitionBy("client", "batch")
    below = all_of_it.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    before = F.last(F.when(F.col("last").isNotNull(), F.struct("alive", "last")), True).over(below)
    grid = grid.select("client", "slice", "batch", "alive", F.sum(F.when(F.col("alive"), F.col("held")).otherwise(0)).over(all_of_it).alias("whole"), before.alias("before"))
    sales = own.filter(F.col("kind") == SALE)
    joined = sales.drop("n_held").join(grid, ["client", "slice", "batch"], "left").withColumn("n_held", F.coalesce("whole", F.lit(0)))
    alive = F.coalesce("alive", F.lit(True))
    mine = alive & (F.col("flags").bitwiseAND(HIT) > 0)
    timed = F.col("flags").bitwiseAND(TIME) > 0
    other = alive & timed & (F.col("flags").bitwiseAND(HIT) == 0) & F.coalesce(F.col("before.alive"), F.lit(False))
    theirs = F.col("before.last.flags")
    hit = F.when(mine, F.col("flags").bitwiseAND(HIT | HIT_ID | HIT_CENTS)).when(other, HIT + F.when(theirs.bitwiseAND(ID) > 0, HIT_ID).otherwise(0) + F.when(theirs.bitwiseAND(CENTS) > 0, HIT_CENTS).otherwise(0)).otherwise(0)
    take = lambda c: F.when(mine, F.col(c)).when(other, F.col(f"before.last.{c}"))
    return joined.select("kind", (F.col("flags").bitwiseAND(ID | CLIENT | TIME | CENTS) + hit).cast("int").alias("flags"), "id", "batch", "n_held", take("change_id").alias("change_id"), take("cents").alias("cents"), take("op").alias("op"))


# -- the operator -----------------------------------------------------------------------


def enrich_sales(sales: DataFrame, changes: DataFrame, sale_batch: Column, change_batch: Column, batches: int, delay_hours: float = 0, group_rows: int = GROUP_ROWS, hot_share: float = HOT_SHARE, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(rec, id, batch, n_held, change_id, balance_cents, op) of every sale and late change.

    ``sale_batch`` and ``change_batch`` number the rows' batches from 0 to ``batches`` - 1;
    sales that still wait after the last one are emitted as batch ``batches``.
    """
    spark = sales.sparkSession
    delay = int(delay_hours * 3_600_000_000)
    number = lambda c: F.greatest(c, F.lit(0)).cast("long")
    made = sales.select(F.col("sale_id").cast("long").alias("id"), F.col("client_id").cast("long").alias("client"), micros(F.col("sold_at")).alias("t"), number(sale_batch).alias("batch"), F.lit(SALE).alias("kind"), F.lit(None).cast("long").alias("cents"), F.lit(None).cast("string").alias("op"))
    cents = F.when(F.abs("balance") < 9e16, F.floor(F.col("balance") * 100 + 0.5))
    once = changes.distinct().filter(F.col("valid_at").isNotNull())
    versions = once.select(F.col("change_id").cast("long").alias("id"), F.col("client_id").cast("long").alias("client"), micros(F.col("valid_at")).alias("t"), number(change_batch).alias("batch"), cents.cast("long").alias("cents"), F.col("op").cast("string").alias("op"))
    lower = lambda top: [None if x is None else x - delay for x in top]
    sold_top = lower(_highest(made, batches))
    # repeated rows change no maximum
    valid_top = lower(_highest(changes.filter(F.col("valid_at").isNotNull()).select(number(change_batch).alias("batch"), micros(F.col("valid_at")).alias("t")), batches))
    own_mark = F.element_at(F.array(*[F.lit(x).cast("long") for x in [None, *valid_top]]), F.col("batch").cast("int") + 1)
    versions = versions.withColumn("kind", F.when(F.col("t") < own_mark, LATE).otherwise(F.when(F.col("client").isNull(), TICK).otherwise(CHANGE)))  # a client's versions only

    both = made.select("client", "t").unionAll(changes.select(F.col("client_id").cast("long").alias("client"), micros(F.col("valid_at")).alias("t")))
    n = both.count()
    groups = max(8, min(1 << 20, -(-n // group_rows)))
    hot_path = shared_path(spark, "hot-clients")
    _hot_clients(both, n, hot_share, hot_rows).write.parquet(hot_path)
    hot = spark.read.schema("client long, hot int, bounds array<long>").parquet(hot_path)
    n_hot = hot.count()
    sold_path, valid_path, out_path, state_path = (shared_path(spark, x) for x in ("sale-batches", "change-batches", "enriched", "enrichment-state"))
    _write(_groups(made, hot, groups), sold_top, batches, sold_path, spark.range(groups + n_hot * SLICES).withColumnRenamed("id", "grp"))
    _write(_groups(versions, hot, groups), valid_top, batches, valid_path)

    before = {k: spark.conf.get(k) for k in _STREAMING}
    try:
        for k, v in _STREAMING.items():
            spark.conf.set(k, v)
        for k in range(batches + 1):
            tops = (sold_top[k - 1], valid_top[k - 1]) if k else (None, None)
            h = None if None in tops else min(tops)
            seen = "batch={" + ",".join(map(str, range(k + 1))) + "}"  # a batch's folder appears to the query with its start
            feed = [spark.readStream.schema(ROW).option("basePath", path).parquet(f"{path}/{seen}").drop("batch").withWatermark("clock", "1 millisecond") for path in (sold_path, valid_path)]
            folded = feed[0].unionAll(feed[1]).groupBy("grp").applyInPandasWithState(fold_group(k, groups, h), OUT, "versions binary, waiting binary", "append", "EventTimeTimeout")
            # more tasks than four for each core only cost their start and a file each
            folded.coalesce(4 * spark.sparkContext.defaultParallelism).writeStream.format("parquet").outputMode("append").option("path", out_path).option("checkpointLocation", state_path).trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    for path in (sold_path, valid_path, state_path, hot_path):
        drop_table(spark, path)

    out = spark.read.schema(OUT).parquet(out_path)
    plain = ["kind", "flags", "id", "batch", "n_held", "change_id", "cents", "op"]
    whole = out.filter((F.col("kind") == LATE) | (F.col("kind") == SALE) & (F.col("grp") < groups)).select(*plain)
    if n_hot:
        whole = whole.unionByName(_whole_clients(out.filter(F.col("grp") >= groups), groups, batches).select(*plain))
    sale = F.col("kind") == SALE
    has = lambda bit, c: F.when(F.col("flags").bitwiseAND(bit) > 0, F.col(c))
    return whole.select(
        F.when(sale, "sale").otherwise("late").alias("rec"),
        has(ID, "id").alias("id"),
        "batch",
        F.when(sale, F.col("n_held")).alias("n_held"),
        F.when(sale, has(HIT_ID, "change_id")).alias("change_id"),
        F.when(sale, has(HIT_CENTS, "cents")).alias("balance_cents"),
        F.when(sale, has(HIT, "op")).alias("op"),
    )
