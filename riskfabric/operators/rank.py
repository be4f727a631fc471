"""Distributed ranks and running totals (W1 and the prefix sums behind
A13, A14, W2).

A window without ``partitionBy`` moves every row into one task, and a
window partitioned by a hot key puts that key in one task.  Both helpers
here range-partition on the full order key instead (the range partitioner
samples, so a key holding a third of the rows is split over many tasks),
work inside each partition, and add per-partition offsets taken from a
table with one row per partition.  The partitioned intermediate is
checkpointed to the shared folder, so both passes see identical partitions
and an executor loss cannot change positions.
"""

from __future__ import annotations

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed
from ..session import ensure_checkpoint_dir
from ..sources.sinks import materialised


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint to the shared folder.  The frame is held in
    memory/disk while the checkpoint files are written, so the plan is
    computed once rather than once for the count and again for the write."""
    held = df.persist(StorageLevel.MEMORY_AND_DISK)
    out = held.checkpoint(eager=True)
    held.unpersist()
    return out


def _range_partition(df: DataFrame, n: int | None, *keys) -> DataFrame:
    """Range-partition on the keys.  Without an explicit count the shuffle
    uses the session's partition count and AQE may merge neighbouring
    ranges, which keeps partition order equal to key order."""
    return df.repartitionByRange(n, *keys) if n else df.repartitionByRange(*keys)


def rank_first(df: DataFrame, order_cols: list[str], rank_col: str = "rank",
               total_col: str = "n_total", num_partitions: int | None = None) -> DataFrame:
    """1-based position of every row in the order of ``order_cols`` (ties
    must be broken by the last column, e.g. a row id), and the row count.
    Equivalent to ``row_number() OVER (ORDER BY order_cols)`` without a
    single-task window."""
    ensure_checkpoint_dir(df.sparkSession)
    pid = F.spark_partition_id()
    local = (_range_partition(df, num_partitions, *order_cols)
             .sortWithinPartitions(*order_cols)
             .withColumn("_pid", pid)
             .withColumn("_pos", F.monotonically_increasing_id()
                         - F.shiftleft(pid.cast("long"), 33)))
    local = checkpointed(local)
    counts = local.groupBy("_pid").agg(F.count(F.lit(1)).alias("_cnt"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding,
                                                    Window.unboundedFollowing)
    # one row per partition: the window runs over at most n rows
    offsets = counts.select(
        "_pid",
        F.coalesce(F.sum("_cnt").over(before), F.lit(0)).alias("_off"),
        F.sum("_cnt").over(everything).alias(total_col),
    )
    return (local.join(F.broadcast(offsets), "_pid")
            .withColumn(rank_col, F.col("_off") + F.col("_pos") + 1)
            .drop("_pid", "_pos", "_off"))


def _bucket_sql(rank: str, n: str) -> str:
    return f"CASE WHEN {n} <= 1 THEN 1 ELSE CAST(greatest(1, (4 * ({rank} - 1) + {n} - 2) div ({n} - 1)) AS INT) END"


def quartile_bucket(rank: str = "rank", n: str = "n_total") -> Column:
    """qcut of ranks 1..n into 4 equal-frequency bins, in closed integer
    form: ceil(4 (r - 1) / (n - 1)) with bin 1 at the bottom; n = 1 gives
    bin 1.  ``ntile(4)`` is a different rule."""
    return F.expr(_bucket_sql(rank, n))


def quartile_label(bucket: str | Column = "quartile") -> Column:
    b = F.col(bucket) if isinstance(bucket, str) else bucket
    expr = F.lit(None).cast("string")
    for i, label in enumerate(fixed.QUARTILE_LABELS, start=1):
        expr = F.when(b == i, F.lit(label)).otherwise(expr)
    return expr


def disadvantage_quartile(df: DataFrame, value_col: str = "spatial_lack_insurance",
                          id_col: str = "resp_id") -> DataFrame:
    """Quartile of ``value_col`` over the whole frame, ranking ties by
    ``id_col`` (file order) as ``rank(method='first')`` does (W1).  Adds
    ``quartile`` (1-4) and ``quartile_label``.

    The value is a state mean, so there are few distinct ones: rows are
    counted per value, running totals over these counts place each value, and
    only the values that a quartile's edge cuts (three at most) need a rank
    of their rows, on (value, id).  ``df`` is read three times, so it should
    be a written table."""
    counts = df.groupBy(F.col(value_col).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    placed = running_totals(counts, [], "_v", ["_c"])
    total = placed.agg(F.max("cum__c").alias("n")).first()["n"] or 0
    n = F.lit(total).cast("long").alias("_n")
    placed = placed.select("_v", (F.col("cum__c") - F.col("_c")).alias("_before"), F.col("cum__c").alias("_last"), n)
    placed = placed.withColumn("_first_q", F.expr(_bucket_sql("_before + 1", "_n"))) \
        .withColumn("_last_q", F.expr(_bucket_sql("_last", "_n")))
    # a row per value; its written size lets Spark send it to the rows, not the rows to the driver
    placed = materialised(placed, "placed-values")
    joined = df.join(placed, F.col(value_col) == F.col("_v"))
    whole = joined.where("_first_q = _last_q").withColumn("quartile", F.col("_first_q"))
    ranked = rank_first(joined.where("_first_q <> _last_q").select(F.col(id_col).alias("_id"), F.col("_v").alias("_rv"), "_before", "_n"),
                        ["_rv", "_id"], "_rank", "_m")
    start = ranked.groupBy("_rv").agg(F.min("_rank").alias("_start"))  # a row per cut value
    ranked = ranked.join(F.broadcast(start), "_rv").select(
        "_id", F.expr(_bucket_sql("_before + _rank - _start + 1", "_n")).alias("quartile"))
    # both sides grow with the rows, however small the frame's files are: neither goes through the driver
    cut = df.join(ranked.hint("merge"), F.col(id_col) == F.col("_id")).select(*df.columns, "quartile")
    return whole.select(*df.columns, "quartile").unionByName(cut) \
        .withColumn("quartile_label", quartile_label("quartile"))


def _local_cumsum(sum_cols: list[str], part_cols: list[str]):
    """Per-partition running sums over Arrow batches; rows arrive sorted by
    (part_cols, order), so only the last group of a batch carries over."""
    loc = [f"_loc_{c}" for c in sum_cols]

    def run(batches):
        carry = None
        for pdf in batches:
            if part_cols:
                grouped = pdf.groupby(part_cols, sort=False, dropna=False)
                res = pdf.assign(**{l: grouped[c].cumsum().astype("int64")
                                    for l, c in zip(loc, sum_cols)})
            else:
                res = pdf.assign(**{l: pdf[c].astype("int64").cumsum()
                                    for l, c in zip(loc, sum_cols)})
            if carry is not None and len(res):
                if part_cols:
                    start = res[part_cols].merge(carry, on=part_cols, how="left")
                    for l in loc:
                        res[l] = res[l].values + start[l].fillna(0).astype("int64").values
                else:
                    for l in loc:
                        res[l] = res[l] + int(carry[l].iloc[-1])
            if len(res):
                last = (res.groupby(part_cols, sort=False, dropna=False).tail(1)
                        if part_cols else res.tail(1))[part_cols + loc]
                carry = last if carry is None else pd.concat([carry, last]).drop_duplicates(
                    part_cols, keep="last") if part_cols else last
            yield res
    return run


def running_totals(df: DataFrame, part_cols: list[str], order_col: str,
                   sum_cols: list[str], descending: bool = False,
                   num_partitions: int | None = None) -> DataFrame:
    """Inclusive running sums of integer ``sum_cols`` within each
    ``part_cols`` group, in ``order_col`` order (ascending unless
    ``descending``).  Adds ``cum_<col>`` columns.  ``order_col`` must be
    unique within a group (e.g. a table already grouped by it)."""
    ensure_checkpoint_dir(df.sparkSession)
    order = F.col(order_col).desc() if descending else F.col(order_col).asc()
    keys = [F.col(c) for c in part_cols] + [order]
    parted = (_range_partition(df, num_partitions, *keys).sortWithinPartitions(*keys)
              .withColumn("_pid", F.spark_partition_id()))
    schema = T.StructType(parted.schema.fields + [
        T.StructField(f"_loc_{c}", T.LongType()) for c in sum_cols])
    local = parted.mapInPandas(_local_cumsum(sum_cols, part_cols), schema)
    local = checkpointed(local)
    tot = local.groupBy("_pid", *part_cols).agg(*[F.sum(c).alias(f"_tot_{c}") for c in sum_cols])
    w = Window.partitionBy(*part_cols).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1) \
        if part_cols else Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    # at most (partitions + groups) rows
    offsets = tot.select("_pid", *part_cols, *[
        F.coalesce(F.sum(f"_tot_{c}").over(w), F.lit(0)).alias(f"_off_{c}") for c in sum_cols])
    joined = local.join(F.broadcast(offsets), ["_pid", *part_cols])
    for c in sum_cols:
        joined = joined.withColumn(f"cum_{c}", (F.col(f"_loc_{c}") + F.col(f"_off_{c}")).cast("long"))
    return joined.drop("_pid", *[f"_loc_{c}" for c in sum_cols], *[f"_off_{c}" for c in sum_cols])
