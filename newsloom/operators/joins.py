"""Joins and running values that hold under hot keys."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# A key is hot when it holds at least total / HOT_SHARE rows, so there are never
# more than HOT_SHARE hot keys and their lookup rows always fit a broadcast.
HOT_SHARE = 10_000
# Rows of one block of a running value.
BLOCK_ROWS = 1_000_000
# Rows of a posting list that one task joins before the list is salted.
SALT_ROWS = 50_000


def placed(df: DataFrame, id_: str) -> DataFrame:
    """Place texts by id, so that later grouping by id needs no exchange.

    The number of partitions is the session's: word work is heavy for its bytes,
    and partitions merged by byte size would leave cores idle.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), id_)


def lookup(rows: DataFrame, table: DataFrame, key: str, weight: str, total: int,
           hot_share: int = HOT_SHARE) -> DataFrame:
    """Left join ``rows`` to one row per ``key`` of ``table``.

    ``weight`` says how many of the ``total`` rows a key holds.  Hot keys are
    answered by a broadcast of at most ``hot_share`` rows; everything else is
    shuffled, and the rows already answered are spread by a random key instead
    of piling up.  ``weight`` is not returned.
    """
    floor = max(total / hot_share, 1.0)
    values = [c for c in table.columns if c not in (key, weight)]
    packed = table.select(F.col(key).alias("_k"), F.col(weight).alias("_n"),
                          F.struct(*values).alias("_v"))
    if total <= hot_share:
        # Every key fits the bound, so one broadcast answers all.
        joined = rows.join(F.broadcast(packed.drop("_n")), F.col(key) == F.col("_k"), "left")
        return joined.select(*rows.columns, *[F.col(f"_v.{v}").alias(v) for v in values])
    hot = packed.where(F.col("_n") >= floor).select("_k", F.col("_v").alias("_hot"))
    cold = packed.where(F.col("_n") < floor).select(F.col("_k").alias("_ck"), F.col("_v").alias("_cold"))
    once = rows.join(F.broadcast(hot), F.col(key) == F.col("_k"), "left").drop("_k")
    spread = F.xxhash64(*[F.col(c) for c in rows.columns if c != key] or [F.col(key)])
    # A null key finds nothing: such rows are spread like the answered ones.
    once = once.withColumn("_jk", F.when(F.col("_hot").isNull() & F.col(key).isNotNull(), F.struct(
        F.col(key).alias("k"), F.lit(0).cast("long").alias("s"))).otherwise(F.struct(
            F.lit(None).cast(rows.schema[key].dataType).alias("k"), spread.alias("s"))))
    cold = cold.withColumn("_cjk", F.struct(
        F.col("_ck").alias("k"), F.lit(0).cast("long").alias("s"))).drop("_ck")
    joined = once.join(cold, F.col("_jk") == F.col("_cjk"), "left")
    value = F.coalesce("_hot", "_cold")
    return joined.select(*rows.columns, *[value[v].alias(v) for v in values])


def block_of(df: DataFrame, order: str, rows: int, out: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Number blocks of about ``block_rows`` rows along ``order``.

    The cuts are quantiles, so gaps and bursts in the numbering do not matter.
    """
    n = -(-rows // block_rows)
    if n <= 1:
        return df.withColumn(out, F.lit(0))
    cuts = df.stat.approxQuantile(order, [i / n for i in range(1, n)], 0.1 / n)
    splits = [float("-inf")] + sorted(set(cuts)) + [float("inf")]
    if len(splits) < 3:
        return df.withColumn(out, F.lit(0))
    cut = Bucketizer(splits=splits, inputCol="_ord", outputCol="_blk")
    return (cut.transform(df.withColumn("_ord", F.col(order).cast("double")))
            .withColumn(out, F.col("_blk").cast("int")).drop("_ord", "_blk"))


def running(df: DataFrame, key: str | None, order: str, value: Column, combine, out: str,
            rows: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``combine`` of ``value`` over the rows before each row, per ``key``.

    Two levels: a total per (key, block), carried over the blocks of the key,
    and a window inside (key, block).  No task ever holds a whole hot key.
    ``combine`` is ``"max"`` or ``"sum"``.
    """
    agg = {"max": F.max, "sum": F.sum}[combine]
    keys = [key] if key else []
    work = block_of(df, order, rows, "_block", block_rows).withColumn("_value", value)
    inside = (Window.partitionBy(*keys, "_block").orderBy(order)
              .rowsBetween(Window.unboundedPreceding, -1))
    if rows <= block_rows:
        return work.withColumn(out, agg("_value").over(inside)).drop("_block", "_value")
    totals = work.groupBy(*keys, "_block").agg(agg("_value").alias("_total"))
    before = (Window.partitionBy(*keys).orderBy("_block")
              .rowsBetween(Window.unboundedPreceding, -1))
    carried = totals.select(*keys, "_block", agg("_total").over(before).alias("_carry"))
    local = work.withColumn("_local", agg("_value").over(inside))
    both = local.join(carried, keys + ["_block"])
    if combine == "max":
        merged = F.greatest("_carry", "_local")
    else:
        merged = F.when(F.col("_carry").isNull() & F.col("_local").isNull(), F.lit(None)).otherwise(
            F.coalesce("_carry", F.lit(0)) + F.coalesce("_local", F.lit(0)))
    return both.withColumn(out, merged).drop("_block", "_value", "_carry", "_local")


def positions(df: DataFrame, order: str, out: str = "pos", rows: int | None = None,
              block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Zero-based place of each row along ``order``, without a global sort task."""
    n = df.count() if rows is None else rows
    ranked = running(df, None, order, F.lit(1).cast("long"), "sum", out, n, block_rows)
    return ranked.withColumn(out, F.coalesce(F.col(out), F.lit(0)).cast("long"))


def arrival(df: DataFrame, late: str, order: str) -> DataFrame:
    """Add ``place``: rows with a smaller ``late`` (0 or 1) first, then along ``order``.

    The rows before any late row are counted once; no global sort is needed.
    """
    early = positions(df.where(F.col(late) == 0), order, "place")
    n = df.where(F.col(late) == 0).count()
    fresh = positions(df.where(F.col(late) == 1), order, "place").withColumn("place", F.col("place") + n)
    return early.unionByName(fresh)
