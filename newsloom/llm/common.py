"""Small helpers that the operators of this folder share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settle, ship


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns under the operator's own names.

    Everything else a table holds, whatever its name, stays outside.
    """
    ship(df.sparkSession)
    return df.select(*[df[name].alias(own) for own, name in columns.items()])


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def release() -> None:
    """Give freed memory back to the system.

    A Python worker lives on after its task; what it keeps would add to the next stage.
    """
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def in_frames(df: DataFrame, run, schema: str) -> DataFrame:
    """mapInPandas that keeps whole numbers whole.

    There a column with a null becomes floats, which hold no id above 2**53.  Here
    such a column is a nullable integer, and results go back without floats.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    out = to_arrow_schema(StructType.fromDDL(schema))

    def arrow(batches):
        import pandas as pd
        import pyarrow as pa

        def frames():
            for batch in batches:
                pdf = batch.to_pandas()
                for name, column in zip(batch.schema.names, batch.columns):
                    if pa.types.is_integer(column.type) and column.null_count:
                        pdf[name] = pd.array(column.to_pylist(), "Int64")
                yield pdf

        for pdf in run(frames()):
            yield pa.RecordBatch.from_pandas(pdf, out, preserve_index=False)

    return df.mapInArrow(arrow, schema)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the undirected ``edges`` (a, b): root is the
    smallest node that can be reached.

    Large and small stars in turn (Kiveris et al. 2014).  A round keeps at most
    one row per edge, and only two numbers come to the driver to tell whether
    it changed anything.  Every round is written to the shared folder.
    """
    def stars(e: DataFrame, small: bool) -> DataFrame:
        if small:
            key, other = F.greatest("a", "b"), F.least("a", "b")
            sides = e.select(key.alias("k"), other.alias("v"))
        else:
            sides = e.select(F.col("a").alias("k"), F.col("b").alias("v")).unionByName(
                e.select(F.col("b").alias("k"), F.col("a").alias("v")))
        low = sides.groupBy("k").agg(F.min("v").alias("m")).withColumn("m", F.least("k", "m"))
        joined = sides.join(low, "k")
        if small:
            out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(
                low.select(F.col("k").alias("a"), F.col("m").alias("b")))
        else:
            out = joined.where("v > k").select(F.col("v").alias("a"), F.col("m").alias("b"))
        return out.where("a <> b").distinct()

    def mark(e: DataFrame):
        return e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()

    now = settle(edges.where("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = mark(now)
    for _ in range(rounds):
        now = settle(stars(stars(now, small=False), small=True))
        after = mark(now)
        if after == before:
            return now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
        before = after
    raise RuntimeError(f"components did not settle in {rounds} rounds")
