"""Session-level helpers: shared folders, checked broadcasts, lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A side is broadcast only when it was counted and holds at most this many rows.
BROADCAST_ROWS = 50_000
BROADCAST_BYTES = 32 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see.

    A cluster names it in ``spark.checkpoint.dir``; only where that setting is
    absent (local tests) a fresh temporary folder is made and set.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="newsloom-")
        spark.conf.set("spark.checkpoint.dir", named)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    return named


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that nothing else uses."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and go on from the files.

    Used where a result feeds several later branches: it is computed once and
    survives the loss of any executor.
    """
    spark = df.sparkSession
    path = fresh_path(spark, "settled")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast when a bounded look shows ``df`` is small in rows and bytes,
    else leave the join to be shuffled."""
    some = df.limit(max_rows + 1).select(F.octet_length(F.to_json(F.struct("*"))).alias("n"))
    rows, size = some.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    return F.broadcast(df) if rows <= max_rows and size <= max_bytes else df


def ship(spark: SparkSession) -> None:
    """Send the package to the Python workers once per session."""
    import pathlib
    import zipfile

    sc = spark.sparkContext
    if getattr(sc, "_newsloom_shipped", False):
        return
    package = pathlib.Path(__file__).resolve().parent
    target = pathlib.Path(tempfile.mkdtemp(prefix="newsloom-pkg-")) / "newsloom.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    sc.addPyFile(str(target))
    sc._newsloom_shipped = True
