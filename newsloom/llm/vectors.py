"""What the two vector searches share: clean vectors, and queries that visit shards of an index."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import pick, shuffle_partitions

SHARD_ROWS = 4096


def finite(vector: str | Column) -> Column:
    """Whether every component is there and finite."""
    return F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def clean(rows: DataFrame, id_: str, vector: str, zero: bool) -> DataFrame:
    """(vec_id, vector as doubles) of the rows that take part.

    Null ids and vectors, vectors with null or non-finite components, of another than
    the most common length, and zero vectors (unless ``zero``) do not.
    """
    v = pick(rows, vec_id=id_, vector=vector).withColumn("vector", F.col("vector").cast("array<double>"))
    v = v.where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & finite("vector") & (F.size("vector") > 0))
    if not zero:
        v = v.where(F.exists("vector", lambda x: x != 0))
    size = v.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return v.where(F.size("vector") == (size["n"] if size else 0))


def queries(vectors: DataFrame, every: int) -> DataFrame:
    """(query_id, vector) of the ids divisible by ``every``; of repeated ids the least vector."""
    chosen = vectors.where(F.col("vec_id") % every == 0)
    return chosen.groupBy(F.col("vec_id").alias("query_id")).agg(F.min("vector").alias("vector"))


def visit(index: DataFrame, asks: DataFrame, build, k: int, score_type: str) -> DataFrame:
    """(query_id, vec_id, score): up to ``k`` rows per ask and shard.

    ``index`` (shard, vec_id, vector, order) and ``asks`` (shard, query_id, vector) meet by
    shard, index rows first.  A task holds one shard, of bounded size, at a time and
    streams the asks past it.  ``build(shard, ids, vectors)`` gives a function from one
    (query id, vector) to ids and scores.
    """
    both = index.select("shard", F.lit(0).alias("kind"), "order", F.col("vec_id").alias("id"), "vector").unionByName(
        asks.select("shard", F.lit(1).alias("kind"), F.lit(0.0).alias("order"), F.col("query_id").alias("id"), "vector"))
    placed = both.repartition(shuffle_partitions(index), "shard").sortWithinPartitions("shard", "kind", "order", "id")

    def run(frames):
        import pandas as pd

        shard, ids, rows, search = None, [], [], None
        for pdf in frames:
            out = []
            for name, kind, id_, vector in zip(pdf["shard"], pdf["kind"], pdf["id"], pdf["vector"]):
                if name != shard:
                    shard, ids, rows, search = name, [], [], None
                if kind == 0:
                    ids.append(id_)
                    rows.append(vector)
                elif ids:
                    if search is None:
                        search = build(shard, np.array(ids), np.array(rows, float))
                        rows = []
                    near, score = search(id_, np.asarray(vector, float))
                    out.append((np.full(len(near), id_), near, score))
            if out:
                yield pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), map(np.concatenate, zip(*out)))))

    return placed.drop("order").mapInPandas(run, f"query_id long, vec_id long, score {score_type}")


def best(found: DataFrame, score: Column, k: int) -> DataFrame:
    """The first ``k`` per query by ``score``, then the smaller id."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(score, "vec_id"))
    ranked = found.withColumn("rank", rank).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
