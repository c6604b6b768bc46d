"""Approximate nearest neighbours in a forest of hash prefixes.

Every tree hashes a vector to a long string of symbols; a symbol says which axis of a
random rotation the vector lies nearest to.  The strings of a shard are kept sorted.
A query descends in all trees to its longest matching prefixes and then ascends in all
of them together, one symbol at a time, until enough candidates share its prefixes.
Candidates are ranked by their exact distance.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vectors
from .common import settle

TREES = 56
SYMBOLS = 4
SHARE = 0.1
FEWEST = 400


def rotations(size: int, trees: int, symbols: int, seed: int = 5) -> np.ndarray:
    """(trees * symbols) random rotations, the same everywhere."""
    normal = np.random.default_rng(seed).standard_normal((trees * symbols, size, size))
    return np.linalg.qr(normal)[0].astype(np.float32)


def strings(rows: np.ndarray, turns: np.ndarray, symbols: int) -> tuple[np.ndarray, int]:
    """Per tree and row the string as one number, and the bits of a symbol."""
    bits = int(2 * rows.shape[1] - 1).bit_length()
    rows = rows.astype(np.float32)
    out = np.zeros((len(turns) // symbols, len(rows)), np.uint64)
    for i, turn in enumerate(turns):
        seen = rows @ turn
        axis = np.abs(seen).argmax(axis=1)
        symbol = 2 * axis + (seen[np.arange(len(rows)), axis] > 0)
        out[i // symbols] = (out[i // symbols] << np.uint64(bits)) | symbol.astype(np.uint64)
    return out, bits


def _shard(turns: np.ndarray, symbols: int, k: int, share: float, fewest: int):
    def build(_, ids, rows):
        keys, bits = strings(rows, turns, symbols)
        order = np.argsort(keys, axis=1, kind="stable")
        keys = np.take_along_axis(keys, order, axis=1)
        enough = max(fewest, share * len(ids), k)
        same = np.unique(rows, axis=0, return_inverse=True)[1].ravel()

        def search(id_, query):
            own = strings(query[None, :], turns, symbols)[0][:, 0]
            chosen = np.zeros(len(ids), bool)
            for level in range(symbols, -1, -1):
                shift = np.uint64(bits * (symbols - level))
                low = (own >> shift) << shift
                high = low | ((np.uint64(1) << shift) - np.uint64(1))
                spans = [(np.searchsorted(t, a), np.searchsorted(t, b, "right")) for t, a, b in zip(keys, low, high)]
                # Shorter prefixes hold all rows of longer ones, so the marks stay.
                for tree, (a, b) in zip(order, spans):
                    chosen[tree[a:b]] = True
                chosen &= ids != id_
                if np.count_nonzero(chosen) >= enough and len(np.unique(same[chosen])) >= enough:
                    break
            near = np.flatnonzero(chosen)
            apart = rows[near] - query
            distance = np.sqrt((apart * apart).sum(axis=1))
            first = np.lexsort((ids[near], distance))[:k]
            return ids[near[first]], distance[first]

        return search

    return build


def search(rows: DataFrame, id_: str, vector: str, every: int = 100, k: int = 10, trees: int = TREES,
           symbols: int = SYMBOLS, share: float = SHARE, fewest: int = FEWEST,
           shard_rows: int = vectors.SHARD_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found for each query.

    All rows are indexed, in shards by a hash of the id.  Rows of the query's own id
    are no candidates.  Fewer candidates than ``k`` give fewer rows; an empty table
    gives none.  ``share`` of a shard (or ``fewest`` rows, and at least ``k``) must share a
    prefix before the ascent ends; rows count once over all trees, and so do equal
    vectors.  Isotropic vectors need such a share for a steady recall.
    """
    clean = settle(vectors.clean(rows, id_, vector, zero=False))
    first = clean.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("size")).first()
    shards = max(1, -(-first["n"] // shard_rows))
    index = clean.withColumns({"shard": F.pmod(F.xxhash64("vec_id", "vector"), F.lit(shards)), "order": F.lit(0.0)})
    asks = vectors.queries(clean, every).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).withColumn(
        "shard", F.col("shard").cast("long"))
    turns = rotations(first["size"] or 1, trees, symbols)
    found = vectors.visit(index, asks, _shard(turns, symbols, k, share, fewest), k, "double")
    return vectors.best(found, F.col("score"), k)
