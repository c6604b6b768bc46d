"""Merkle manifest of a table: one hash tree per group, and one over the groups' roots.

The nodes of a tree stand in an append log in postorder: a node is written when its
last child is.  Aligned builders of ``3 ** LEVELS`` leaves write contiguous segments of
that log without knowing of each other, because the place of a node follows from the
sizes of the subtrees before it alone (``place``, ``node_place``).  The roots of the
segments are the leaves of the next tier, so a tree of any size is a few rounds of
bounded groups, and a proof reads its siblings at places that are worked out.

Defined results: rows are ordered by (id, digest), null ids first; equal rows are
leaves of their own, and which of them stands first changes nothing; a null group is a
group of its own and the first; an empty table gives empty results.
"""

from __future__ import annotations

from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import settle
from .common import pick, shuffle_partitions

ARITY = 3
# Levels that one builder completes.
LEVELS = 5
WIDTH = ARITY ** LEVELS


def digest(*parts: str) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def height(n: int) -> int:
    """Levels above ``n`` leaves until one node remains."""
    levels = 0
    while n > 1:
        n, levels = -(-n // ARITY), levels + 1
    return levels


def place(leaf: int) -> int:
    """Place of a leaf in the log: all leaves before it, and all nodes they complete."""
    at = leaf
    while leaf:
        leaf //= ARITY
        at += leaf
    return at


def node_place(level: int, j: int, n: int) -> int:
    """Place of the j-th node of a level over ``n`` leaves.

    A node follows its last leaf and the nodes of lower levels that end with it.
    """
    return place(min((j + 1) * ARITY ** level, n) - 1) + level


def sibling_places(leaf: int, n: int, levels: int) -> list[tuple[list[int], list[int]]]:
    """Per level, the log places of the siblings left and right of the path from ``leaf``."""
    out = []
    for level in range(levels):
        first, count = leaf - leaf % ARITY, -(-n // ARITY ** level)
        run = range(first, min(first + ARITY, count))
        out.append(([node_place(level, s, n) for s in run if s < leaf],
                    [node_place(level, s, n) for s in run if s > leaf]))
        leaf //= ARITY
    return out


def segment(leaves: list[str], levels: int) -> list[str]:
    """The nodes over ``leaves`` up to ``levels``, in the order of their completion."""
    log, open_runs = [], [[] for _ in range(levels + 1)]

    def close(level: int) -> None:
        node = digest(*open_runs[level])
        open_runs[level] = []
        log.append(node)
        open_runs[level + 1].append(node)

    for leaf in leaves:
        log.append(leaf)
        open_runs[0].append(leaf)
        for level in range(levels):
            if len(open_runs[level]) < ARITY:
                break
            close(level)
    for level in range(levels):
        if open_runs[level]:
            close(level)
    return log


def field(name: str, value: Column | None = None) -> Column:
    """``-`` for null, else the UTF-8 length, ``:`` and the value."""
    value = (F.col(name) if value is None else value).cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def leaf_digest(*fields: Column) -> Column:
    return F.sha2(F.concat(*fields), 256)


def numbered(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Add ``idx``, the place of a row inside its key, and ``n``, the rows of the key.

    Rows are cut into equal ranges of (key, order), so a hot key covers many ranges;
    places inside a range and the counts of the ranges before it add up.  ``order`` must
    end with a column that tells equal rows apart.
    """
    ranges = rows.repartitionByRange(shuffle_partitions(rows), key, *order)
    ranges = settle(ranges.withColumn("_range", F.spark_partition_id()))
    inside = F.row_number().over(Window.partitionBy("_range", key).orderBy(*order)) - 1
    counts = ranges.groupBy("_range", key).agg(F.count("*").alias("_rows"))
    whole = Window.partitionBy(key)
    counts = counts.withColumns({
        "_before": F.sum("_rows").over(whole.orderBy("_range")) - F.col("_rows"), "n": F.sum("_rows").over(whole)})
    joined = ranges.withColumn("_inside", inside).join(counts, ["_range", key])
    return joined.select(*rows.columns, (F.col("_before") + F.col("_inside")).alias("idx"), "n")


def _segments(leaves: DataFrame, carried: list[str]) -> DataFrame:
    """One builder per (key, block): its log segment and the carried values of its leaves in order."""
    @F.pandas_udf("array<string>")
    def built(digests, n):
        import pandas as pd

        return pd.Series([segment(list(d), LEVELS if m > WIDTH else height(m)) for d, m in zip(digests, n)],
                         dtype=object)

    rows = leaves.groupBy("key", F.floor(F.col("idx") / WIDTH).alias("block")).agg(
        F.min("n").alias("n"), F.array_sort(F.collect_list(F.struct("idx", "digest", *carried))).alias("rows"))
    return rows.select("key", "block", "n", built(F.col("rows.digest"), F.col("n")).alias("log"),
                       *[F.col(f"rows.{c}").alias(c) for c in carried])


def grow(leaves: DataFrame, carried: list[str] = ()) -> list[DataFrame]:
    """Trees over ``leaves`` (key, idx, n, digest, ...), tier by tier, each written to the shared folder.

    Tier t holds (key, block, n, log): the segments over the nodes of level t * LEVELS,
    of which the key has n.  Tier 0 also holds the carried columns as arrays.  The number
    of tiers is the logarithm of the largest key; only that size comes to the driver.
    """
    tiers, most = [], leaves.agg(F.max("n")).first()[0] or 0
    while most:
        tiers.append(settle(_segments(leaves, list(carried) if not tiers else [])))
        if most <= WIDTH:
            break
        most = -(-most // WIDTH)
        leaves = tiers[-1].where(F.col("n") > WIDTH).select(
            "key", F.col("block").alias("idx"), F.ceil(F.col("n") / WIDTH).alias("n"),
            F.element_at("log", -1).alias("digest"))
    return tiers


def roots(tiers: list[DataFrame]) -> DataFrame:
    """(key, digest): the root of every tree."""
    tops = [t.where(F.col("n") <= WIDTH).select("key", F.element_at("log", -1).alias("digest")) for t in tiers]
    out = tops[0]
    for top in tops[1:]:
        out = out.unionByName(top)
    return out


def _local_paths(n: int, block: int, log: list[str]):
    """Per leaf of a segment its digest and the siblings left and right, level by level."""
    mine = min(WIDTH, n - block * WIDTH)
    levels = LEVELS if n > WIDTH else height(n)
    for leaf in range(mine):
        sides = sibling_places(leaf, mine, levels)
        yield (log[place(leaf)], ["".join(log[p] for p in left) for left, _ in sides],
               ["".join(log[p] for p in right) for _, right in sides])


def descend(tiers: list[DataFrame], above: DataFrame, emit, schema: str) -> DataFrame:
    """Take the paths from the roots down to the leaves.

    ``above`` (key, lefts, rights, ...) continues the path of each key's root.  For every
    segment of tier 0, ``emit(segment row, paths)`` yields output rows, where ``paths``
    gives (digest, lefts, rights) per leaf.  Upper tiers hand their blocks one row each,
    so every join is between rows of segments.
    """
    extra = [c for c in above.columns if c not in ("key", "lefts", "rights")]
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in above.schema if f.name in extra)
    below = f"key string, block long, lefts array<string>, rights array<string>{', ' + kinds if kinds else ''}"
    upper = None
    for t in reversed(range(len(tiers))):
        ended = tiers[t].where(F.col("n") <= WIDTH).select("key", "block").join(above, "key")
        upper = ended if upper is None else ended.unionByName(upper)
        rows = tiers[t].join(upper, ["key", "block"])
        if t == 0:
            return rows.mapInArrow(_walk(emit, schema), schema)
        upper = settle(rows.mapInArrow(_walk(_children(extra), below), below))
    raise ValueError("a tree has at least one tier")


def _children(extra: list[str]):
    def emit(row, paths):
        more = tuple(row[c] for c in extra)
        for k, (_, lefts, rights) in enumerate(paths):
            yield row["key"], row["block"] * WIDTH + k, lefts, rights, *more

    return emit


def _walk(emit, schema: str):
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                paths = ((leaf, lefts + row["lefts"], rights + row["rights"])
                         for leaf, lefts, rights in _local_paths(row["n"], row["block"], row["log"]))
                found = list(emit(row, paths))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(c), f.type) for c, f in zip(zip(*found), out)], schema=out)

    return run


def fold(leaf: str, lefts: list[str], rights: list[str]) -> str:
    """The root that a leaf and its siblings lead to."""
    for left, right in zip(lefts, rights):
        leaf = digest(left, leaf, right)
    return leaf


def manifest(rows: DataFrame, id_: str, group: str, leaf: Column, altered: Column) -> tuple[list, list]:
    """(trees of the groups, tree of their roots), as tiers.

    ``leaf`` is the digest of a row; ``altered``, a second digest or null, is carried to
    be checked against the proof.  Only ids and digests are shuffled, never the rows.
    """
    named = pick(rows.select(F.col(id_).alias("_id"), F.col(group).alias("_group"), leaf.alias("_leaf"),
                             altered.alias("_altered")),
                 id="_id", group="_group", digest="_leaf", altered="_altered")
    # A null group is the empty key, which sorts before every other one.
    key = F.coalesce(F.concat(F.lit("="), F.col("group").cast("string")), F.lit(""))
    leaves = settle(named.select(key.alias("key"), "id", "digest", "altered",
                                 F.xxhash64(F.monotonically_increasing_id()).alias("turn")))
    trees = grow(numbered(leaves, "key", ["id", "digest", "turn"]), ["id", "altered"])
    if not trees:
        return [], []
    tops = roots(trees).select(F.lit("").alias("key"), F.col("key").alias("name"), "digest")
    return trees, grow(numbered(tops, "key", ["name"]), ["name"])


CHECKED = ("id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, "
           "verified boolean")


def checked(trees: list[DataFrame], tops: list[DataFrame]) -> DataFrame:
    """Per row its leaf, roots, digest of the proof, and the root that its altered leaf folds to."""
    crown = roots(tops).select("key", F.array().cast("array<string>").alias("lefts"),
                               F.array().cast("array<string>").alias("rights"), F.col("digest").alias("root"))

    def named(row, paths):
        for name, (subroot, lefts, rights) in zip(row["name"], paths):
            yield name, lefts, rights, subroot, row["root"]

    def proven(row, paths):
        for id_, altered, (leaf, lefts, rights) in zip(row["id"], row["altered"], paths):
            sides = [part for pair in zip(lefts, rights) for part in pair]
            folded = fold(altered or leaf, lefts, rights)
            yield id_, leaf, row["subroot"], row["root"], digest(*sides), folded, folded == row["root"]

    above = settle(descend(tops, crown, named,
                           "key string, lefts array<string>, rights array<string>, subroot string, root string"))
    return descend(trees, above, proven, CHECKED)


def append_log(tiers: list[DataFrame]) -> DataFrame:
    """(key, place, digest): the logs of all trees, gapless per key from 0.

    Tier 0 gives the leaves and the nodes of its levels, an upper tier what stands above
    its own leaves, which the tier below has written.
    """
    def rows(tier: int):
        def run(batches):
            for batch in batches:
                for row in batch.to_pylist():
                    mine = min(WIDTH, row["n"] - row["block"] * WIDTH)
                    keys, places, digests = [], [], []
                    for level in range(1 if tier else 0, (LEVELS if row["n"] > WIDTH else height(row["n"])) + 1):
                        first = row["block"] * ARITY ** (LEVELS - level)
                        for j in range(-(-mine // ARITY ** level)):
                            keys.append(row["key"])
                            places.append(node_place(tier * LEVELS + level, first + j, row["leaves"]))
                            digests.append(row["log"][node_place(level, j, mine)])
                    if keys:
                        yield pa.RecordBatch.from_pydict({"key": keys, "place": places, "digest": digests})

        sized = tiers[tier].join(sizes, "key") if tier else tiers[0].withColumn("leaves", F.col("n"))
        return sized.select("key", "block", "n", "log", "leaves").mapInArrow(
            run, "key string, place long, digest string")

    sizes = tiers[0].where("block = 0").select("key", F.col("n").alias("leaves"))
    out = None
    for t in range(len(tiers)):
        out = rows(t) if out is None else out.unionByName(rows(t))
    return out


def prove(log: DataFrame, asked: DataFrame) -> DataFrame:
    """(key, idx, siblings) for single leaves ``asked`` (key, idx, n) of a stored log.

    ``siblings`` holds (level, side, place, digest) in the order of the proof.  Only the
    log rows at the places that follow from idx and n are joined.
    """
    @F.pandas_udf("array<struct<step:int,place:long,left:boolean>>")
    def wanted(idx, n):
        import pandas as pd

        out = []
        for i, m in zip(idx, n):
            sides = sibling_places(int(i), int(m), height(int(m)))
            flat = [(level, p, side == 0) for level, pair in enumerate(sides) for side in (0, 1) for p in pair[side]]
            out.append([{"step": s, "place": p, "left": left} for s, p, left in flat])
        return pd.Series(out, dtype=object)

    steps = asked.withColumn("w", F.explode_outer(wanted("idx", "n"))).select(
        "key", "idx", "w.step", "w.place", "w.left")
    found = steps.join(log, ["key", "place"], "left")
    return found.groupBy("key", "idx").agg(F.array_sort(F.collect_list(F.when(
        F.col("place").isNotNull(), F.struct("step", "place", "left", "digest")))).alias("siblings"))
