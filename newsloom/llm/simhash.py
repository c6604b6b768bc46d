"""Near-duplicates by SimHash: 64-bit fingerprints, linked at a few differing bits.

The comparison is exact.  Distinct fingerprints lie in tiles by the population
counts of their four 16-bit parts.  Two fingerprints differ in at least as many bits
as their counts differ, so only tiles whose counts differ by the radius or less are
compared, with numpy exclusive-or and bit counts.
"""

from __future__ import annotations

from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.joins import lookup
from .common import components, in_frames, pick, settle

RADIUS = 3
SEED = 42
TILE = 2048
_PARTS = 4


def fingerprint(text: str | None, shingle: int = 3, seed: int = SEED) -> int:
    """The fingerprint of one text as an unsigned number; zero without any word."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    stops = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = (stops - np.fromiter(map(len, words), np.int64, len(words)) - 1).tolist()
    stops = (stops - 1).tolist()
    ends = stops[shingle - 1:] or stops[-1:]
    digest = xxhash.xxh64_digest
    hashed = np.frombuffer(b"".join([digest(line[a:b], seed) for a, b in zip(starts, ends)]), np.uint8)
    hashed = hashed.reshape(-1, 8)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashed), 32_768):
        ones += np.unpackbits(hashed[at:at + 32_768], axis=1).sum(axis=0, dtype=np.uint16)
    return int.from_bytes(np.packbits(2 * ones > len(hashed)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_: str, text: str, shingle: int = 3) -> DataFrame:
    """(doc_id, text_hash, fp): fp as a signed long.  Null and empty texts have fingerprint 0."""
    def run(frames):
        for pdf in frames:
            fp = np.array([fingerprint(t, shingle) for t in pdf.pop("text")], np.uint64)
            yield pdf.assign(fp=fp.view(np.int64))

    rows = pick(docs, doc_id=id_, text=text).withColumn("text_hash", F.xxhash64("text"))
    return in_frames(rows.select("doc_id", "text_hash", "text"), run, "doc_id long, text_hash long, fp long")


def _cell(fp: Column) -> Column:
    """The four population counts (0 to 16 each) as one number."""
    bits = [F.bit_count(F.shiftrightunsigned(fp, 16 * i).bitwiseAND(F.lit(0xFFFF))) for i in range(_PARTS)]
    return sum((b * 17 ** i for i, b in enumerate(bits)), F.lit(0)).cast("int")


def _steps(radius: int) -> list[tuple[int, ...]]:
    """Count differences within the radius; one of each opposite pair, and none at all."""
    near = [d for d in product(range(-radius, radius + 1), repeat=_PARTS) if sum(map(abs, d)) <= radius]
    return [d for d in near if d >= (0,) * _PARTS]


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) between nodes, replaced by as many as the nodes that keep the same components."""
    nodes, code = np.unique(np.concatenate([a, b]), return_inverse=True)
    if len(a) <= len(nodes):
        return a, b
    i, j = code[:len(a)], code[len(a):]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = np.minimum(new, new[new])
        if (new == label).all():
            break
        label = new
    child = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[child], nodes[label[child]]


def _compare(radius: int):
    def run(frames):
        import pandas as pd

        for pdf in frames:
            out_a, out_b = [], []
            for own, lf, ln, rf, rn in zip(pdf["own"], pdf["lf"], pdf["ln"], pdf["rf"], pdf["rn"]):
                lf, rf = np.frombuffer(lf, np.uint64), np.frombuffer(rf, np.uint64)
                ln, rn = np.frombuffer(ln, np.int64), np.frombuffer(rn, np.int64)
                a, b = [], []
                for at in range(0, len(lf), 256):
                    near = np.bitwise_count(lf[at:at + 256, None] ^ rf[None, :]) <= radius
                    x, y = np.nonzero(near)
                    if own:
                        x, y = x[x + at < y], y[x + at < y]
                    if len(x):
                        x, y = _forest(ln[at + x], rn[y])
                        a.append(x)
                        b.append(y)
                if a:
                    x, y = _forest(np.concatenate(a), np.concatenate(b))
                    out_a.append(x)
                    out_b.append(y)
            if out_a:
                yield pd.DataFrame({"a": np.concatenate(out_a), "b": np.concatenate(out_b)})

    return run


def links(prints: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Links (a, b) between the nodes of ``prints`` (fp, node), one row per distinct fp.

    Of the links inside a pair of tiles only a spanning forest is returned, so a
    group of near copies never becomes all its pairs and no component falls apart.
    """
    cells = prints.withColumn("cell", _cell(F.col("fp")))
    sizes = cells.groupBy("cell").agg(F.ceil(F.count("*") / tile).cast("int").alias("slices"))
    tiles = (cells.join(sizes, "cell")
             .withColumn("slice", F.pmod(F.xxhash64("fp"), F.col("slices")).cast("int"))
             .groupBy("cell", "slice").agg(F.collect_list(F.struct("fp", "node")).alias("rows")))

    def packed(frames):
        for pdf in frames:
            fps = [np.array([r["fp"] for r in rows], np.int64).tobytes() for rows in pdf["rows"]]
            nodes = [np.array([r["node"] for r in rows], np.int64).tobytes() for rows in pdf["rows"]]
            yield pdf[["cell", "slice"]].assign(f=fps, n=nodes)

    tiles = settle(tiles.mapInPandas(packed, "cell int, slice int, f binary, n binary"))
    digits = [F.pmod(F.floor(F.col("cell") / 17 ** i), F.lit(17)) for i in range(_PARTS)]
    steps = F.array(*[F.array(*[F.lit(x) for x in step]) for step in _steps(radius)])
    there = F.col("lc") + sum((F.col("step")[i] * 17 ** i for i in range(_PARTS)), F.lit(0))
    left = (tiles.select(F.col("cell").alias("lc"), F.col("slice").alias("ls"), F.col("f").alias("lf"),
                         F.col("n").alias("ln"), *[d.alias(f"d{i}") for i, d in enumerate(digits)],
                         F.explode(steps).alias("step")))
    inside = F.lit(True)
    for i in range(_PARTS):
        inside = inside & (F.col(f"d{i}") + F.col("step")[i]).between(0, 16)
    left = left.where(inside).select("lc", "ls", "lf", "ln", there.cast("int").alias("cell"))
    right = tiles.select("cell", "slice", F.col("f").alias("rf"), F.col("n").alias("rn"))
    pairs = left.join(right, "cell").where("lc <> cell or ls <= slice")
    return pairs.select((F.col("lc").eqNullSafe(F.col("cell")) & (F.col("ls") == F.col("slice"))).alias("own"),
                        "lf", "ln", "rf", "rn").mapInPandas(_compare(radius), "a long, b long")


def near_duplicates(docs: DataFrame, id_: str, text: str, shingle: int = 3, radius: int = RADIUS) -> DataFrame:
    """(doc_id, text_hash, fp, component_id, root): component_id is the smallest doc_id reachable,
    root a fingerprint that names the component also where ids repeat or are null.

    Null and empty texts share fingerprint 0 and link like any other.  Repeated
    rows and ids give as many rows.  A null doc_id keeps its row; it names a
    component only if nothing else is in it, and then the name is null.
    """
    marked = settle(fingerprints(docs, id_, text, shingle))
    prints = settle(marked.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")))
    # Fingerprints are the nodes: distinct, and never null even if an id is.
    roots = components(links(prints.select("fp", F.col("fp").alias("node")), radius))
    joined = prints.join(roots, prints["fp"] == roots["node"], "left").select(
        prints["fp"], "least", "copies", F.coalesce(roots["root"], prints["fp"]).alias("root"))
    joined = settle(joined)
    names = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    table = joined.join(names, "root").select("fp", "component_id", "root", "copies")
    return lookup(marked, table, "fp", "copies", marked.count())


def hex_digits(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
