"""Finding stored articles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..session import settle, small_side
from . import joins


def by_id(index: DataFrame, id_: str, value) -> DataFrame:
    """The stored row, or none."""
    return index.where(F.col(id_) == F.lit(value))


def field_by_id(index: DataFrame, id_: str, value, field: str) -> DataFrame:
    """One row with the field as text; empty when there is no such row."""
    hit = by_id(index, id_, value).select(F.col(field).cast("string").alias("value"))
    return hit.agg(F.coalesce(F.max("value"), F.lit("")).alias("value"))


def update_fields(index: DataFrame, updates: DataFrame, id_: str, fields: list[str]) -> DataFrame:
    """Rows with new values where ``updates`` has them (null keeps the old).

    Of several updates of one id each field takes its largest value.
    """
    new = updates.groupBy(id_).agg(*[F.max(f).alias(f"_new_{f}") for f in fields])
    joined = index.join(small_side(new), id_, "left")
    out = [F.coalesce(f"_new_{c}", c).alias(c) if c in fields else F.col(c) for c in index.columns]
    return joined.select(*out)


def first_containing(articles: DataFrame, id_: str, title: str, body: str, needle: str) -> DataFrame:
    """Title of the first article whose text holds the string."""
    return (articles.where(F.contains(F.col(body), F.lit(needle)))
            .orderBy(id_).limit(1).select(id_, title))


def bm25_idf(n: Column, df: Column) -> Column:
    return F.log(F.lit(1.0) + (n - df + 0.5) / (df + 0.5))


# Cells (a text and a word that is asked for) and queries of one tile, and products formed at a time.
TILE_CELLS = 2_000_000
TILE_QUERIES = 1_024
PRODUCTS = 4_000_000


def more_like_this(corpus: DataFrame, queries: DataFrame, min_tf: int = 2, max_terms: int = 70,
                   min_doc_freq: int = 5, should_match: float = 0.3, min_score: float = 0.0,
                   k1: float = 1.2, b: float = 0.75, salt_rows: int = joins.SALT_ROWS) -> DataFrame:
    """(query_id, found, match_id, score): the best document for each query text.

    ``corpus`` holds (id, body), ``queries`` (query_id, body).  Query terms are
    the ``max_terms`` best by tf-idf; a document must hold ``should_match`` of
    them (rounded down, at least one); score is BM25.

    Texts are cut once; only their length and the terms that some query asks for leave
    the row.  Slices of at most about ``salt_rows`` texts meet blocks of queries in tiles
    (``_best_of_tile``): no pair of a text and a query is a row, and a tile gives one
    text per query.
    """
    tokens = text.tokens(F.lower("body"))
    qwords = queries.select("query_id", F.explode(tokens).alias("term"))
    qtf = settle(qwords.groupBy("query_id", "term").agg(F.count("*").alias("qtf")).where((F.col("qtf") >= min_tf) & F.col("query_id").isNotNull()))
    wanted = settle(qtf.select("term").distinct().select("term", F.monotonically_increasing_id().alias("no")))
    # The outer form keeps the optimizer from cutting again for a filter; words that nobody asks for are one row a text.
    words = corpus.select("id", tokens.alias("_t")).select("id", F.size("_t").alias("len"), F.explode_outer("_t").alias("term"))
    held = settle(words.join(small_side(wanted), "term", "left")
                  .groupBy("id", "len", "no").agg(F.count("term").alias("tf")))
    n_docs, all_words = corpus.count(), held.agg(F.sum("tf")).first()[0]
    avg = (all_words or 1) / max(n_docs, 1)
    held = held.where("no is not null and id is not null")
    df = held.groupBy("no").agg(F.count("*").alias("df")).where(F.col("df") >= min_doc_freq)
    weighed = qtf.join(wanted, "term").join(df, "no").withColumn("idf", bm25_idf(F.lit(float(n_docs)), F.col("df")))
    best = Window.partitionBy("query_id").orderBy(F.desc(F.round(F.col("qtf") * F.col("idf"), 9)), "term")
    weighed = weighed.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= max_terms)
    need = F.greatest(F.floor(F.count("*").over(Window.partitionBy("query_id")) * F.lit(should_match) + 1e-9), F.lit(1))
    terms = settle(weighed.select("query_id", "no", "idf", need.alias("need")))

    norm = F.lit(k1) * (F.lit(1 - b) + F.lit(b) * F.col("len") / F.lit(avg))
    part = F.col("tf") * F.lit(k1 + 1) / (F.col("tf") + norm)
    cells = held.join(small_side(terms.select("no").distinct()), "no", "left_semi").select("id", "no", part.alias("part"))
    asking = terms.select(F.countDistinct("query_id")).first()[0]
    blocks = -(-asking // TILE_QUERIES) or 1
    slices = max(-(-n_docs // salt_rows), -(-cells.count() // TILE_CELLS), 1)
    held_in = cells.select(F.pmod(F.xxhash64("id"), F.lit(slices)).alias("slice"),
                           F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "id", "no", "part")
    asked_in = terms.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slices - 1).cast("long"))).alias("slice"),
                            F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block"), "query_id", "no", "idf", "need")
    dealt = lambda rows: rows.repartition(min(2 * blocks * slices, 4096), "slice", "block").groupBy("slice", "block")
    kinds = {f.name: f.dataType.simpleString() for f in (queries.schema["query_id"], corpus.schema["id"])}
    scores = dealt(held_in).cogroup(dealt(asked_in)).applyInPandas(
        _best_of_tile, f"query_id {kinds['query_id']}, id {kinds['id']}, score double")
    top = scores.groupBy("query_id").agg(F.max(F.struct(
        F.round("score", 9).alias("r"), (-F.col("id")).alias("neg"), "score")).alias("t"))
    top = top.where(F.col("t.score") > min_score)
    return (queries.select("query_id").join(top, "query_id", "left").select(
        "query_id", F.col("t").isNotNull().alias("found"),
        (-F.col("t.neg")).alias("match_id"), F.col("t.score").alias("score")))


def _best_of_tile(held, asked):
    """The best text of a slice for every query of a block, ties to the smaller id.

    Every cell is multiplied with the queries that ask for its term, about ``PRODUCTS`` at a
    time, and the products of a text and a query are added up in place.
    """
    import numpy as np
    import pandas as pd

    none = pd.DataFrame({"query_id": [], "id": [], "score": []})
    if not len(held) or not len(asked):
        return none
    names, who = np.unique(asked["query_id"].to_numpy(), return_inverse=True)
    need = np.zeros(len(names))
    need[who] = asked["need"]
    by_term = np.argsort(asked["no"].to_numpy(), kind="stable")
    who, idf = who[by_term], asked["idf"].to_numpy()[by_term]
    terms, first, uses = np.unique(asked["no"].to_numpy()[by_term], return_index=True, return_counts=True)
    held = held.sort_values("id", kind="stable")
    ids, start = np.unique(held["id"].to_numpy(), return_index=True)
    at = np.minimum(np.searchsorted(terms, held["no"].to_numpy()), len(terms) - 1)
    part = held["part"].to_numpy()
    count = np.where(terms[at] == held["no"].to_numpy(), uses[at], 0)
    before = np.concatenate([[0], np.cumsum(count)])
    start = np.append(start, len(held))
    top, winner = np.full(len(names), -np.inf), np.zeros(len(names), dtype=np.int64)
    grade, step = np.full(len(names), -np.inf), max(1, PRODUCTS // len(names))
    low = 0
    while low < len(ids):
        # Texts up to the bound on products and on sums, one at least.
        high = int(np.searchsorted(before[start], before[start[low]] + PRODUCTS, "right")) - 1
        high = min(max(high, low + 1), low + step, len(ids))
        a, z = start[low], start[high]
        n = count[a:z]
        cell = np.repeat(np.arange(a, z), n)
        entry = first[at[cell]] + np.arange(len(cell)) - np.repeat(before[a:z] - before[a], n)
        text_no = np.searchsorted(start, cell, "right") - 1 - low
        place = text_no * len(names) + who[entry]
        size = (high - low) * len(names)
        score = np.bincount(place, part[cell] * idf[entry], size).reshape(-1, len(names))
        hits = np.bincount(place, minlength=size).reshape(-1, len(names))
        score[hits < need] = -np.inf
        graded = np.round(score, 9)
        row, col = graded.argmax(axis=0), np.arange(len(names))
        better = graded[row, col] > grade
        grade = np.where(better, graded[row, col], grade)
        top, winner = np.where(better, score[row, col], top), np.where(better, row + low, winner)
        low = high
    hit = np.isfinite(top)
    return pd.DataFrame({"query_id": names[hit], "id": ids[winner[hit]], "score": top[hit]}) if hit.any() else none
