"""Extractive summaries (LexRank, Erkan & Radev 2004)."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import stems, text
from ..session import BROADCAST_ROWS, settle
from . import joins, vectors

SENTENCE_PATTERN = r"([^.!?\n]+[.!?]*)"
EDGE_ABOVE = 0.1
SETTLED_BELOW = 0.1


def sentences(body: Column) -> Column:
    """The sentences of a text, in order."""
    return F.filter(F.transform(F.regexp_extract_all(body, F.lit(SENTENCE_PATTERN), F.lit(1)),
                                lambda x: F.trim(x)), lambda x: x != "")


def centrality(df: DataFrame, id_: str, body: str, language: str | None = None) -> DataFrame:
    """(id, sentences, scores): LexRank score of every sentence of a text, side by side.

    Texts are cut where they lie and written once, under a number of their own.  Words are
    stemmed once for the whole corpus; from then on a word is the number of its stem.  The
    sentence graph of one text is worked out from its numbers alone; nothing is cut off,
    no sentence pairs are shuffled, and sentences meet their scores again at the end.
    """
    texts = (df.select(id_, body, F.col(language).alias("language")) if language
             else vectors.with_language(df.select(id_, body), body))
    texts = settle(texts.select(id_, "language", sentences(F.col(body)).alias("sentences"),
                                F.monotonically_increasing_id().alias("_t"))).where(F.size("sentences") > 0)
    words = texts.select("_t", "language", F.posexplode("sentences").alias("s", "sentence"))
    words = words.select("_t", "language", "s", F.explode(text.tokens(F.lower("sentence"))).alias("token"))
    words = words.where(F.col("token").rlike(r"^\p{L}+$") & text.is_content("token", "language"))
    words = settle(words.select("_t", "s", F.col("language").eqNullSafe("french").alias("french"), "token"))
    cells = joins.placed(_numbered(words), "_t")
    held = cells.groupBy("_t").agg(F.collect_list("s").alias("rows"), F.collect_list("no").alias("stems"))
    scores = texts.select("_t", F.size("sentences").alias("n")).join(held, "_t", "left").mapInPandas(
        _rank_batches, "_t long, scores array<double>")
    return texts.join(scores, "_t").select(id_, "sentences", "scores")


def _numbered(words: DataFrame) -> DataFrame:
    """(_t, s, no): the number of the stem of every word of (_t, s, french, token).

    Frequent words are answered by a bounded broadcast, only the others are exchanged.
    """
    known = words.groupBy("french", "token").agg(F.count("*").alias("uses"))
    known = known.withColumn("language", F.when(F.col("french"), "french"))
    known = settle(stems.with_stem(known, "token", "language", "term"))
    numbers = known.select("term").distinct().select("term", F.monotonically_increasing_id().alias("no"))
    table = settle(known.join(numbers, "term").select("french", "token", "uses", "no"))
    total = table.agg(F.coalesce(F.sum("uses"), F.lit(0))).first()[0]
    often = F.col("uses") >= max(total / BROADCAST_ROWS, 1.0)
    key, hot, cold = ["french", "token"], table.where(often), table.where(~often)
    answered = words.join(F.broadcast(hot), key)
    rest = words.join(F.broadcast(hot.select(*key)), key, "left_anti").join(cold, key)
    return answered.select("_t", "s", "no").unionByName(rest.select("_t", "s", "no"))


def _rank_batches(batches: Iterator) -> Iterator:
    for pdf in batches:
        pdf["scores"] = [lexrank(n, *_cells(rows, stem)) for n, rows, stem in zip(pdf["n"], pdf["rows"], pdf["stems"])]
        yield pdf[["_t", "scores"]]


def _cells(rows, stem):
    """(rows, terms, tfs) of the sentence-term matrix; tf by the most frequent word of a sentence."""
    import numpy as np

    if rows is None or not len(rows):
        return None, None, None
    terms, col = np.unique(np.asarray(stem), return_inverse=True)
    cell, n = np.unique(np.asarray(rows, dtype=np.int64) * len(terms) + col, return_counts=True)
    row = cell // len(terms)
    first = np.flatnonzero(np.diff(row, prepend=-1))
    most = np.repeat(np.maximum.reduceat(n, first), np.diff(np.append(first, len(row))))
    return row, cell % len(terms), n / most


def lexrank(n: int, rows, terms, tfs, products: int = 1 << 22) -> list[float]:
    """Stationary scores of the sentence graph of one text.

    ``rows``, ``terms`` and ``tfs`` list the cells of its sentence-term matrix.
    Edges are found a block of sentences at a time, along the sentences that share a
    word: a block takes at most about ``products`` products.
    """
    import numpy as np

    if rows is None or not len(rows):
        return [1.0 / n] * n
    row = np.asarray(rows)
    _, col, uses = np.unique(np.asarray(terms), return_inverse=True, return_counts=True)
    weight = np.asarray(tfs) * np.log(n / (1.0 + uses[col]))
    length = np.sqrt(np.bincount(row, weight * weight, n))
    weight = weight / np.where(length[row] > 0, length[row], 1.0)
    # A word of a single sentence makes no edge to another one.
    shared = uses[col] > 1
    order = np.flatnonzero(shared)[np.argsort(row[shared], kind="stable")]
    near_row, near_weight, near_col = row[order], weight[order], col[order]
    by_word = np.argsort(near_col, kind="stable")
    list_row, list_weight = near_row[by_word], near_weight[by_word]
    first, count = np.searchsorted(near_col[by_word], near_col), uses[near_col]
    before = np.concatenate([[0], np.cumsum(count)])
    heads, tails = [], []
    start, low, most = 0, 0, max(1, products // n)
    while low < len(order):
        # Sentences up to the bound on products and on sums, one at least.
        high = int(np.searchsorted(before, before[low] + products, "right")) - 1
        stop = min(max(int(near_row[high]) if high < len(order) else n, start + 1), start + most, n)
        high = int(np.searchsorted(near_row, stop))
        m = count[low:high]
        cell = np.repeat(np.arange(low, high), m)
        entry = first[cell] + np.arange(len(cell)) - np.repeat(before[low:high] - before[low], m)
        cosine = np.bincount((near_row[cell] - start) * n + list_row[entry], near_weight[cell] * list_weight[entry],
                             (stop - start) * n)
        pair = np.flatnonzero(np.round(cosine, 9) > EDGE_ABOVE)
        head, tail = pair // n + start, pair % n
        other = head != tail
        heads.append(head[other])
        tails.append(tail[other])
        start, low = stop, high
    itself = np.flatnonzero(length > 0)
    head, tail = np.concatenate(heads + [itself]), np.concatenate(tails + [itself])
    degree = np.maximum(np.bincount(head, minlength=n), 1)
    p = np.full(n, 1.0 / n)
    while True:
        after = np.bincount(tail, p[head] / degree[head], n)
        moved = np.linalg.norm(after - p)
        p = after
        if round(moved, 9) < SETTLED_BELOW:
            return p.tolist()


def summarise(df: DataFrame, id_: str, body: str, n: int, language: str | None = None) -> DataFrame:
    """(id, summary): the n most central sentences in text order, joined as they are."""
    told = centrality(df, id_, body, language)
    graded = F.transform(F.arrays_zip("sentences", "scores"), lambda e, s: F.struct(
        (-F.round(e["scores"], 6)).alias("low"), s.alias("s"), e["sentences"].alias("sentence")))
    best = F.slice(F.array_sort(graded), 1, n)
    in_order = F.array_sort(F.transform(best, lambda e: F.struct(e["s"].alias("s"), e["sentence"].alias("sentence"))))
    return told.select(id_, F.array_join(F.transform(in_order, lambda e: e["sentence"]), "").alias("summary"))
