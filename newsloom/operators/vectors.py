"""Tokens per text, stems, document frequencies and TF-IDF weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon, stems, text, words
from ..session import settle
from . import joins


def tokenize(df: DataFrame, id_: str, body: str) -> DataFrame:
    """(id, pos, token) of every text."""
    return df.select(id_, F.posexplode(text.tokens(F.col(body))).alias("pos", "token"))


def language_likelihood(df: DataFrame, id_: str, body: str,
                        languages=lexicon.LANGUAGES) -> DataFrame:
    """(id, language, hits): distinct lower-case tokens in each stop list."""
    cut = df.select(id_, F.array_distinct(text.tokens(F.lower(body))).alias("_w"))
    scores = text.language_scores("_w", languages)
    pairs = F.array(*[F.struct(F.lit(n).alias("language"), s.alias("hits")) for n, s in scores.items()])
    return cut.select(id_, F.explode(pairs).alias("_p")).select(id_, "_p.language", "_p.hits")


def with_language(df: DataFrame, body: str, out: str = "language",
                  languages=lexicon.LANGUAGES) -> DataFrame:
    """Add the most likely language; row-local.

    The generator keeps a later filter on the language from being pushed below
    it, where the language would be worked out a second time.
    """
    scored = df.withColumn("_l", words.best_language(F.col(body), languages))
    return scored.select("*", F.explode(F.array("_l")).alias(out)).drop("_l")


def placed_with_language(df: DataFrame, id_: str, body: str, language: str | None) -> DataFrame:
    """(id, body, language), placed by id; left alone when ``language`` is there already."""
    if language:
        return df.select(id_, body, F.col(language).alias("language"))
    return with_language(joins.placed(df.select(id_, body), id_), body)


def clean_tokens(df: DataFrame, id_: str, body: str, language: str | None = None) -> DataFrame:
    """(id, language, pos, token, stem): detect, cut, drop stop words, stem.

    ``pos`` counts the tokens of the whole text.
    """
    if language is None:
        df = with_language(df, body, "language")
        language = "language"
    kept = df.select(
        id_, F.col(language).alias("language"),
        F.posexplode(text.tokens(F.col(body))).alias("pos", "token"))
    kept = kept.where(text.is_content("lower(token)", "language"))
    return stems.with_stem(kept, "token", "language")


def stem_vocabulary(df: DataFrame, id_: str, body: str, language: str) -> DataFrame:
    """(language, token, uses, stem): every distinct word is stemmed once."""
    words = df.select(F.col(language).alias("language"),
                      F.explode(text.tokens(F.lower(body))).alias("token"))
    vocabulary = words.groupBy("language", "token").agg(F.count("*").alias("uses"))
    return stems.with_stem(vocabulary, "token", "language")


def term_counts(df: DataFrame, id_: str, body: str) -> DataFrame:
    """(id, term, tf) of short texts: lower, detect, drop, stem, drop again.

    Texts are placed by id first: that spreads the word work, and the grouping by
    (id, word) then needs no exchange of the far larger word rows.  The words of all
    texts are written once and each distinct word is stemmed once, whatever the number
    of texts that use it.
    """
    low = joins.placed(df.select(id_, F.lower(body).alias("_t")), id_)
    low = with_language(low, "_t", "language")
    rows = low.select(id_, "language", F.explode(text.tokens(F.col("_t"))).alias("token"))
    rows = rows.where(text.is_content("token", "language"))
    # French rules or the others: a word is looked up by a mark for them and the word itself.
    word = F.concat(F.when(F.col("language").eqNullSafe("french"), "f").otherwise("-"), "token")
    rows = settle(rows.groupBy(id_, word.alias("_word")).agg(F.count("*").alias("_n")))
    stemmed = settle(_stemmed(rows))
    # A word whose stem is no term finds nothing.
    found = joins.lookup(rows, stemmed, "_word", "_uses", rows.count()).where("term is not null")
    return found.groupBy(id_, "term").agg(F.sum("_n").alias("tf"))


def _stemmed(rows: DataFrame) -> DataFrame:
    """(_word, _uses, term): the stem of every distinct marked word, without those on a stop list."""
    known = rows.groupBy("_word").agg(F.count("*").alias("_uses"))
    known = known.withColumns({"_token": F.expr("substring(_word, 2)"),
                               "_language": F.when(F.col("_word").startswith("f"), "french")})
    known = stems.with_stem(known, "_token", "_language", "term").where(text.is_free("term"))
    return known.select("_word", "_uses", "term")


def document_frequency(counts: DataFrame, copies: str | None = None) -> DataFrame:
    """(term, df); ``copies`` weighs a row that stands for several texts."""
    n = F.sum(copies) if copies else F.count("*")
    return counts.groupBy("term").agg(n.alias("df"))


def smooth_idf(n, df: Column) -> Column:
    return F.log((F.lit(1.0) + n) / (F.lit(1.0) + df)) + F.lit(1.0)


def weigh(counts: DataFrame, id_: str, texts: int, df: DataFrame, keep=(),
          total: int | None = None) -> DataFrame:
    """One row per text: ``vec``, its (df, term, w) sorted rarest first, of length one.

    ``counts`` holds (id, term, tf, *keep) with one row per text and term;
    ``total`` is its number of rows.
    """
    total = counts.count() if total is None else total
    freq = df.withColumn("df_", F.col("df"))
    rows = joins.lookup(counts, freq, "term", "df_", total)
    rows = rows.withColumn("w", F.col("tf") * smooth_idf(F.lit(float(texts)), F.col("df")))
    vec = rows.groupBy(id_, *keep).agg(
        F.array_sort(F.collect_list(F.struct("df", "term", "w"))).alias("_v"),
        F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("_norm"))
    return vec.select(id_, *keep, F.transform("_v", lambda e: F.struct(
        e["df"].alias("df"), e["term"].alias("term"), (e["w"] / F.col("_norm")).alias("w"))).alias("vec"))


def tfidf(df: DataFrame, id_: str, body: str) -> DataFrame:
    """(id, term, tf, df, weight) with unit-length rows."""
    texts = df.count()
    counts = settle(term_counts(df, id_, body))
    vec = weigh(counts, id_, texts, document_frequency(counts))
    return vec.select(id_, F.explode("vec").alias("e")).select(
        id_, "e.term", F.col("e.df").alias("df"), F.col("e.w").alias("weight"))
