"""Tags, words, phrases, daily figures, retention and feed entries.

Words of one text are counted, ranked and collected inside its row: neither the text
nor its words are exchanged.  Phrases, which need windows over words, place the text by
its id first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import arrays, lexicon, text, words
from . import vectors


def term_frequency(df: DataFrame, id_: str, body: str) -> DataFrame:
    """(id, token, tf, first_pos) of the tokens as written."""
    words = df.select(id_, F.explode(arrays.counted(text.tokens(F.col(body)))).alias("w"))
    return words.select(id_, F.col("w.value").alias("token"), F.col("w.n").alias("tf"), F.col("w.first").alias("first_pos"))


def content_words(df: DataFrame, body: str, language: str | None = None, folded: bool = False) -> DataFrame:
    """Add ``_words``: the content words of a text as array<struct<value, first, n>>.

    With ``folded`` the spellings that fold to one word count as that word, in one pass;
    words that fold to nothing are left out.
    """
    if language is None:
        df, language = vectors.with_language(df, body, "_language"), "_language"
    held = df.withColumn("_words", words.counted(F.col(body), F.col(language), folded))
    return held.drop("_language") if language == "_language" else held


def tag_list(found: Column, k: int, folded: bool = True) -> Column:
    """The k most frequent of ``_words``, folded, ties by first use; ``folded`` says that the words are it already."""
    # Only words that are used as often as the k-th one are put in order.
    uses = F.sort_array(F.transform(found, lambda w: w["n"]), asc=False)
    often = arrays.let(F.coalesce(F.try_element_at(uses, F.lit(k)), F.lit(0)), lambda least: F.filter(
        found, lambda w: w["n"] >= least))
    ranked = F.sort_array(F.transform(often, lambda w: F.struct(
        (-w["n"]).alias("down"), w["first"].alias("first"), w["value"].alias("value"))))
    best = F.transform(F.slice(ranked, 1, k), lambda w: w["value"])
    return best if folded else F.filter(F.transform(best, text.fold), lambda t: t != "")


def top_tags(df: DataFrame, id_: str, body: str, k: int, fold_first: bool = True) -> DataFrame:
    """(id, tags): the k most frequent content words of a text, ties by first use.

    ``fold_first`` merges spellings before counting; without it the k most
    frequent spellings are taken and folded afterwards, which may repeat or
    lose some.  A text without such words gives no row.
    """
    words = content_words(df.select(id_, body), body, folded=fold_first)
    return words.select(id_, _once(tag_list(F.col("_words"), k, fold_first)).alias("tags")).where(F.size("tags") > 0)


def _once(value: Column) -> Column:
    """A generator: a filter on the value is not pushed below it, where the value would be worked out a second time."""
    return F.explode(F.array(value))


def main_words(df: DataFrame, id_: str, body: str, language: str | None = None) -> DataFrame:
    """(id, language, words): words used at least 1 + n/100 times, in order of first use.

    n counts all tokens of the text.  Only French and English texts get words.
    With ``language`` it is known already.
    """
    texts = (df.select(id_, body, F.col(language).alias("language")) if language
             else vectors.with_language(df.select(id_, body), body))
    texts = texts.where(F.col("language").isin("french", "english"))
    texts = texts.select(id_, "language", _once(word_list(F.col(body), "language")).alias("words"))
    return texts.where(F.size("words") > 0)


def word_list(body: Column, language: str) -> Column:
    """The main words of a text, see ``main_words``; ``language`` names a column."""
    def kept(tokens: Column) -> Column:
        words = arrays.counted(F.transform(tokens, lambda t: F.lower(t)))
        often = F.filter(words, lambda w: w["n"] >= 1 + F.size(tokens) / 100)
        return F.filter(often, lambda w: text.content_word(w["value"], F.col(language), lexicon.MEASURES))

    entries = arrays.let(text.spaced_tokens(body), kept)
    ordered = F.sort_array(F.transform(entries, lambda w: F.struct(w["first"].alias("first"), w["value"].alias("value"))))
    return F.transform(ordered, lambda w: w["value"])


def _spaced(df: DataFrame, id_: str, body: str, language: str | None = None) -> DataFrame:
    """(id, language, _t): spaced tokens of French and English texts.

    Explode ``_t`` with the outer form: for the inner one the optimizer adds a
    filter on its size, which cuts every text a second time below the exchange.
    """
    texts = vectors.placed_with_language(df, id_, body, language)
    texts = texts.where(F.col("language").isin("french", "english"))
    return texts.select(id_, "language", text.spaced_tokens(F.col(body)).alias("_t"))


def _plain_content() -> Column:
    return text.is_content("word", "language") & ~F.col("word").isin(*lexicon.MEASURES)


def main_phrases(df: DataFrame, id_: str, body: str, shortest: int = 2, longest: int = 15) -> DataFrame:
    """(id, phrase): distinct runs of content words that hold a frequent word.

    A run ends at a stop word or mark; inside it only words of 2 to 15 letters
    are kept.  Runs come from a gaps-and-islands window over one text.
    """
    rows = _spaced(df, id_, body).select(
        id_, "language", F.size("_t").alias("n"), F.posexplode_outer("_t").alias("pos", "token"))
    rows = rows.withColumn("word", F.lower("token")).where(
        _plain_content() & F.col("word").rlike(r"[\p{L}\p{N}]"))
    along = Window.partitionBy(id_).orderBy("pos")
    rows = rows.withColumn("run", F.col("pos") - F.row_number().over(along))
    rows = rows.withColumn("tf", F.count("*").over(Window.partitionBy(id_, "word")))
    ok = F.length("word").between(shortest, longest)
    phrases = rows.where(ok).groupBy(id_, "run").agg(
        F.array_sort(F.collect_list(F.struct("pos", "word"))).alias("w"),
        F.max(F.col("tf") >= 1 + F.col("n") / 100).alias("frequent"))
    return (phrases.where("frequent")
            .select(id_, F.array_join(F.transform("w", lambda e: e["word"]), " ").alias("phrase"))
            .distinct())


def contains_word(tokens: Column, word: Column) -> Column:
    """True when some token equals the word."""
    return F.array_contains(tokens, word)


def article_tags(tags: DataFrame, rules: DataFrame, id_: str) -> DataFrame:
    """(id, tags): the fixed tags of the source, then those found in the text.

    ``tags`` holds (id, rule_tags, tags).
    """
    none = F.array().cast("array<string>")
    return tags.select(id_, F.concat(F.coalesce("rule_tags", none), F.coalesce("tags", none)).alias("tags"))


def canonical_tags(tags: DataFrame, aliases: DataFrame) -> DataFrame:
    """Add ``canonical`` and ``known`` to rows with a ``tag``; aliases match in any case.

    The dictionary is configuration and is broadcast once counted.
    """
    from ..session import small_side

    names = aliases.select(F.lower("alias").alias("_a"), "canonical").unionByName(
        aliases.select(F.lower("canonical").alias("_a"), "canonical"))
    names = names.where("_a is not null").groupBy("_a").agg(F.min("canonical").alias("_c"))
    joined = tags.join(small_side(names), F.lower("tag") == F.col("_a"), "left")
    return joined.select(*tags.columns, F.coalesce("_c", F.col("tag")).alias("canonical"),
                         F.col("_c").isNotNull().alias("known"))


def tag_uses(tags: DataFrame, day: str, order: str) -> DataFrame:
    """(day, tag, uses, first): how often a day uses a tag, and where first.

    ``tags`` holds one array of tags per article.  Counts combine before the exchange.
    """
    uses = tags.select(day, order, F.posexplode("tags").alias("pos", "tag"))
    return uses.groupBy(day, "tag").agg(F.count("*").alias("uses"), F.min(F.struct(order, "pos")).alias("first"))


def merge_uses(parts: DataFrame, day: str) -> DataFrame:
    """The uses of several runs of a day added up."""
    return parts.groupBy(day, "tag").agg(F.sum("uses").alias("uses"), F.min("first").alias("first"))


def top_uses(uses: DataFrame, day: str, k: int) -> DataFrame:
    """(day, rank, tag, uses): the k most used tags of each day, ties by first use."""
    rank = Window.partitionBy(day).orderBy(F.desc("uses"), "first")
    return (uses.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k)
            .select(day, "rank", "tag", "uses"))


def tag_trend(tags: DataFrame, day: str, order: str, k: int = 10) -> DataFrame:
    """(day, rank, tag, uses): the most used tags of each day, ties by first use.

    Counts combine before the exchange, and so does the top k of a day.
    """
    return top_uses(tag_uses(tags, day, order), day, k)


def daily_stats(articles: DataFrame, day: str) -> DataFrame:
    """Counters per day.

    ``articles`` holds accepted, is_duplicate, nbwords and nbtags; words and
    tags count for accepted rows only.
    """
    ok = F.col("accepted")
    return articles.groupBy(day).agg(
        F.count("*").alias("total"),
        F.count_if(ok).alias("twitted"),
        F.count_if(~ok).alias("filtered"),
        F.count_if(F.col("is_duplicate")).alias("duplicates"),
        F.coalesce(F.sum(F.when(ok, F.col("nbwords"))), F.lit(0)).cast("long").alias("nbwords"),
        F.coalesce(F.sum(F.when(ok, F.col("nbtags"))), F.lit(0)).cast("long").alias("nbtags"))


def merge_stats(stored: DataFrame, run: DataFrame | None, day: str) -> DataFrame:
    """Counters of earlier runs of a day plus those of this run."""
    sums = ["total", "twitted", "filtered", "duplicates", "nbwords", "nbtags"]
    both = stored.select(day, *sums)
    both = both if run is None else both.unionByName(run.select(day, *sums))
    return both.groupBy(day).agg(*[F.sum(c).alias(c) for c in sums])


def retain(articles: DataFrame, order: str, n: int, per: list[str] | None = None) -> DataFrame:
    """The newest n articles, over all or per group."""
    if not per:
        return articles.orderBy(F.desc(order)).limit(n)
    rank = Window.partitionBy(*per).orderBy(F.desc(order))
    return articles.withColumn("_r", F.row_number().over(rank)).where(F.col("_r") <= n).drop("_r")


def entry_content(image: Column, raw: Column, body: Column, tags: Column,
                  similarity: Column, similarity_with: Column) -> Column:
    """HTML of a feed entry: image, text, tag paragraph, similarity paragraph."""
    none = F.lit("")
    main = F.coalesce(raw, F.concat(F.lit("<p>"), body, F.lit("</p>")), none)
    head = F.when(image.isNotNull(), F.concat(F.lit('<img src="'), image, F.lit('"/>'))).otherwise(none)
    shown = F.when(F.size(tags) > 0, F.concat(F.lit("['"), F.array_join(tags, "', '"), F.lit("']"))
                   ).otherwise(F.lit("[]"))
    return F.concat(
        head, main, F.lit("<p>Tags :"), shown, F.lit("</p><p>Similarity of "),
        F.coalesce(F.round(similarity, 2), F.lit(0.0)).cast("string"),
        F.lit(" with "), F.coalesce(similarity_with, none), F.lit("</p>"))


def feed_entries(articles: DataFrame, order: str, n: int) -> DataFrame:
    """The newest n articles as feed entries."""
    newest = retain(articles, order, n)
    return newest.select(
        F.col(order).cast("string").alias("id"), "title", F.col("service").alias("author"),
        "published", F.col("published").alias("updated"), F.col("source").alias("link"),
        entry_content(F.col("image"), F.col("raw"), F.col("text"), F.col("tags"),
                      F.col("similarity"), F.col("similarity_with")).alias("content"))


def short_post(title: Column, link: Column, mention: Column, limit: int, link_room: int) -> Column:
    """Title cut to fit, a link, and the mention if there is room for it."""
    room = limit - link_room
    head = F.when(F.length(title) >= room, F.substring(title, 1, room - 1)).otherwise(title)
    mention = F.coalesce(mention, F.lit(""))
    body = F.concat(head, F.lit(" "), link)
    return F.when(F.length(body) + F.length(mention) < room,
                  F.concat(body, F.lit(" "), mention)).otherwise(body)


def long_post(title: Column, link: Column, mention: Column) -> Column:
    """Title, link and mention, never cut."""
    return F.concat(title, F.lit(" "), link, F.lit(" "), F.coalesce(mention, F.lit("")))
