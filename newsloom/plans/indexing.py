"""Enriching articles for the search index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import digest, joins, summary, vectors
from ..session import settle


def enrich(articles: DataFrame, title: str = "title", site: str = "source", content: str = "content",
           published=None, sentences: int = 3) -> DataFrame:
    """Search documents from (source, title, content).

    The id is a hash of what the article is, so indexing again adds nothing.
    Summary and main words exist for French and English texts only.
    """
    key = F.sha2(F.concat_ws("\u0001", F.col(site), F.col(title), F.col(content)), 256)
    rows = articles.select(key.alias("id"), F.col(title).alias("title"),
                           F.col(site).alias("site"), F.col(content).alias("content"),
                           (F.current_timestamp() if published is None else F.col(published))
                           .alias("published"))
    rows = vectors.with_language(joins.placed(rows, "id").dropDuplicates(["id"]), "content")
    routed = F.col("language").isin("french", "english")
    # Texts are cut for their words once, where they lie; summaries read what was written.
    rows = settle(rows.withColumn("mainwords", F.when(routed, digest.word_list(F.col("content"), "language"))))
    texts = rows.where(routed).select("id", "content", "language")
    short = summary.summarise(texts, "id", "content", sentences, "language").withColumnRenamed("summary", "abstract")
    empty = F.lit("")
    return (rows.join(short, "id", "left")
            .select("id", "title", "content", F.coalesce("abstract", empty).alias("abstract"),
                    "site", empty.alias("mainsentences"),
                    F.coalesce("mainwords", F.array().cast("array<string>")).alias("mainwords"),
                    "language", "published", empty.alias("is_tagged_by_human"),
                    empty.alias("is_tagged_by_ai")))
