"""Registered queries: each operator over the whole of the given tables."""

from __future__ import annotations

import dataclasses
import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions import markup, text, urls
from newsloom.operators import (digest, pages as page_ops, rules, search, seen, similarity,
                                summary, vectors)
from newsloom.options import RunOptions
from newsloom.plans import indexing, watcher
from newsloom.session import fresh_path, settle, ship
from newsloom.sinks import stores
from newsloom.sources import feeds
from newsloom.sources.tables import read_table
from newsloom.streaming import jobs

from . import fixtures

QUERIES = {}
# Places and ranks are 64-bit, as in the SQL.
POSITIONS = ("pos", "first_pos", "rank")
OPTIONS = RunOptions()


def query(fn):
    @functools.wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        out = fn(spark, sf_dir)
        return out.withColumns({c: F.col(c).cast("long") for c in POSITIONS if c in out.columns})

    QUERIES[fn.__name__] = run
    return fn


# --- inputs --------------------------------------------------------------------

def documents(spark, d) -> DataFrame:
    """In place: for operators that place texts themselves."""
    return spark.read.parquet(f"{d}/documents.parquet")


def spread_documents(spark, d) -> DataFrame:
    """Spread over the cores: for row-local work on whole texts."""
    return read_table(spark, d, "documents")


def as_articles(docs: DataFrame) -> DataFrame:
    title = F.split_part("text", F.lit("\n"), F.lit(1))
    published = F.expr("timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval("
                       "cast(doc_id div 48 as int), 0, cast((doc_id % 48) * 30 as int), 0)")
    link = F.concat(F.lit("https://"), "source", F.lit(".example.com/"), "lang", F.lit("/"),
                    F.col("doc_id").cast("string"))
    return docs.select(
        F.col("doc_id").alias("id"), title.alias("title"), "lang", F.col("source").alias("service"),
        "text", published.alias("published"), link.alias("link"))


def articles(spark, d) -> DataFrame:
    return as_articles(documents(spark, d))


def titles_of(spark, d) -> DataFrame:
    return articles(spark, d).select("id", "title")


def pages(spark, d) -> DataFrame:
    return read_table(spark, d, "pages")


def document_rules(spark) -> DataFrame:
    return spark.createDataFrame(fixtures.document_rules(), fixtures.DOCUMENT_RULE_TYPE)


def page_lang() -> F.Column:
    return F.regexp_extract("html", '<html lang="([a-z]*)"', 1)


def page_service() -> F.Column:
    return F.regexp_extract(urls.host(F.col("url")), r"([^.]+[.][^.]+)$", 1)


def keyed_pages(spark, d) -> DataFrame:
    rows = spark.read.parquet(f"{d}/pages.parquet").select("page_id", "url", page_lang().alias("page_lang"))
    return seen.keyed(rows, "url", "page_lang").drop("page_lang")


def seen_pages(spark, d) -> DataFrame:
    """What earlier runs stored: entries fetched over plain http."""
    return keyed_pages(spark, d).where(F.col("url").startswith("http://")).select(*seen.KEYS)


# --- projections -----------------------------------------------------------------

@query
def titles(spark, d):
    return titles_of(spark, d)


@query
def titles_union(spark, d):
    rows = articles(spark, d)
    history = rows.where("published < timestamp_ntz '2024-01-10 00:00:00'").select("id", "title")
    run = rows.where("published >= timestamp_ntz '2024-01-10 00:00:00'").select("id", "title")
    return history.unionByName(run)


@query
def url_canonical(spark, d):
    return pages(spark, d).select("page_id", urls.canonical(F.col("url")).alias("link"))


@query
def entry_key(spark, d):
    url = F.col("url")
    return pages(spark, d).select(
        "page_id", urls.scheme(url).alias("scheme"), urls.host(url).alias("feed_host"),
        urls.entry_key(urls.canonical(url)).alias("entry_key"), urls.entry_key(url).alias("raw_key"))


@query
def title_sanitize(spark, d):
    rows = rules.with_rules(articles(spark, d), document_rules(spark))
    return rows.select("id", rules.sanitise_title(F.col("title"), F.col("title_patterns")).alias("title"))


@query
def paragraph_sanitize(spark, d):
    lines = spread_documents(spark, d).select(
        F.col("doc_id").alias("id"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return lines.select("id", "pos", text.sanitise_paragraph(
        F.col("line"), ("leaux", "worthless", "Read next:")).alias("paragraph"))


@query
def word_count(spark, d):
    return spread_documents(spark, d).select(
        F.col("doc_id").alias("id"), text.word_count(F.col("text")).cast("long").alias("words"))


@query
def punct_spacing(spark, d):
    return spread_documents(spark, d).select(
        F.col("doc_id").alias("id"), text.space_marks(F.col("text")).alias("spaced"))


@query
def short_text(spark, d):
    rows = rules.with_rules(articles(spark, d), document_rules(spark))
    args = (F.col("title"), F.col("link"), F.col("mention"))
    return rows.select("id", digest.short_post(*args, 140, 24).alias("short_post"),
                       digest.long_post(*args).alias("long_post"))


@query
def url_absolutize(spark, d):
    href = F.regexp_extract("html", 'href="([^"]*)"', 1)
    kind = F.col("page_id") % 5
    img = (F.when(kind == 0, F.concat(F.lit("data:"), href)).when(kind == 1, F.concat(F.lit("/"), href))
           .when(kind == 2, href).when(kind == 3, F.concat(F.lit("http://img.example.com"), href))
           .otherwise(F.lit("")))
    return pages(spark, d).select("page_id", urls.absolutise(F.col("url"), img).alias("image"))


# --- pages -----------------------------------------------------------------------

def _paragraphs(spark, d):
    return page_ops.native_sections(pages(spark, d), "html", "article", "p", "paragraphs")


@query
def page_text(spark, d):
    return _paragraphs(spark, d).select(
        "page_id", page_ops.joined_text(F.col("paragraphs"), fixtures.PARAGRAPH_MARKERS).alias("text"))


@query
def page_formatted(spark, d):
    return _paragraphs(spark, d).select(
        "page_id", page_ops.formatted_text(F.col("paragraphs"), fixtures.PARAGRAPH_MARKERS).alias("raw"))


@query
def page_attr(spark, d):
    nav = markup.container(markup.visible(F.col("html")), "nav")
    hrefs = markup.attributes(nav, "a", "href")
    images = markup.attributes(nav, "img", "src")
    first = lambda values: F.coalesce(F.try_element_at(values, F.lit(1)), F.lit(""))
    return pages(spark, d).select("page_id", first(hrefs).alias("href"),
                                  page_ops.first_of(first(images), first(hrefs)).alias("image"))


@query
def page_tags(spark, d):
    rows = page_ops.native_sections(pages(spark, d), "html", "nav", "a", "links")
    return rows.select("page_id", F.array_join(page_ops.page_tags(F.col("links")), " ").alias("tags"))


def _locator(type_, section, value=None, attribute=None):
    return F.struct(F.lit(type_).alias("type"), F.lit("class").alias("name"),
                    F.lit(value).cast("string").alias("value"), F.lit(section).alias("section"),
                    F.lit(attribute).cast("string").alias("attribute"))


@query
def page_parse(spark, d):
    ruled = pages(spark, d).withColumns({
        "text_rule": _locator("article", "p"), "image_rule": _locator("nav", "img", None, "src"),
        "image_alt_rule": _locator("nav", "a", None, "href"), "tag_rule": _locator("nav", "a"),
        "content_rule": _locator("div", "div", "ad")})
    parsed = page_ops.located(ruled, "html")
    marks = fixtures.PARAGRAPH_MARKERS
    return parsed.select(
        "page_id", page_ops.joined_text(F.col("paragraphs"), marks).alias("text"),
        page_ops.formatted_text(F.col("paragraphs"), marks).alias("raw"),
        page_ops.first_of(F.col("image"), F.col("image_alt")).alias("image"),
        F.array_join(page_ops.page_tags(F.col("tag_texts")), " ").alias("tags"),
        F.col("content").isNotNull().alias("has_ad"))


@query
def page_elements(spark, d):
    """Every element of every page: place, depth, classes, link and the text up to the next tag."""
    rows = pages(spark, d).select("page_id", markup.parsed(F.col("html")).alias("page"))
    rows = rows.select("page_id", F.explode("page.elements").alias("e"))
    return rows.select("page_id", F.col("e.start").cast("long").alias("start"),
                       F.coalesce("e.stop", F.lit(-1)).cast("long").alias("stop"), F.col("e.depth").cast("long").alias("depth"),
                       "e.tag", F.array_join("e.classes", " ").alias("classes"),
                       F.coalesce(markup.attribute(F.col("e"), "href"), F.lit("")).alias("href"), "e.text")


@query
def page_blocks(spark, d):
    """Whole texts of all articles and their lists of links, read from the parsed page."""
    rows = pages(spark, d).select("page_id", markup.parsed(F.col("html")).alias("page"))
    page = F.col("page")
    links = F.transform(markup.find_all(page, "a"), lambda a: F.concat(
        markup.attribute(a, "href"), F.lit(" "), F.coalesce(markup.element_text(page, a), F.lit(""))))
    articles_ = F.filter(F.transform(markup.find_all(page, "article"), lambda a: markup.element_text(page, a)),
                         lambda t: t.isNotNull())
    ads = F.size(markup.find_all(page, "div", "ad")).cast("long")
    return rows.select("page_id", F.array_join(articles_, "|").alias("articles"), F.array_join(links, "|").alias("links"),
                       ads.alias("ads"))


@query
def filter_content(spark, d):
    ad = markup.container(markup.visible(F.col("html")), "div", "ad")
    rows = pages(spark, d).withColumn("ad", markup.plain_text(ad))
    words = F.array(*[F.lit(w) for w in fixtures.AD_WORDS])
    return rows.select("page_id", F.coalesce(page_ops.content_blocked(F.col("ad"), words), F.lit(False))
                       .alias("blocked"), F.col("ad").isNotNull().alias("has_ad"))


@query
def filter_selection(spark, d):
    table = spark.createDataFrame(fixtures.page_rules(), fixtures.PAGE_RULE_TYPE)
    rows = pages(spark, d).withColumns({"service": page_service(), "lang": page_lang()})
    rows = rules.with_rules(page_ops.native_sections(rows, "html", "nav", "a", "labels"), table)
    return rows.select("page_id", rules.selected(
        F.col("url"), F.col("labels"), F.col("url_selects"), F.col("label_selects")).alias("selected"))


# --- filters and joins -----------------------------------------------------------

@query
def filter_title(spark, d):
    rows = rules.with_rules(articles(spark, d), document_rules(spark))
    return rows.select("id", rules.title_blocked(F.col("title"), F.col("title_blocks")).alias("blocked"))


@query
def filter_url(spark, d):
    rows = rules.with_rules(articles(spark, d), document_rules(spark))
    return rows.select("id", rules.url_blocked(F.col("link"), F.col("url_blocks")).alias("blocked"))


@query
def accepted(spark, d):
    rows = watcher.judge(articles(spark, d), document_rules(spark), OPTIONS)
    return rows.select("id", F.array_join("reasons", ",").alias("reasons"), "accepted")


@query
def rule_join(spark, d):
    rows = rules.known_sources(articles(spark, d), document_rules(spark))
    return rows.select("id", "service", "lang", "mention",
                       F.array_join("title_patterns", "~").alias("title_patterns"))


@query
def seen_anti(spark, d):
    fresh = seen.unseen(keyed_pages(spark, d), seen_pages(spark, d), "page_id")
    return fresh.select("page_id", "lang", "feed_host", "entry_key", "link")


@query
def seen_store_anti(spark, d):
    """As ``seen_anti``, against keys stored by language and host."""
    path = fresh_path(spark, "seen")
    seen_pages(spark, d).withColumn("text", F.lit("")).write.partitionBy("lang", "feed_host").parquet(path)
    fresh = seen.unseen_in_store(keyed_pages(spark, d), stores.seen_keys(spark, path), "page_id")
    return fresh.select("page_id", "lang", "feed_host", "entry_key", "link")


@query
def publish_eligible(spark, d):
    rows = seen.publish_eligible(keyed_pages(spark, d), seen_pages(spark, d), ["lang", "feed_host"])
    return rows.select("page_id", "lang", "feed_host", "publish_ok")


@query
def word_membership(spark, d):
    rows = spread_documents(spark, d).select(F.col("doc_id").alias("id"), text.tokens(F.col("text")).alias("t"), "lang")
    return rows.select("id", digest.contains_word(F.col("t"), F.lit("the")).alias("has_the"),
                       digest.contains_word(F.col("t"), F.col("lang")).alias("has_lang"))


@query
def stopword_filter(spark, d):
    rows = vectors.with_language(spread_documents(spark, d), "text")
    rows = rows.select(F.col("doc_id").alias("id"), "language",
                       F.posexplode(text.tokens(F.col("text"))).alias("pos", "token"))
    return rows.where(text.is_content("lower(token)", "language")).select("id", "pos", "token")


@query
def find_by_text(spark, d):
    return search.first_containing(articles(spark, d), "id", "title", "text", fixtures.NEEDLE)


@query
def tag_canonical(spark, d):
    """Tags of the pages by a dictionary read from XML."""
    path = fresh_path(spark, "dictionary")
    spark.createDataFrame([(fixtures.tag_dictionary(),)], "value string").write.text(path)
    aliases = feeds.read_tag_aliases(spark, path)
    rows = page_ops.native_sections(pages(spark, d), "html", "nav", "a", "links")
    tags = rows.select("page_id", F.posexplode("links").alias("pos", "tag"))
    return digest.canonical_tags(tags, aliases).select("page_id", "pos", "tag", "canonical", "known")


# --- words -----------------------------------------------------------------------

@query
def tokenize(spark, d):
    return vectors.tokenize(spread_documents(spark, d), "doc_id", "text").withColumnRenamed("doc_id", "id")


@query
def lang_likelihood(spark, d):
    return vectors.language_likelihood(spread_documents(spark, d), "doc_id", "text").withColumnRenamed(
        "doc_id", "id")


@query
def lang_detect(spark, d):
    return vectors.with_language(spread_documents(spark, d), "text").select(
        F.col("doc_id").alias("id"), "language")


@query
def term_freq(spark, d):
    return digest.term_frequency(spread_documents(spark, d), "doc_id", "text").select(
        F.col("doc_id").alias("id"), "token", "tf", "first_pos")


@query
def doc_freq(spark, d):
    counts = vectors.term_counts(titles_of(spark, d), "id", "title")
    return vectors.document_frequency(counts)


@query
def stem_vocab(spark, d):
    rows = vectors.with_language(spread_documents(spark, d), "text")
    return vectors.stem_vocabulary(rows, "doc_id", "text", "language")


@query
def tokens_clean(spark, d):
    return vectors.clean_tokens(titles_of(spark, d), "id", "title").select(
        "id", "language", "pos", "token", "stem")


@query
def tfidf(spark, d):
    return vectors.tfidf(titles_of(spark, d), "id", "title").select(
        "id", "term", "df", F.round("weight", 6).alias("weight"))


@query
def top_tags(spark, d):
    return digest.top_tags(spread_documents(spark, d), "doc_id", "text", OPTIONS.tags_per_article).select(
        F.col("doc_id").alias("id"), F.array_join("tags", " ").alias("tags"))


@query
def top_tags_literal(spark, d):
    return digest.top_tags(spread_documents(spark, d), "doc_id", "text", OPTIONS.tags_per_article,
                           fold_first=False).select(
        F.col("doc_id").alias("id"), F.array_join("tags", " ").alias("tags"))


@query
def article_tags(spark, d):
    found = digest.top_tags(spread_documents(spark, d), "doc_id", "text", OPTIONS.tags_per_article)
    rows = articles(spark, d).select("id", "service", "lang").join(
        found.select(F.col("doc_id").alias("id"), F.col("tags").alias("found")), "id", "left")
    ruled = rules.with_rules(rows, document_rules(spark)).select(
        "id", F.col("tags").alias("rule_tags"), F.col("found").alias("tags"))
    return digest.article_tags(ruled, None, "id").select("id", F.array_join("tags", " ").alias("tags"))


@query
def main_words(spark, d):
    return digest.main_words(spread_documents(spark, d), "doc_id", "text").select(
        F.col("doc_id").alias("id"), "language", F.array_join("words", " ").alias("words"))


@query
def main_phrases(spark, d):
    return digest.main_phrases(documents(spark, d), "doc_id", "text").select(
        F.col("doc_id").alias("id"), "phrase")


@query
def summary_topn(spark, d):
    return summary.summarise(spread_documents(spark, d), "doc_id", "text", OPTIONS.summary_sentences).select(
        F.col("doc_id").alias("id"), "summary")


def _or_none(match_id: str):
    """-1 where there is no match, so that results compare as plain integers."""
    return F.coalesce(match_id, F.lit(-1).cast("long")).alias(match_id)


# --- similarity ------------------------------------------------------------------

@query
def near_dup_titles(spark, d):
    rows = titles_of(spark, d)
    best = similarity.best_earlier(rows, "id", "title")
    graded = similarity.verdict(best, rows, "id", "title", OPTIONS.duplicate_at)
    return graded.withColumn("match_id", _or_none("match_id"))


@query
def near_dup_asof(spark, d):
    best = similarity.best_recent(titles_of(spark, d), "id", "title", OPTIONS.retained)
    return best.select("id", _or_none("match_id"), F.round("score", 6).alias("score"))


@query
def sliding_similar(spark, d):
    best = similarity.best_in_buffer(titles_of(spark, d), "id", "title", OPTIONS.buffer_size)
    return best.select("id", _or_none("match_id"), F.round("score", 6).alias("score"))


@query
def sliding_buffer(spark, d):
    return similarity.buffer_contents(titles_of(spark, d), "id", "title", OPTIONS.buffer_size)


@query
def similar_topn(spark, d):
    rows = titles_of(spark, d)
    newest = rows.orderBy(F.desc("id")).limit(5)
    return similarity.similar_topn(rows, newest, "id", "title", 3).select(
        "query_id", "rank", "match_id", F.round("score", 6).alias("score"))


@query
def similar_all(spark, d):
    """The three most similar other titles of every title."""
    rows = titles_of(spark, d)
    return similarity.similar_topn_all(rows, rows, "id", "title", 3).select(
        "query_id", "rank", "match_id", F.round("score", 6).alias("score"))


@query
def more_like_this(spark, d):
    corpus = documents(spark, d).select(F.col("doc_id").alias("id"), F.col("text").alias("body"))
    asked = spark.read.parquet(f"{d}/benchmark.parquet").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("body"))
    return search.more_like_this(corpus, asked, min_tf=1).select(
        "query_id", "found", _or_none("match_id"),
        F.round(F.coalesce("score", F.lit(0.0)), 6).alias("score"))


# --- retention, figures, export --------------------------------------------------

@query
def retention(spark, d):
    return digest.retain(titles_of(spark, d), "id", OPTIONS.retained)


@query
def retention_per_source(spark, d):
    return digest.retain(articles(spark, d).select("id", "service", "title"), "id", 7, ["service"])


@query
def tag_trend(spark, d):
    found = digest.top_tags(spread_documents(spark, d), "doc_id", "text", OPTIONS.tags_per_article)
    day = F.expr("date_add(date '2024-01-01', cast(doc_id div 48 as int))")
    rows = found.select(F.date_format(day, "yyyy-MM-dd").alias("day"), F.col("doc_id").alias("id"), "tags")
    return digest.tag_trend(rows, "day", "id")


def _counted(spark, d):
    rows = watcher.counted(as_articles(spread_documents(spark, d)), document_rules(spark), OPTIONS)
    return rows.withColumn("day", F.date_format("published", "yyyy-MM-dd"))


@query
def daily_stats(spark, d):
    return watcher.daily(_counted(spark, d), "day").withColumn("top_trend", F.array_join("top_trend", " "))


@query
def stats_merge(spark, d):
    """Counters of two runs a day added up."""
    rows = _counted(spark, d)
    morning = F.hour("published") < 12
    return digest.merge_stats(digest.daily_stats(rows.where(morning), "day"),
                              digest.daily_stats(rows.where(~morning), "day"), "day")


@query
def daily_store_scan(spark, d):
    """Stores of all days, with their counters, written and read back."""
    path = fresh_path(spark, "days")
    rows = _counted(spark, d).withColumn("store", F.date_format("published", "yyyyMMdd"))
    kept = rows.where("accepted").select("store", "id", "service", "title", "lang", F.col("all_tags").alias("tags"))
    stores.write_daily_store(kept, watcher.daily(rows, "store"), path)
    stored, counters = feeds.read_daily_store(spark, f"{path}/*")
    back = stored.select(F.col("id").cast("long").alias("id"), "service", "title", "lang",
                         F.array_join("tags", " ").alias("tags"),
                         F.date_format(F.expr("date_add(date '2024-01-01', cast(cast(id as long) div 48 as int))"),
                                       "yyyy-MM-dd").alias("day"))
    counters = counters.withColumns({"day": F.date_format("day", "yyyy-MM-dd"),
                                     "top_trend": F.array_join("top_trend", " ")})
    return back.join(counters, "day")


def _settings(spark) -> DataFrame:
    """The rules of the watched sources, read from XML settings."""
    path = fresh_path(spark, "settings")
    spark.createDataFrame([(fixtures.watched_settings(),)], "value string").write.text(path)
    return feeds.flatten_rules(feeds.read_rules(spark, path))


def _fetched(spark, d) -> DataFrame:
    """Pages as fetched entries."""
    title = markup.plain_text(F.regexp_extract("html", "(?is)<title>(.*?)</title>", 1))
    return pages(spark, d).select(F.col("page_id").alias("id"), page_service().alias("service"),
                                  page_lang().alias("lang"), "url", title.alias("title"), "html")


@query
def watcher_run(spark, d):
    done = watcher.run(_fetched(spark, d), seen_pages(spark, d), _settings(spark), OPTIONS)
    return done.select("id", "link", "title", F.array_join("reasons", ",").alias("reasons"), "accepted",
                       _or_none("match_id"), "similarity", "text", "raw", "image",
                       F.array_join("all_tags", " ").alias("tags"), F.col("nbwords").cast("long").alias("nbwords"))


@query
def watcher_two_runs(spark, d):
    """The odd pages, then the even ones, against what the first run stored.

    The store keeps the newest 40 accepted titles; its ids lie between those of the
    second run.  Keys that the first run met are known to the second one.
    """
    options = dataclasses.replace(OPTIONS, retained=40)
    store, table, known = fresh_path(spark, "titles"), _settings(spark), seen_pages(spark, d)
    out = None
    for n, part in enumerate(("id % 2 = 1", "id % 2 = 0"), 1):
        done = settle(watcher.run(_fetched(spark, d).where(part), known, table, options, store, n))
        known = known.unionByName(done.select(*seen.KEYS))
        told = done.select(F.lit(n).cast("long").alias("run"), "id", "title", F.array_join("reasons", ",").alias("reasons"),
                           "accepted", _or_none("match_id"), "similarity")
        out = told if out is None else out.unionByName(told)
    return out


@query
def feed_export(spark, d):
    judged = watcher.judge(articles(spark, d), document_rules(spark), OPTIONS)
    kept = settle(digest.retain(judged.where("accepted"), "id", OPTIONS.exported))
    full = watcher.tagged(kept, OPTIONS).withColumns({
        "tags": F.col("all_tags"), "source": F.col("link"),
        "image": F.when(F.col("lang") == "fr", F.concat(F.col("link"), F.lit(".jpg"))),
        "raw": F.when(F.col("id") % 2 == 0, F.concat(F.lit("<p>"), F.col("title"), F.lit("</p>"))),
        "published": F.date_format("published", "yyyy-MM-dd HH:mm:ss")})
    return digest.feed_entries(full, "id", OPTIONS.exported)


# --- index -----------------------------------------------------------------------

@query
def doc_by_id(spark, d):
    return search.by_id(articles(spark, d), "id", 42).select("id", "title", "text", "lang")


@query
def field_by_id(spark, d):
    return search.field_by_id(articles(spark, d), "id", 42, "title")


@query
def field_update(spark, d):
    labels = spark.read.parquet(f"{d}/labels.parquet").select(
        F.col("doc_id").alias("id"),
        F.when(F.col("quality") == 1, F.lit("reviewed")).alias("is_tagged_by_human"))
    rows = articles(spark, d).select("id", "title", F.lit("").alias("is_tagged_by_human"))
    return search.update_fields(rows, labels, "id", ["is_tagged_by_human"])


def _to_index(spark, d):
    return articles(spark, d).select(
        F.concat_ws(" ", "title", F.col("id").cast("string")).alias("title"),
        F.col("service").alias("source"), F.col("text").alias("content"),
        F.col("published").cast("timestamp").alias("published"))


@query
def index_enrich(spark, d):
    rows = indexing.enrich(_to_index(spark, d), published="published")
    return rows.select("id", "title", "site", "language", "abstract",
                       F.array_join("mainwords", " ").alias("mainwords"), "is_tagged_by_ai")


@query
def index_append(spark, d):
    path = fresh_path(spark, "index")
    stores.create_index(spark, path)
    docs = articles(spark, d).select(
        F.sha2(F.concat_ws("|", "service", "title", "text"), 256).alias("id"), "title",
        F.col("text").alias("content"), F.col("service").alias("site"),
        F.col("lang").alias("language")).dropDuplicates(["id"])
    stores.append_index(docs, path)
    stores.append_index(docs, path)
    return stores.read_index(spark, path).select("id", "title", "site", "language")


# --- stores ----------------------------------------------------------------------

def _stored(spark, d):
    return articles(spark, d).select(
        "id", F.date_format("published", "yyyyMMdd").alias("store"), "service", "title",
        F.date_format("published", "yyyy-MM-dd'T'HH:mm:ss'+01:00'").alias("date"), "lang",
        F.col("link").alias("source"), F.lit(None).cast("string").alias("image"),
        F.array("service").alias("tags"), "text")


@query
def feed_store_scan(spark, d):
    path = fresh_path(spark, "store")
    stores.write_feed_store(_stored(spark, d), path)
    back = feeds.read_feed_store(spark, f"{path}/*")
    return back.select(F.col("id").cast("long").alias("id"), "service", "title", "lang", "source",
                       F.array_join("tags", " ").alias("tags"), "text",
                       F.date_format(F.to_utc_timestamp(feeds.parse_date("date"), F.current_timezone()),
                                     "yyyy-MM-dd HH:mm").alias("published_utc"))


@query
def rules_scan(spark, d):
    """Rules written as XML settings, read back and joined to the documents."""
    path = fresh_path(spark, "rules")
    raw = document_rules(spark).select(
        F.col("service").alias("_name"), F.col("lang").alias("_lang"),
        F.struct(F.transform("title_patterns", lambda p: F.struct(
            F.lit("title").alias("_type"), p.alias("_text"))).alias("remove")).alias("sanitize"),
        F.struct(F.transform("title_blocks", lambda p: F.struct(
            F.lit("title").alias("_type"), p.alias("_text"))).alias("filter")).alias("filters"),
        F.struct(F.col("tags").alias("tag")).alias("hashtags"))
    raw.write.format("xml").option("valueTag", "_text").option("rootTag", "data").option("rowTag", "service").save(path)
    table = feeds.flatten_rules(feeds.read_rules(spark, path)).select(
        "service", "lang", "title_patterns", "title_blocks", "tags")
    rows = rules.with_rules(articles(spark, d), table)
    title = rules.sanitise_title(F.col("title"), F.col("title_patterns"))
    return rows.select("id", title.alias("title"),
                       rules.title_blocked(title, F.col("title_blocks")).alias("blocked"))


@query
def article_files_scan(spark, d):
    path = fresh_path(spark, "files")
    stores.write_article_files(documents(spark, d).select(
        "source", F.col("doc_id").cast("string").alias("title"), F.col("text").alias("content")), path)
    return feeds.read_article_files(spark, path, encoded=True)


@query
def feed_entries_scan(spark, d):
    """Feeds landed as RSS files, read back as entries."""
    path = fresh_path(spark, "rss")
    (articles(spark, d).select("title", "link", F.col("service").alias("description"))
     .write.format("xml").option("rootTag", "channel").option("rowTag", "item").save(path))
    return feeds.read_entries(spark, path).select("title", "link", "summary")


def _atom(rows: DataFrame, path: str) -> None:
    """Articles as Atom files: a link to the feed before the one to the page."""
    link = lambda rel, href: F.struct(F.lit(rel).alias("_rel"), href.alias("_href"))
    odd = F.col("id") % 2 == 1
    own = F.when(odd, link("alternate", F.col("link"))).otherwise(link(None, F.col("link")))
    rows.select("title", F.array(link("self", F.lit("https://feed.example.com/")), own).alias("link"),
                F.when(odd, F.date_format("published", "yyyy-MM-dd HH:mm")).alias("published"),
                F.date_format("published", "yyyy-MM-dd").alias("updated"), F.col("service").alias("summary")).write.mode(
        "append").format("xml").option("rootTag", "feed").option("rowTag", "entry").save(path)


@query
def atom_entries_scan(spark, d):
    """Feeds landed as Atom files, read back as entries."""
    path = fresh_path(spark, "atom")
    _atom(articles(spark, d), path)
    return feeds.read_atom_entries(spark, path)


@query
def stream_entries(spark, d):
    """RSS and Atom files that land in two turns, read as one stream."""
    rss, atom, out, check = (fresh_path(spark, x) for x in ("rss", "atom", "entries", "ck"))
    for half in (0, 1):
        rows = articles(spark, d).where(F.floor(F.col("id") % 4 / 2) == half)
        _atom(rows.where("id % 2 = 0"), atom)
        (rows.where("id % 2 = 1").select("title", "link", F.col("service").alias("description"))
         .write.mode("append").format("xml").option("rootTag", "channel").option("rowTag", "item").save(rss))
        jobs.entries(spark, out, check, rss, atom, once=True).awaitTermination()
    return spark.read.parquet(out).select("title", "link", "summary", F.coalesce("published", F.lit("")).alias("published"))


@query
def feed_sink(spark, d):
    """The newest entries written as feed XML and read back."""
    path = fresh_path(spark, "feed")
    rows = articles(spark, d).withColumns({
        "image": F.concat(F.col("link"), F.lit(".jpg?a&b")), "raw": F.lit(None).cast("string"),
        "tags": F.array("service"), "source": F.col("link"), "similarity": F.lit(0.0),
        "similarity_with": F.col("title"), "published": F.date_format("published", "yyyy-MM-dd HH:mm:ss")})
    entries = digest.feed_entries(rows, "id", OPTIONS.exported)
    stores.write_feed(entries, path)
    back = (spark.read.format("xml").option("rowTag", "entry").option("ignoreSurroundingSpaces", "false")
            .schema(", ".join(f"{c} string" for c in entries.columns)).load(path))
    return back.withColumn("id", F.col("id").cast("long"))


@query
def text_sink(spark, d):
    path = fresh_path(spark, "texts")
    rows = page_ops.native_sections(
        seen.keyed(pages(spark, d).withColumn("page_lang", page_lang()), "url", "page_lang"),
        "html", "article", "p", "paragraphs")
    rows = rows.withColumn("text", page_ops.joined_text(F.col("paragraphs"), fixtures.PARAGRAPH_MARKERS))
    stores.write_texts(rows, path, "page_id")
    stores.write_texts(rows, path, "page_id")
    return spark.read.schema(stores.TEXT).parquet(path)


@query
def retained_sink(spark, d):
    path = fresh_path(spark, "retained")
    stores.write_retained(articles(spark, d).select("id", "service", "title"), path, OPTIONS.retained)
    return spark.read.parquet(path).select("id", "service", "title")


@query
def daily_sink(spark, d):
    """All days written, then the later days again: the earlier ones stay."""
    path = fresh_path(spark, "daily")
    rows = articles(spark, d).select(F.date_format("published", "yyyyMMdd").alias("day"), "id", "service")
    stores.write_daily(rows.withColumn("run", F.lit(1)), path)
    stores.write_daily(rows.where("day >= '20240105'").withColumn("run", F.lit(2)), path)
    return spark.read.parquet(path).groupBy(F.col("day").cast("string").alias("day"), "run").agg(
        F.count("*").alias("articles"))


# --- streams ---------------------------------------------------------------------

def _land(df: DataFrame, files: int) -> tuple[str, object]:
    path = fresh_path(df.sparkSession, "landing")
    df.repartition(files).write.parquet(path)
    return path, df.schema


def _page_stream(spark, d):
    rows = spark.read.parquet(f"{d}/pages.parquet").select("page_id", "url", page_lang().alias("page_lang"))
    return jobs.landed(spark, *_land(rows, 3))


@query
def stream_ingest(spark, d):
    out = fresh_path(spark, "ingested")
    jobs.ingest(_page_stream(spark, d), "url", "page_lang", out, fresh_path(spark, "ck"),
                once=True).awaitTermination()
    return spark.read.parquet(out).select("page_id", "lang", "feed_host", "entry_key", "link")


@query
def stream_dedup(spark, d):
    out = fresh_path(spark, "first")
    jobs.first_entries(_page_stream(spark, d), "url", "page_lang", out, fresh_path(spark, "ck"),
                       once=True).awaitTermination()
    return spark.read.parquet(out).select(*seen.KEYS)


# Days on which the parts of the bounded dedup land; a key is kept for three.
LANDED = ("2024-03-01", "2024-03-02", "2024-03-08", "2024-03-09")


@query
def stream_dedup_bounded(spark, d):
    """Entries that land on four days.  What came on the first two days is forgotten on the last one,
    and may come again; every ninth row of the last day is dated so early that it is left out."""
    url = F.concat(F.lit("https://"), "service", F.lit(".example.com/"), (F.col("id") % 5).cast("string"))
    rows = articles(spark, d).select("id", "lang", url.alias("url"))
    landing, out, check = (fresh_path(spark, x) for x in ("landing", "first", "ck"))
    for k, day in enumerate(LANDED):
        early = (F.lit(k == 3)) & (F.col("id") % 9 == 0)
        part = rows.where(F.floor(F.col("id") / 20) % 4 == k).withColumn("landed", F.when(early, F.lit(LANDED[0])).otherwise(F.lit(day)).cast("timestamp"))
        part.write.mode("append").parquet(landing)
        stream = jobs.landed(spark, landing, part.schema, files_per_batch=100_000)
        jobs.first_entries(stream, "url", "lang", out, check, once=True, event_time="landed", keep_for="3 days").awaitTermination()
    return spark.read.parquet(out).select(F.date_format("landed", "yyyy-MM-dd").alias("day"), *seen.KEYS)


@query
def stream_event_days(spark, d):
    """Rows per day of the events, with a watermark."""
    rows = spark.read.parquet(f"{d}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    out = fresh_path(spark, "days")
    # The files hold the month in no order, so no day may leave the state before the end.
    jobs.daily_counts(jobs.landed(spark, *_land(rows, 3)), "ts", out, fresh_path(spark, "ck"), late="60 days",
                      once=True).awaitTermination()
    return spark.read.parquet(out).select(F.date_format("day", "yyyy-MM-dd").alias("day"), "total")


@query
def stream_daily(spark, d):
    """All figures of the days over two landed batches, the second one done twice."""
    rows, table = articles(spark, d), document_rules(spark)
    landing, out, store, check = (fresh_path(spark, x) for x in ("landing", "figures", "titles", "ck"))
    for part in ("id % 2 = 1", "id % 2 = 0"):
        rows.where(part).write.mode("append").parquet(landing)
        stream = jobs.landed(spark, landing, rows.schema, files_per_batch=100_000)
        jobs.day_figures(stream, table, out, store, check, OPTIONS, once=True).awaitTermination()
    jobs.figures_of(table, out, store, OPTIONS)(rows.where("id % 2 = 0"), 1)
    return watcher.day_figures(spark, out).withColumn("top_trend", F.array_join("top_trend", " "))


@query
def stream_window(spark, d):
    """The register of each source after every title, over two landed batches: the odd ids first."""
    rows = articles(spark, d).select("id", "service", "title")
    landing, out, check = (fresh_path(spark, x) for x in ("landing", "windows", "ck"))
    for part in ("id % 2 = 1", "id % 2 = 0"):
        rows.where(part).write.mode("append").parquet(landing)
        stream = jobs.landed(spark, landing, rows.schema, files_per_batch=100_000)
        jobs.recent_windows(stream, "service", "id", "title", OPTIONS.buffer_size, out, check, once=True).awaitTermination()
    return spark.read.parquet(out).select(F.col("source").alias("service"), "id", F.col("slot").cast("long").alias("slot"), "text")


@query
def stream_neardup(spark, d):
    """Titles landed in two batches, the odd ids first: the history holds higher ids, too."""
    rows = titles_of(spark, d)
    landing, out, kept = fresh_path(spark, "landing"), fresh_path(spark, "verdicts"), fresh_path(spark, "recent")
    check = fresh_path(spark, "ck")
    for part in ("id % 2 = 1", "id % 2 = 0"):
        rows.where(part).write.mode("append").parquet(landing)
        stream = jobs.landed(spark, landing, rows.schema, files_per_batch=100_000)
        jobs.recent_verdicts(stream, "id", "title", out, kept, check, OPTIONS, once=True).awaitTermination()
    return spark.read.parquet(out).select("id", _or_none("match_id"), "similarity", "is_duplicate")
