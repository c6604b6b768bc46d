"""Per-source rules: joining them to entries, cleaning titles, rejecting entries.

A rule row holds (service, lang, mention, tags, title_patterns, title_blocks,
url_blocks).  Rules are configuration, so they are broadcast after a count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..session import small_side

_WORDS = "array<string>"


def with_rules(entries: DataFrame, rules: DataFrame, keys=("service", "lang")) -> DataFrame:
    """Left join; entries of a source without rules keep null rules."""
    return entries.join(small_side(rules), list(keys), "left")


def known_sources(entries: DataFrame, rules: DataFrame, keys=("service", "lang")) -> DataFrame:
    """Entries of the watched sources only, each with its rules."""
    return entries.join(small_side(rules), list(keys))


def _any_in(rules: Column, value: Column) -> Column:
    rules = F.coalesce(rules, F.array().cast(_WORDS))
    return F.exists(rules, lambda r: F.contains(value, r))


def sanitise_title(title: Column, patterns: Column) -> Column:
    return text.strip_patterns(title, patterns)


def title_blocked(title: Column, blocks: Column) -> Column:
    """A block word occurs in the lower-cased title; case of the rule is ignored."""
    return _any_in(F.transform(blocks, lambda r: F.lower(r)), F.lower(title))


def url_blocked(link: Column, blocks: Column) -> Column:
    return _any_in(blocks, link)


def selected(url: Column, labels: Column, url_rules: Column, label_rules: Column) -> Column:
    """True without rules; else some rule must admit the page.

    A url rule admits by substring; a label rule by an element whose own text
    equals the label.
    """
    urls = F.coalesce(url_rules, F.array().cast(_WORDS))
    wanted = F.coalesce(label_rules, F.array().cast(_WORDS))
    labels = F.coalesce(labels, F.array().cast(_WORDS))
    free = (F.size(urls) == 0) & (F.size(wanted) == 0)
    return free | _any_in(urls, url) | F.arrays_overlap(labels, wanted)


def with_reasons(df: DataFrame, reasons: dict[str, Column]) -> DataFrame:
    """Add ``reasons`` (names that hold, in order) and ``accepted``."""
    named = F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in reasons.items()])
    df = df.withColumn("reasons", F.array_compact(named))
    return df.withColumn("accepted", F.size("reasons") == 0)
