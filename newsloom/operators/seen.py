"""Entries already seen."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls
from ..session import settle, small_side


def keyed(entries: DataFrame, url: str, lang: str, key_from: str = "canonical") -> DataFrame:
    """Add link, feed_host and entry_key; ``key_from`` is ``canonical`` or ``raw``."""
    link = urls.canonical(F.col(url))
    return entries.withColumns({
        "link": link,
        "feed_host": urls.host(F.col(url)),
        "entry_key": urls.entry_key(link if key_from == "canonical" else F.col(url)),
        "lang": F.col(lang),
    })


KEYS = ["lang", "feed_host", "entry_key"]


def _first(entries: DataFrame, order: str) -> DataFrame:
    """First entry per key.  An aggregate, so copies of a hot key are folded before the exchange."""
    rest = [c for c in entries.columns if c not in KEYS and c != order]
    first = entries.groupBy(*KEYS).agg(F.min(F.struct(order, *rest)).alias("_first"))
    return first.select(*KEYS, f"_first.{order}", *[f"_first.{c}" for c in rest])


def unseen(entries: DataFrame, seen: DataFrame, order: str) -> DataFrame:
    """First entry per key that is not in ``seen``; the anti join meets each key once."""
    return _first(entries, order).join(seen.select(*KEYS).distinct(), KEYS, "left_anti")


# Sources of a run that are written into the filter of the store's folders.
NAMED_SOURCES = 2_000
# Bits of a key filter per key, and in all: a filter is at most 16 MB.
KEY_BITS, MOST_BITS = 16, 1 << 27


def unseen_in_store(entries: DataFrame, store: DataFrame, order: str, named_sources: int = NAMED_SOURCES,
                    most_bits: int = MOST_BITS) -> DataFrame:
    """``unseen`` against a large store of keys that is partitioned by (lang, feed_host).

    Exact, without reading or moving the whole store: only the folders of the sources
    that the run has are read, and of their keys only those pass that a bitmap of the
    run's keys lets through, whose size is bounded.  What passes is joined exactly.
    """
    first = settle(_first(entries, order))
    sources = first.select("lang", "feed_host").distinct().limit(named_sources + 1).collect()
    if len(sources) <= named_sources:
        store = store.where(_of_sources({(r["lang"], r["feed_host"]) for r in sources}))
    held = store.select(*KEYS).where(F.col("entry_key").isNotNull())
    keys = max(first.count(), 1)
    size = min(most_bits, max(1 << 15, 1 << (keys * KEY_BITS - 1).bit_length()))
    return first.join(_maybe_in(held, first, size).distinct(), KEYS, "left_anti")


def _of_sources(sources: set[tuple[str | None, str | None]]) -> Column:
    """A condition on the folder columns alone, so that other folders are never listed."""
    hosts: dict[str, list[str]] = {}
    for lang, host in sources:
        if lang is not None and host is not None:
            hosts.setdefault(lang, []).append(host)
    parts = [(F.col("lang") == lang) & F.col("feed_host").isin(sorted(names)) for lang, names in sorted(hosts.items())]
    return reduce(lambda a, b: a | b, parts, F.lit(False))


def _maybe_in(rows: DataFrame, keys: DataFrame, size: int) -> DataFrame:
    """Rows whose key may be one of ``keys``: one bit per hashed key, in pieces of 32,768 bits.

    At most size / 32,768 pieces are broadcast, whatever the number of keys.
    """
    place = F.pmod(F.xxhash64(*KEYS), F.lit(size)) + 1
    bits = keys.select(F.bitmap_bucket_number(place).alias("_bucket"), F.bitmap_bit_position(place).alias("_bit"))
    pieces = bits.groupBy("_bucket").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    asked = rows.select("*", F.bitmap_bucket_number(place).alias("_bucket"), F.bitmap_bit_position(place).cast("int").alias("_bit"))
    octet = F.conv(F.hex(F.substring("_bits", F.shiftright("_bit", 3) + 1, F.lit(1))), 16, 10).cast("int")
    mask = F.element_at(F.array(*[F.lit(1 << k) for k in range(8)]), F.col("_bit") % 8 + 1)
    found = asked.join(F.broadcast(pieces), "_bucket").where(octet.bitwiseAND(mask) != 0)
    return found.select(*rows.columns)


def publish_eligible(entries: DataFrame, seen: DataFrame, source: list[str]) -> DataFrame:
    """Add ``publish_ok``: false for sources met for the first time.

    Sources are few; their list is broadcast once counted, and past that bound
    the join is shuffled and a hot source split by the adaptive skew join.
    """
    known = seen.select(*source).distinct().withColumn("_known", F.lit(True))
    return (entries.join(small_side(known), source, "left")
            .withColumn("publish_ok", F.coalesce("_known", F.lit(False))).drop("_known"))
