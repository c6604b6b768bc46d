"""The watcher as streams: keyed dedup, recent-window verdicts, day buckets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators import digest, joins, seen, similarity
from ..options import RunOptions
from ..plans import watcher
from ..session import settle
from ..sources import feeds

POLL = "5 minutes"


def _start(writer, checkpoint: str, once: bool) -> StreamingQuery:
    # Keys that never expire do not fit the heap.
    SparkSession.getActiveSession().conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=POLL)).start()


def ingest(stream: DataFrame, url: str, lang: str, out: str, checkpoint: str,
           once: bool = False) -> StreamingQuery:
    """Keyed entries as they land, written with their link, host and key."""
    return _start(seen.keyed(stream, url, lang).writeStream.format("parquet").option("path", out),
                  checkpoint, once)


def first_entries(stream: DataFrame, url: str, lang: str, out: str, checkpoint: str,
                  once: bool = False, event_time: str | None = None,
                  keep_for: str | None = None) -> StreamingQuery:
    """First entry per key.

    State is kept for ever, or, given ``event_time`` and ``keep_for``, only as
    long as a repeat may still come: a key leaves the state when the watermark passes
    the time of its entry plus ``keep_for``, and may then come again as a new one.
    Entries behind the watermark are left out; ``late_rows`` counts them.
    """
    keyed = seen.keyed(stream, url, lang)
    if event_time and keep_for:
        unique = keyed.withWatermark(event_time, keep_for).dropDuplicatesWithinWatermark(seen.KEYS)
    else:
        unique = keyed.dropDuplicates(seen.KEYS)
    return _start(unique.writeStream.format("parquet").option("path", out), checkpoint, once)


def late_rows(query: StreamingQuery) -> int:
    """Rows that came behind the watermark, over the recent batches of a query."""
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])


def entries(spark: SparkSession, out: str, checkpoint: str, rss: str | None = None, atom: str | None = None,
            once: bool = False) -> StreamingQuery:
    """Entries of RSS and Atom files as they land, written as one table."""
    parts = [feeds.read_entries(spark, rss, streaming=True)] if rss else []
    parts += [feeds.read_atom_entries(spark, atom, streaming=True)] if atom else []
    both = parts[0].unionByName(parts[1]) if len(parts) > 1 else parts[0]
    return _start(both.writeStream.format("parquet").option("path", out), checkpoint, once)


def daily_counts(stream: DataFrame, ts: str, out: str, checkpoint: str, late: str = "1 day",
                 once: bool = False) -> StreamingQuery:
    """Rows per day; each batch replaces the days it changed, older days leave the state."""
    counts = (stream.withWatermark(ts, late).groupBy(F.window(ts, "1 day").alias("w"))
              .agg(F.count("*").alias("total"))
              .select(F.to_date("w.start").alias("day"), "total"))

    def replace(batch: DataFrame, _: int) -> None:
        (batch.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("day").parquet(out))

    return _start(counts.writeStream.outputMode("update").foreachBatch(replace), checkpoint, once)


def recent_verdicts(stream: DataFrame, id_: str, title: str, out: str, retained: str, checkpoint: str,
                    options: RunOptions = RunOptions(), once: bool = False) -> StreamingQuery:
    """Near-duplicate verdicts against the retained titles and the batch itself.

    Batch n reads retained version n - 1 and writes version n, so a batch that
    is run again gives the same tables.
    """
    def step(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        new = batch.select(F.col(id_).alias("id"), F.col(title).alias("title"))
        if n > 0:
            history = spark.read.schema(new.schema).parquet(f"{retained}/{n - 1}")
        else:
            history = new.limit(0)
        # History counts as earlier whatever its ids: places in the order of (history, id).
        both = history.withColumn("late", F.lit(0)).unionByName(new.withColumn("late", F.lit(1)))
        corpus = settle(joins.arrival(both, "late", "id"))
        best = similarity.best_earlier(corpus, "place", "title")
        graded = similarity.verdict(best, corpus, "place", "title", options.duplicate_at)
        names = corpus.select(F.col("place").alias("match_id"), F.col("id").alias("_match"))
        graded = graded.join(names, "match_id", "left").drop("match_id").withColumnsRenamed(
            {"id": "place", "_match": "match_id"})
        fresh = corpus.where("late = 1").select("place", "id", "title").join(graded, "place").drop("place")
        fresh.write.mode("overwrite").parquet(f"{out}/batch={n}")
        done = spark.read.schema(fresh.schema).parquet(f"{out}/batch={n}")
        accepted = done.where(~F.col("is_duplicate")).select("id", "title")
        kept = digest.retain(history.unionByName(accepted), "id", options.retained)
        kept.write.mode("overwrite").parquet(f"{retained}/{n}")

    return _start(stream.writeStream.foreachBatch(step), checkpoint, once)


def day_figures(stream: DataFrame, rule_table: DataFrame, out: str, store: str, checkpoint: str,
                options: RunOptions = RunOptions(), once: bool = False) -> StreamingQuery:
    """All six counters and the trend per day of ``published``, kept up to date batch by batch.

    ``stream`` holds articles (id, service, lang, title, link, text, published).  See
    ``figures_of`` for a batch.
    """
    return _start(stream.writeStream.foreachBatch(figures_of(rule_table, out, store, options)), checkpoint, once)


def figures_of(rule_table: DataFrame, out: str, store: str, options: RunOptions = RunOptions()):
    """What a batch of articles does: judged against the retained titles, its sums go into the days it touches.

    Batch n reads version n of the title store and writes version n + 1, and replaces its
    own sums, so a batch that is run again changes nothing.
    """
    def step(batch: DataFrame, n: int) -> None:
        held = settle(batch)
        rows = watcher.counted(held, rule_table, options, store, n + 1)
        watcher.add_day_parts(rows.withColumn("day", F.date_format("published", "yyyy-MM-dd")), out, n)

    return step


class _Recent(StatefulProcessor):
    """The last titles of one source, oldest first, in a list state."""

    def __init__(self, size: int):
        self.size = size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.recent = handle.getListState("recent", "id long, text string")

    def handleInputRows(self, key, rows, timerValues):
        import pandas as pd

        held = [(r[0], r[1]) for r in self.recent.get()]
        new = pd.concat(list(rows)).sort_values("id", kind="stable")
        line = held + list(zip(new["id"].tolist(), new["text"].tolist()))
        block = max(1, 65_536 // (self.size + 1))
        for a in range(len(held), len(line), block):
            at = range(a, min(a + block, len(line)))
            slots = [(line[i][0], k, line[i - k][1]) for i in at for k in range(min(self.size, i) + 1)]
            yield pd.DataFrame(slots, columns=["id", "slot", "text"]).assign(source=key[0])[["source", "id", "slot", "text"]]
        self.recent.put(line[-self.size:])

    def close(self) -> None:
        pass


def recent_windows(stream: DataFrame, source: str, id_: str, title: str, size: int, out: str, checkpoint: str,
                   once: bool = False) -> StreamingQuery:
    """(source, id, slot, text): what the shift register of a source holds after each arrival, slot 0 newest.

    A source keeps its last ``size`` lower-cased titles in the state store, however
    long it has been silent.  Titles of one batch arrive in the order of their ids; a
    task holds the titles of one source and one batch, which the trigger bounds.
    """
    rows = stream.select(F.col(source).alias("source"), F.col(id_).cast("long").alias("id"), F.lower(title).alias("text"))
    windows = rows.groupBy("source").transformWithStateInPandas(
        _Recent(size), "source string, id long, slot int, text string", "Append", "None")
    return _start(windows.writeStream.outputMode("append").format("parquet").option("path", out), checkpoint, once)


def landed(spark: SparkSession, path: str, schema, files_per_batch: int = 1) -> DataFrame:
    """Parquet files of a landing folder, a few per batch."""
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path))
