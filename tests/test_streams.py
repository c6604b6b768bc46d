"""State of streams against plain versions, and batches that are done again."""

from collections import Counter, defaultdict

from pyspark.sql import functions as F

from newsloom.plans import watcher
from newsloom.streaming import jobs

COUNTED = ("id long, day string, accepted boolean, is_duplicate boolean, nbwords int, nbtags int, all_tags array<string>")


def test_registers_go_on_where_the_last_batch_ended(spark, tmp_path):
    landing, out, check = (str(tmp_path / x) for x in ("landing", "out", "ck"))
    batches = [[(i, "hot" if i % 3 else f"s{i % 5}", f"Title {i}") for i in range(9, 400, 2)],
               [(i, "hot" if i % 3 else f"s{i % 5}", None if i == 30 else f"TITLE {i}") for i in range(0, 400, 2)],
               [(1000, "late", "Only"), (1001, None, "No source"), (1002, "hot", "Last"), (1002, "hot", "Last")]]
    line, want = defaultdict(list), []
    for rows in batches:
        df = spark.createDataFrame(rows, "id long, source string, title string")
        df.coalesce(1).write.mode("append").parquet(landing)
        stream = jobs.landed(spark, landing, df.schema, files_per_batch=100)
        jobs.recent_windows(stream, "source", "id", "title", 3, out, check, once=True).awaitTermination()
        for i, source, title in sorted(rows, key=lambda r: r[0]):
            line[source].append(title and title.lower())
            want += [(source, i, k, t) for k, t in enumerate(line[source][::-1][:4])]
    got = [tuple(r) for r in spark.read.parquet(out).select("source", "id", "slot", "text").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def plain_figures(rows):
    days = defaultdict(lambda: [0] * 6)
    uses, first = defaultdict(Counter), {}
    for i, day, ok, dup, words, tags, names in rows:
        d = days[day]
        d[0] += 1
        d[1 if ok else 2] += 1
        d[3] += dup
        if ok:
            d[4] += words
            d[5] += tags
            for pos, t in enumerate(names):
                uses[day][t] += 1
                first[day, t] = min(first.get((day, t), (i, pos)), (i, pos))
    top = lambda d: sorted(uses[d], key=lambda t: (-uses[d][t], first[d, t]))[:3] or None
    return {d: (*v, top(d)) for d, v in days.items()}


def test_day_figures_add_up_and_batches_may_come_again(spark, tmp_path):
    path = str(tmp_path / "figures")
    rows = [(i, f"2024-01-0{1 + i * 7 % 4}", i % 4 > 0, i % 4 == 0, i % 9, 2, [f"t{i % 5}", f"t{i % 3}"]) for i in range(90)]
    rows += [(200, "2024-01-09", False, True, None, None, None)]
    figures = lambda: {r.day: (r.total, r.twitted, r.filtered, r.duplicates, r.nbwords, r.nbtags, r.top_trend)
                       for r in watcher.day_figures(spark, path).collect()}
    add = lambda some, n: watcher.add_day_parts(spark.createDataFrame(some, COUNTED), path, n, 3)
    add(rows[:40], 0)
    assert figures() == plain_figures(rows[:40])
    add(rows[40:], 1)
    add(rows[40:], 1)
    assert figures() == plain_figures(rows)
    add([r for r in rows[:40] if r[1] == "2024-01-01"], 0)  # the same sums of one of its days
    assert figures() == plain_figures(rows)
    add([], 2)
    add([(300, None, True, False, 1, 0, [])], 3)
    assert {d: v for d, v in figures().items() if d} == plain_figures(rows)


def test_counters_of_a_replayed_batch(spark, tmp_path):
    """The second batch is judged against what the first one stored, however often it runs."""
    from checks import fixtures

    kinds = "id long, service string, lang string, title string, link string, published timestamp, text string"
    titles = ["storm closes northern harbour", "bakers win bread prize", "river floods old market", "quiet sunday in town"]
    row = lambda i, t: (i, f"src{i % 3}", "en", t, f"https://x.example/{i}", None, "words and more words")
    at = F.to_timestamp(F.lit("2024-02-03 10:00:00"))
    make = lambda rows: spark.createDataFrame(rows, kinds).withColumn("published", at)
    table = spark.createDataFrame(fixtures.document_rules()[:0], fixtures.DOCUMENT_RULE_TYPE)
    step = jobs.figures_of(table, str(tmp_path / "f"), str(tmp_path / "t"))
    step(make([row(i, t) for i, t in enumerate(titles)]), 0)
    for _ in range(2):
        step(make([row(10, titles[1]), row(11, "harbour closes in northern storm"), row(12, "new bridge opens")]), 1)
        got = watcher.day_figures(spark, str(tmp_path / "f")).first()
        assert (got.day, got.total, got.twitted, got.filtered, got.duplicates) == ("2024-02-03", 7, 5, 2, 2)


def test_bounded_dedup_counts_late_rows(spark, tmp_path):
    landing, out, check = (str(tmp_path / x) for x in ("landing", "out", "ck"))
    day = lambda n: f"2024-05-{n:02}"
    late = 0
    for n, rows in enumerate([[(1, "a", 1), (2, "a", 1), (3, "b", 1)], [(4, "a", 2)], [(5, "c", 20)], [(6, "a", 21), (7, "b", 3)]]):
        df = spark.createDataFrame([(i, f"https://h.example/{k}", "en", day(d)) for i, k, d in rows],
                                   "id long, url string, lang string, at string").withColumn("at", F.col("at").cast("timestamp"))
        df.coalesce(1).write.mode("append").parquet(landing)
        query = jobs.first_entries(jobs.landed(spark, landing, df.schema, 100), "url", "lang", out, check, once=True,
                                   event_time="at", keep_for="3 days")
        query.awaitTermination()
        late += jobs.late_rows(query)
    got = Counter((r.entry_key, str(r.at)[:10]) for r in spark.read.parquet(out).collect())
    assert got == {("a.txt", day(1)): 1, ("b.txt", day(1)): 1, ("c.txt", day(20)): 1, ("a.txt", day(21)): 1}
    assert late == 1


def test_atom_links(spark, tmp_path):
    from newsloom.sources import feeds

    (tmp_path / "f.xml").write_text("""<feed xmlns="http://www.w3.org/2005/Atom"><title>Feed</title>
<entry><title>One</title><link rel="self" href="https://f/"/><link href="https://a/1"/><published>p</published><updated>u</updated></entry>
<entry><title>Two</title><link rel="enclosure" href="https://e/2"/><updated>u</updated><summary>S &amp; s</summary></entry>
<entry><title>Three</title></entry></feed>""")
    got = {tuple(r) for r in feeds.read_atom_entries(spark, str(tmp_path)).collect()}
    assert got == {("One", "https://a/1", "p", None), ("Two", "https://e/2", "u", "S & s"), ("Three", None, None, None)}


def test_days_are_written_by_all_cores(spark, tmp_path):
    """Many days of few bytes are not left to one task; figures stay whole."""
    from newsloom.plans import watcher

    rows = spark.createDataFrame([(i, f"2024-01-{i % 30 + 1:02}", True, False, 3, ["a", f"t{i % 2}"], 2) for i in range(90)],
                                 "id long, day string, accepted boolean, is_duplicate boolean, nbwords long, all_tags array<string>, nbtags long")
    watcher.add_day_parts(rows, str(tmp_path), 0)
    assert len({f.name[:10] for f in (tmp_path / "counters").rglob("part-*.parquet")}) > 1
    got = watcher.day_figures(spark, str(tmp_path)).collect()
    assert len(got) == 30 and {(r.total, r.nbwords, r.top_trend[0]) for r in got} == {(3, 9, "a")}


def test_days_share_folders(spark, tmp_path):
    """A folder a month, not a day; days of a touched month that a batch does not name stay as they are."""
    make = lambda days: spark.createDataFrame(
        [(k * 10 + i, day, True, False, 3, [f"t{i}"], 2) for k, day in enumerate(days) for i in range(3)],
        "id long, day string, accepted boolean, is_duplicate boolean, nbwords long, all_tags array<string>, nbtags long")
    days = [f"2024-{m:02}-{d:02}" for m in (1, 2, 3) for d in range(1, 28, 2)]
    watcher.add_day_parts(make(days), str(tmp_path), 0)
    for name in ("counters", "uses", "days"):
        assert len(list((tmp_path / name).glob("*=2024-*"))) == 3
    kept = {f: f.stat().st_mtime_ns for f in (tmp_path / "days").glob("*=2024-01/*.parquet")}
    for _ in range(2):
        watcher.add_day_parts(make(["2024-02-03", "2024-02-04"]), str(tmp_path), 1)
        got = {r.day: (r.total, r.nbwords, r.top_trend) for r in watcher.day_figures(spark, str(tmp_path)).collect()}
        assert set(got) == {*days, "2024-02-04"} and got["2024-02-03"][:2] == (6, 18)
        assert all(v == (3, 9, ["t0", "t1", "t2"]) for d, v in got.items() if d != "2024-02-03")
    assert kept and all(f.stat().st_mtime_ns == t for f, t in kept.items())
