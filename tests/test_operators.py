import math
import random
from collections import Counter

from pyspark.sql import functions as F

from newsloom.functions import markup
from newsloom.operators import digest, pages, search, seen, summary
from newsloom.operators.summary import lexrank
from newsloom.sinks import stores
from newsloom.sources import feeds
from newsloom.streaming import jobs

HTML = """<html><script>var x="</p>";</script><body><div class="main post big"><p>One &amp; two<p>Read next: no
<div><p>deep</p></div></p></div><div class="pic"><span><img src="/i.png"></span></div>
<ul class="labels"><li>Tech</li><li><b>Science</b></li></ul></body></html>"""


def locator(type_, value, section, attribute=None, name="class"):
    return (type_, name, value, section, attribute)


def test_located(spark):
    rows = [(1, HTML, locator("div", "post", "p"), locator("div", "pic", "img", "src"),
             locator("ul", "labels", "li")),
            (2, HTML, locator("div", "main post big", "p"), locator("div", "nope", "img", "src"),
             locator("ul", "labels", "li", name="id"))]
    df = spark.createDataFrame(rows, f"id long, html string, text_rule {pages.LOCATOR}, "
                                     f"image_rule {pages.LOCATOR}, label_rule {pages.LOCATOR}")
    got = {r.id: r for r in pages.located(df, "html").collect()}
    assert [p.strip() for p in got[1].paragraphs] == ["One & two", "Read next: no", "deep"]
    assert got[1].image == "/i.png" and got[1].labels == ["Tech"]
    assert got[2].paragraphs == got[1].paragraphs and got[2].image is None and got[2].labels is None
    text = pages.located(df, "html").select(
        pages.formatted_text(F.col("paragraphs"), ["Read next:"]).alias("t")).first().t
    assert text == "<p>One & two</p><p>deep</p>"


def test_fixed_and_row_rules_agree(spark):
    html = "<article><h1>t</h1><p>a <b>b</b><p>c&quot;<br>d</p></article><nav><a href='x'>L</a></nav>"
    df = spark.createDataFrame([(1, html)], "id long, html string")
    native = pages.native_sections(df, "html", "article", "p", "ps").first().ps
    ruled = df.withColumn("text_rule", F.struct(
        F.lit("article").alias("type"), F.lit("class").alias("name"), F.lit(None).cast("string").alias("value"),
        F.lit("p").alias("section"), F.lit(None).cast("string").alias("attribute")))
    assert pages.located(ruled, "html").first().paragraphs == native == ["a b", 'c"d']


def test_container_ends_at_its_own_end_tag(spark):
    html = "<div class='a'>x<div>y</div><div class=\"b c\"><DIV>z</DIV> w</div>v</div>u<div class='d'>open"
    df = spark.createDataFrame([(html,)], "html string")
    read = lambda class_: df.select(markup.container(F.col("html"), "div", class_)).first()[0]
    assert read(None) == read("a") == "x<div>y</div><div class=\"b c\"><DIV>z</DIV> w</div>v"
    assert read("c") == "<DIV>z</DIV> w" and read("d") is None and read("e") is None


def test_page_blocks_name_elements_by_tag_and_class(spark):
    df = spark.createDataFrame(
        [(HTML, [("div", "pic", "x"), ("ul", "labels", "SCIENCE")], [("p", "main")],
          [("ul", "labels", "li", "Tech"), ("ul", "labels", "li", "Science")]),
         (HTML, [("div", "pic", "x")], [("div", "main")], None), (None, None, None, None)],
        "html string, c array<struct<tag:string,class:string,text:string>>, e array<struct<tag:string,class:string>>, "
        "s array<struct<tag:string,class:string,section:string,text:string>>")
    html = F.col("html")
    got = df.select(pages.content_rejected(html, F.col("c")).alias("c"), pages.element_rejected(html, F.col("e")).alias("e"),
                    pages.selection_labels(html, F.col("s")).alias("s")).collect()
    assert [tuple(r) for r in got] == [(True, False, ["Tech"]), (False, True, None), (False, False, None)]


def test_unseen_keeps_the_first_of_each_key(spark):
    rows = spark.createDataFrame([(3, "http://h/a?x", "fr"), (1, "http://h/a?y", "fr"), (2, "http://h/b", "fr")],
                                 "id long, url string, lang string")
    keyed = seen.keyed(rows, "url", "lang")
    known = keyed.where("id = 2")
    assert [r.id for r in seen.unseen(keyed, known, "id").collect()] == [1]


def test_tag_trend_and_top_tags(spark):
    df = spark.createDataFrame([("d", 1, ["b", "a"]), ("d", 2, ["a", "c"]), ("d", 3, ["b"])],
                               "day string, id long, tags array<string>")
    got = digest.tag_trend(df, "day", "id", 2).orderBy("rank").collect()
    assert [(r.tag, r.uses) for r in got] == [("b", 2), ("a", 2)]
    texts = spark.createDataFrame([(1, "Robot robot the Robot drone drone idea")], "id long, t string")
    assert digest.top_tags(texts, "id", "t", 2).first().tags == ["robot", "drone"]


def test_merge_stats_adds_runs(spark):
    cols = "day string, total long, twitted long, filtered long, duplicates long, nbwords long, nbtags long"
    a = spark.createDataFrame([("d", 2, 1, 1, 0, 10, 3)], cols)
    assert tuple(digest.merge_stats(a, a, "day").first()) == ("d", 4, 2, 2, 0, 20, 6)


def test_more_like_this_matches_plain_scoring(spark):
    docs = [(i, f"common w{i % 5} w{i % 7} tail{i}") for i in range(40)]
    corpus = spark.createDataFrame(docs, "id long, body string")
    asked = spark.createDataFrame([(1, "common w3 w5 nothing"), (2, "unknown")], "query_id long, body string")
    a = search.more_like_this(corpus, asked, min_tf=1, min_doc_freq=2, should_match=0.6, salt_rows=3)
    got = {r.query_id: r for r in a.collect()}
    assert got[1].found and got[1].match_id in {i for i in range(40) if i % 5 == 3 and i % 7 == 5}
    assert not got[2].found and got[2].score is None


def test_more_like_this_scores_in_tiles(spark, monkeypatch):
    """Slices, blocks of queries and steps of a tile give what plain scoring gives; ties go to the smaller id."""
    rng = random.Random(5)
    body = lambda n: " ".join(f"w{min(rng.randrange(60), rng.randrange(60))}" for _ in range(n))
    docs = [(2**53 + i, body(rng.randrange(0, 40))) for i in range(150)]
    docs += [(2**53 + 500 + i, docs[i][1]) for i in range(60)] + [(7, None), (None, "w1 w2")]
    asked = [(q, body(12)) for q in range(30)] + [(99, "zzz")]
    monkeypatch.setattr(search, "TILE_QUERIES", 8)
    monkeypatch.setattr(search, "PRODUCTS", 50)
    got = {r.query_id: r for r in search.more_like_this(
        spark.createDataFrame(docs, "id long, body string"), spark.createDataFrame(asked, "query_id long, body string"),
        min_tf=1, max_terms=9, min_doc_freq=3, salt_rows=40).collect()}
    cut = [(i, t.split()) for i, t in docs if t is not None]
    df = Counter(w for i, t in cut if i is not None for w in set(t))
    avg = sum(len(t) for _, t in cut) / len(docs)
    for q, t in asked:
        idf = {w: math.log(1 + (len(docs) - df[w] + 0.5) / (df[w] + 0.5)) for w in t.split() if df[w] >= 3}
        best = sorted(idf, key=lambda w: (-round(t.split().count(w) * idf[w], 9), w))[:9]
        need, scored = max(int(len(best) * 0.3 + 1e-9), 1), []
        for i, words in cut:
            tf = [(w, words.count(w)) for w in best if w in words]
            if i is not None and len(tf) >= need:
                norm = 1.2 * (0.25 + 0.75 * len(words) / avg)
                scored.append((-round(sum(idf[w] * n * 2.2 / (n + norm) for w, n in tf), 9), i))
        assert got[q].found == bool(scored)
        if scored:
            assert (got[q].match_id, round(got[q].score, 6)) == (min(scored)[1], round(-min(scored)[0], 6))


def test_words_of_one_stem_get_one_number(spark, monkeypatch):
    """Words are stemmed once for all texts, frequent ones answered apart; texts of one id stay apart."""
    rows = [(t, s, f, w) for t in range(4) for s in range(3) for f, w in (
        (False, "meet"), (False, "meets"), (True, "continue"), (True, "continuer"), (False, f"robot{'s' * (t % 2)}"))]
    words = spark.createDataFrame(rows, "_t long, s int, french boolean, token string")
    for hot in (1, 4, 50_000):
        monkeypatch.setattr(summary, "BROADCAST_ROWS", hot)
        got = summary._numbered(words).collect()
        assert len(got) == len(rows) and len({r.no for r in got}) == 3
        per = Counter((r._t, r.s, r.no) for r in got)
        assert sorted(per.values()) == [1] * 12 + [2] * 24
    twice = spark.createDataFrame([(1, "Apples meet pears. Robots sing."), (1, "Robots sing. Robots sing.")], "id long, t string")
    assert summary.summarise(twice, "id", "t", 1).count() == 2


def test_article_files_come_back_whole(spark, tmp_path):
    """One file per article right below its source, whatever its name holds; equal names lose nothing."""
    rows = [("src", "1", "a\nb\n"), ("src", "2", ""), ("s/x", "a.gz", "é\u0003"), ("_s", "_1", "x"), (".s", "..", "y"),
            (None, "n", "z"), ("e", None, "w"), ("e", "", "v"), ("p", "100% +~2", "q"), ("src", "1", "other"), ("src", "1", "other"),
            ("src", "3", "\n"), ("src", "4", None), ("src", "4", ""), ("src", "4", "t")]
    df = spark.createDataFrame(rows, "source string, title string, content string")
    for _ in range(2):
        stores.write_article_files(df, f"file://{tmp_path}/f")
    files = [f for f in (tmp_path / "f").rglob("*") if f.is_file()]
    assert len(files) == len(rows) and {len(f.relative_to(tmp_path / "f").parts) for f in files} == {2}
    got = [tuple(r) for r in feeds.read_article_files(spark, f"file://{tmp_path}/f", encoded=True).collect()]
    assert sorted(got, key=repr) == sorted(rows, key=repr)


def test_updates_and_fields(spark):
    index = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id long, title string, note string")
    new = spark.createDataFrame([(2, "z")], "id long, note string")
    assert sorted(tuple(r) for r in search.update_fields(index, new, "id", ["note"]).collect()) == [
        (1, "a", "x"), (2, "b", "z")]
    assert search.field_by_id(index, "id", 9, "title").first().value == ""


def test_lexrank_prefers_the_shared_sentence():
    # Sentences 0 and 1 share words, 2 stands alone; blocks do not change the answer.
    rows, terms, tfs = [0, 0, 1, 1, 2, 3], ["a", "b", "a", "b", "c", "d"], [1.0] * 6
    assert lexrank(4, rows, terms, tfs) == lexrank(4, rows, terms, tfs, products=1)
    assert lexrank(2, None, None, None) == [0.5, 0.5]


def test_summary_takes_the_hub_and_keeps_text_order(spark):
    # "Apples meet pears" shares a word with two sentences that share none with
    # each other; one step from 1/8 each gives it (1/3 + 1/2 + 1/2) / 8, its two
    # neighbours (1/3 + 1/2) / 8 and every lone sentence 1/8.  So the hub is
    # first and the earliest lone sentence second.
    body = ("Apples glow. Pears shrink. Apples meet pears. Robots sing. Clouds drift. Rivers bend. "
            "Mountains crack. Engines hum.")
    df = spark.createDataFrame([(1, body)], "id long, t string")
    assert summary.summarise(df, "id", "t", 1).first().summary == "Apples meet pears."
    assert summary.summarise(df, "id", "t", 2).first().summary == "Apples meet pears.Robots sing."


def test_stores_round_trip(spark, tmp_path):
    missing = feeds.read_feed_store(spark, str(tmp_path / "none"))
    assert missing.count() == 0 and "similarity" in missing.columns
    (tmp_path / "20240105.json").write_text(
        '{"1": [{"title": "a", "date": "Tue, 02 Jan 2024 09:30:05 +0000", "tags": ["x"]}],'
        ' "2": [{"title": "b", "date": "2024-01-02T08:45:10+02:00"}],'
        ' "statistics": [{"total": 3, "twitted": 2, "top_trend": ["x"]}]}')
    rows, stats = feeds.read_daily_store(spark, str(tmp_path / "*.json"))
    dated = rows.withColumn("ts", feeds.parse_date("date")).orderBy("id").collect()
    assert [str(r.ts) for r in dated] == ["2024-01-02 09:30:05", "2024-01-02 06:45:10"]
    assert stats.first().total == 3 and str(stats.first().day) == "2024-01-05"


def test_a_large_store_is_cut_into_objects(spark, tmp_path):
    rows = spark.range(30).select("id", F.lit("day").alias("store"), F.concat(F.lit("t"), "id").alias("title"))
    stores.write_feed_store(rows, str(tmp_path / "s"), per_object=4)
    back = feeds.read_feed_store(spark, str(tmp_path / "s" / "*"))
    assert {(int(r.id), r.title) for r in back.collect()} == {(i, f"t{i}") for i in range(30)}
    assert len(list((tmp_path / "s" / "store=day").glob("*.txt"))) > 4


def test_rules_and_aliases_from_xml(spark, tmp_path):
    (tmp_path / "s.xml").write_text(
        '<data><service name="N" lang="fr"><url>http://f/</url><text type="div" name="class" section="p">body</text>'
        '<sanitize><remove type="title">\\[.*?\\] </remove></sanitize><filters><filter type="title">promo</filter>'
        '<filter type="url">job</filter></filters><selection><select type="url">/tech</select></selection>'
        '</service></data>')
    r = feeds.flatten_rules(feeds.read_rules(spark, str(tmp_path / "s.xml"))).first()
    assert r.title_patterns == ["\\[.*?\\] "] and r.title_blocks == ["promo"] and r.url_blocks == ["job"]
    assert r.url_selects == ["/tech"] and r.text_rule.value == "body" and r.image_rule is None
    (tmp_path / "h.xml").write_text(
        '<data><hashtags><tag value="harbour">port, docks</tag><tag value="walrus"/></hashtags>'
        '<simplify><tag value="uk">united kingdom</tag></simplify></data>')
    rows = sorted(((x.kind, x.canonical, x.alias or "") for x in
                   feeds.read_tag_aliases(spark, str(tmp_path / "h.xml")).collect()))
    assert rows == [("hashtags", "harbour", "docks"), ("hashtags", "harbour", "port"), ("hashtags", "walrus", ""),
                    ("simplify", "uk", "united kingdom")]


def test_index_append_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "index")
    stores.create_index(spark, path)
    docs = spark.createDataFrame([("a", "t")], "id string, title string")
    stores.append_index(docs, path)
    stores.append_index(docs, path)
    assert stores.read_index(spark, path).count() == 1


def test_streams_equal_batches(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"http://h{i % 2}/p{i % 5}?q={i}", "en", f"title about thing{i % 3}")
                                  for i in range(20)], "id long, url string, code string, title string")
    land = str(tmp_path / "land")
    rows.repartition(3).write.parquet(land)
    stream = lambda: jobs.landed(spark, land, rows.schema)
    jobs.first_entries(stream(), "url", "code", str(tmp_path / "o"), str(tmp_path / "c"), once=True).awaitTermination()
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "o")).select(*seen.KEYS).collect()}
    batch = seen.keyed(rows, "url", "code").select(*seen.KEYS).distinct().collect()
    assert got == {tuple(r) for r in batch}
    jobs.recent_verdicts(stream(), "id", "title", str(tmp_path / "v"), str(tmp_path / "r"), str(tmp_path / "c2"),
                         once=True).awaitTermination()
    verdicts = spark.read.parquet(str(tmp_path / "v"))
    assert verdicts.count() == 20 and verdicts.where("not is_duplicate").count() >= 1


def test_unseen_in_a_store_of_folders(spark, tmp_path):
    """Same rows as the plain anti join; only the folders of the run's sources are read."""
    from newsloom.operators import seen
    from newsloom.sinks import stores

    path = str(tmp_path / "store")
    held = [(lang, f"h{k % 30}.example", f"e{k}.txt", "text") for k in range(900) for lang in ("en", "fr")]
    (spark.createDataFrame(held, "lang string, feed_host string, entry_key string, text string")
     .write.partitionBy("lang", "feed_host").parquet(path))
    run = [(i, "en" if i % 2 else "fr", f"h{i % 7}.example", f"e{i % 1500}.txt") for i in range(2000)]
    run += [(5000, None, "h1.example", "e1.txt"), (5001, "en", None, "e1.txt"), (5002, "en", "new.example", "e1.txt"), (5003, "en", "h1.example", None)]
    entries = spark.createDataFrame(run, "id long, lang string, feed_host string, entry_key string")
    store = stores.seen_keys(spark, path)
    want = sorted(map(tuple, seen.unseen(entries, store, "id").collect()), key=str)
    assert 0 < len(want) < len({r[1:] for r in run})
    for named, bits in ((2000, 1 << 27), (3, 1 << 15), (2000, 1 << 15)):
        got = seen.unseen_in_store(entries, store, "id", named, bits)
        assert sorted(map(tuple, got.collect()), key=str) == want
    plan = seen.unseen_in_store(entries.where("id < 2000"), store, "id")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "h6.example" in plan and "h8.example" not in plan
    assert seen.unseen_in_store(entries.limit(0), store, "id").count() == 0


def test_words_of_a_text_are_worked_out_once(spark):
    """A filter on the found words must not bring their work into the plan a second time."""
    docs = spark.createDataFrame([(1, "Harbour bridge harbour. The old bridge")], "doc_id long, text string")
    for found in (digest.top_tags(docs, "doc_id", "text", 3), digest.main_words(docs, "doc_id", "text")):
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        filters = [line for line in plan.splitlines() if "Filter" in line]
        assert not any("regexp_" in line for line in filters)


def test_feed_store_is_cut_by_its_own_size(spark, tmp_path):
    """Many small stores are one object each, a large one several; all rows come back."""
    rows = [(i, f"s{i % 30}" if i < 300 else "hot", "src") for i in range(400)]
    df = spark.createDataFrame(rows, "id long, store string, service string")
    stores.write_feed_store(df, str(tmp_path / "s"), per_object=25)
    files = lambda name: list((tmp_path / "s" / f"store={name}").glob("part-*"))
    assert all(len(files(f"s{k}")) == 1 for k in range(30)) and 2 <= len(files("hot")) <= 4
    back = feeds.read_feed_store(spark, str(tmp_path / "s" / "*"))
    assert sorted(int(r.id) for r in back.collect()) == list(range(400))


def test_spellings_are_folded_before_one_count(spark):
    """One sort for the words of a text and one for their ranks, with the tags of two counts."""
    docs = spark.createDataFrame([(1, "Café cafe CAFÉ the The robot ' robot drone Robot"), (2, "the ..."), (3, None)], "id long, t string")
    found = digest.top_tags(docs, "id", "t", 3)
    assert [(r.id, r.tags) for r in found.collect()] == [(1, ["cafe", "robot", "drone"])]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("sort_array") == 2


def test_stores_of_days_are_written_by_all_cores_and_listed_once(spark, tmp_path, monkeypatch):
    """A folder a day: small days are dealt to several tasks, and a reader lists them once."""
    rows = [(i, f"202403{i % 30 + 1:02}", "src") for i in range(90)]
    df = spark.createDataFrame(rows, "id long, store string, service string")
    counters = df.groupBy("store").agg(*[F.count("*").alias(c) for c in ("total", "twitted", "filtered", "duplicates", "nbwords", "nbtags")])
    counters = counters.withColumn("top_trend", F.array(F.lit("a")))
    stores.write_daily_store(df, counters, str(tmp_path / "s"))
    parts = {}
    for f in (tmp_path / "s").rglob("part-*.txt"):
        parts.setdefault("statistics" in f.read_text(), set()).add(f.name[:10])
    assert len(parts[True]) > 1 and len(parts[False]) > 1
    listed, whole = [], feeds._whole_files
    monkeypatch.setattr(feeds, "_whole_files", lambda *a: listed.append(a) or whole(*a))
    stored, told = feeds.read_daily_store(spark, str(tmp_path / "s" / "*"))
    assert len(listed) == 1 and sorted(int(r.id) for r in stored.collect()) == list(range(90))
    assert {(str(r.day), r.total) for r in told.collect()} == {(f"2024-03-{k:02}", 3) for k in range(1, 31)}


def test_article_files_are_listed_by_tasks(spark, tmp_path, monkeypatch):
    """The names of the files stay in the tasks, whose batches are bounded; hidden and empty files give no row."""
    path = f"file://{tmp_path}/f"
    rows = [(f"s {i % 3}", f"t%{i}/x", "é" * (i % 50 + 1)) for i in range(120)]
    stores.write_article_files(spark.createDataFrame(rows, "source string, title string, content string"), path)
    for name in (".part", "_SUCCESS", "none"):
        (tmp_path / "f" / "s%200" / name).write_text("" if name == "none" else "x")
    (tmp_path / "f" / "s%200" / "bad").write_bytes(b"\xff\xfea")
    monkeypatch.setattr(feeds, "READ_BYTES", 40)
    got = feeds.read_article_files(spark, path, encoded=True)
    assert got.inputFiles() == []
    found = {(r.source, r.title): r.content for r in got.where("title <> 'bad'").collect()}
    assert found == {(s, t): c for s, t, c in rows}
    assert bytes(got.where("title = 'bad'").selectExpr("cast(content as binary) c").first().c) == b"\xff\xfea"
