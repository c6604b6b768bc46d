from pyspark.sql import functions as F

from newsloom.functions import lexicon, stems, text, urls
from newsloom.operators import digest, rules


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "v string").select(fn(F.col("v")).alias("r")).first().r


def test_canonical_cuts_at_the_last_marks_and_is_idempotent(spark):
    for url, want in [("http://a.b/c?x=1", "http://a.b/c"), ("http://a.b/c?x?y", "http://a.b/c?x"),
                      ("http://a.b/c#t", "http://a.b/c"), ("http://a.b/c?x#t", "http://a.b/c")]:
        assert one(spark, url, urls.canonical) == want
    again = one(spark, "http://a.b/c", lambda c: urls.canonical(urls.canonical(c)))
    assert again == "http://a.b/c"


def test_entry_key(spark):
    assert one(spark, "http://a.b/2017/04/x/", urls.entry_key) == "2017-04-x.txt"


def test_absolutise(spark):
    page = F.lit("https://h.org:8080/p/q?x")
    for img, want in [("data:abc", None), ("", None), ("//c.d/i.png", "https://c.d/i.png"),
                      ("/i.png", "https://h.org:8080/i.png"), ("http://x/i", "http://x/i")]:
        assert one(spark, img, lambda c: urls.absolutise(page, c)) == want


def test_tokens_keep_adjacent_marks_together(spark):
    assert one(spark, "l'été ». fin_x 3", text.tokens) == ["l", "'", "été", "».", "fin_x", "3"]


def test_word_count_knows_the_no_break_space(spark):
    assert one(spark, " un mot  ici\n", text.word_count) == 3


def test_fold(spark):
    assert one(spark, "É-cole_Œuvre!", text.fold) == "ecoleoeuvre"


def test_sanitise_paragraph(spark):
    assert one(spark, "ok adsbygoogle", lambda c: text.sanitise_paragraph(c, ["adsbygoogle"])) == ""
    assert one(spark, "a\\rb", lambda c: text.sanitise_paragraph(c, ["zz"])) == "ab"


def test_language(spark):
    def lang(body):
        df = spark.createDataFrame([(body,)], "t string")
        from newsloom.operators.vectors import with_language
        return with_language(df, "t").first().language

    assert lang("the cat is on the table") == "english"
    assert lang("le chat est sur la table") == "french"
    assert lang("xyzzy 42") is None


def test_stop_words_cover_both_languages_for_others(spark):
    assert set(lexicon.stop_words("french")) <= set(lexicon.stop_words(None))
    assert "mm" in lexicon.stop_words(None) and "mm" not in lexicon.stop_words("english")


def test_stems(spark):
    cases = [("consistency", "english", "consist"), ("hopping", "english", "hop"), ("hoping", "english", "hope"),
             ("skies", "english", "sky"), ("generally", "english", "general"), ("by", "english", "by"),
             ("continuation", "french", "continu"), ("majestueusement", "french", "majestu"),
             ("chevaux", "french", "cheval"), ("évidemment", "french", "évident"), ("nations", "german", "nation")]
    df = spark.createDataFrame(cases, "w string, l string, want string")
    for r in stems.with_stem(df, "w", "l").collect():
        assert r.stem == r.want, r


def test_title_rules(spark):
    df = spark.createDataFrame([("<new> Harvest fair (part 2) opens", ["<new> ", "\\(part \\d+\\) "], ["HARVEST"]), ("t", None, None)],
                               "t string, p array<string>, b array<string>")
    got = df.select(rules.sanitise_title(F.col("t"), F.col("p")).alias("t"),
                    rules.title_blocked(F.col("t"), F.col("b")).alias("b")).collect()
    assert [tuple(r) for r in got] == [("Harvest fair opens", True), ("t", False)]


def test_selection(spark):
    df = spark.createDataFrame([
        ("http://a/tech/1", [], None, None, True), ("http://a/tech/1", [], ["/tech"], None, True),
        ("http://a/x", ["Tech"], ["/tech"], ["Tech"], True), ("http://a/x", ["Technology"], None, ["Tech"], False),
    ], "u string, l array<string>, us array<string>, ls array<string>, want boolean")
    for r in df.withColumn("got", rules.selected(F.col("u"), F.col("l"), F.col("us"), F.col("ls"))).collect():
        assert r.got == r.want, r


def test_short_post(spark):
    post = lambda c: digest.short_post(c, F.lit("http://l"), F.lit("#m"), 140, 24)
    assert one(spark, "t", post) == "t http://l #m"
    long = "x" * 200
    assert one(spark, long, post) == "x" * 115 + " http://l"
    assert one(spark, "y" * 116, post) == "y" * 115 + " http://l"


def test_entry_content_without_similarity(spark):
    got = spark.range(1).select(digest.entry_content(
        F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit("body"), F.array(F.lit("a"), F.lit("b")),
        F.lit(None).cast("double"), F.lit(None).cast("string")).alias("c")).first().c
    assert got == "<p>body</p><p>Tags :['a', 'b']</p><p>Similarity of 0.0 with </p>"


SOUP = ("<html><article class='x  y'><p>one <b>two</b> a < b</p><p>three<br>four<div id='d'>not</div>after</article>"
        "<p>out</p><!-- <p>no</p> --><A HREF='/q&amp;r' href='second'>Link <i>it</i></A></html>")


def test_parsed_page_counts_along_each_name(spark):
    from newsloom.functions import markup

    page = spark.createDataFrame([(SOUP,), (None,), ("",), ("no tags",)], "html string").select(
        markup.parsed(F.col("html")).alias("page"))
    rows = page.select("page.elements").collect()
    found = [(e.tag, e.classes, e.start, e.stop, e.depth, e.text) for e in rows[0].elements]
    assert found == [
        ("html", [], 0, 17, 0, ""), ("article", ["x", "y"], 1, 10, 1, ""), ("p", [], 2, 5, 2, "one "), ("b", [], 3, 4, 3, "two"),
        ("p", [], 6, None, 2, "three"), ("br", [], 7, None, 2, "four"), ("div", [], 8, 9, 2, "not"),
        ("p", [], 11, 12, 1, "out"), ("a", [], 13, 16, 1, "Link "), ("i", [], 14, 15, 2, "it")]
    assert [list(r.elements or []) for r in rows[1:]] == [[], [], []]
    p = F.col("page")
    got = page.limit(1).select(
        F.transform(markup.find_all(p, "ARTICLE", "y"), lambda e: markup.element_text(p, e)).alias("article"),
        F.size(markup.find_all(p, "article", "z")).alias("none"),
        F.transform(markup.find_all(p, "a"), lambda e: markup.attribute(e, "href")).alias("href"),
        F.transform(markup.find_all(p, "a"), lambda e: markup.element_markup(p, e)).alias("inner")).first()
    assert got.article == ["one two a < bthreefournotafter"] and got.none == 0
    assert got.href == ["/q&r"] and got.inner == ["Link <i>it</i>"]


def test_pages_with_very_many_tags(spark):
    """Patterns that recurse once per tag end the process from about 500 tags on."""
    from newsloom.functions import markup
    from newsloom.operators import pages

    many = "<b>w</b> " * 100_000
    rows = [(0, f"<article><p>{many}</p></article>"), (1, f"<article><p>{'x' * 5_000_000}</p></article>"),
            (2, "<article>" + "<p>k <i>l</i></p>" * 30_000 + "</article>"), (3, f"<article><p>{'<b>w ' * 60_000}</p></article>")]
    df = spark.createDataFrame(rows, "id int, html string").repartition(4)
    got = {r.id: r.ps for r in pages.native_sections(df, "html", "article", "p", "ps").collect()}
    assert got[0] == ["w " * 100_000] and got[1] == ["x" * 5_000_000]
    assert got[2] == ["k l"] * 30_000 and got[3] == ["w " * 60_000]
    inner = markup.container(markup.visible(F.col("html")), "article")
    own = {r.id: r.own for r in df.select("id", markup.own_texts(inner, "p").alias("own")).collect()}
    assert own[0] == [" "] * 100_000 and own[2] == ["k "] * 30_000 and own[3] == []
    parsed = {r.id: (r.n, r.stops) for r in df.select("id", markup.parsed(F.col("html")).alias("page")).select(
        "id", F.size("page.elements").alias("n"), F.transform(F.slice("page.elements", 1, 3), lambda e: e["stop"]).alias("stops")).collect()}
    assert parsed[0] == (100_002, [200_003, 200_002, 3]) and parsed[2][0] == 60_001 and parsed[3] == (60_002, [60_003, 60_002, None])


def test_running_sum(spark):
    from newsloom.functions import arrays

    rows = [([1] * 1000,), ([],), ([3, -1] * 300,), ([7],), (list(range(256)),), (list(range(257)),)]
    for (r,), (v,) in zip(spark.createDataFrame(rows, "v array<int>").select(arrays.running_sum(F.col("v"))).collect(), rows):
        assert r == [sum(v[:i + 1]) for i in range(len(v))]


def test_words_of_whole_texts_are_those_of_the_columns(spark):
    """Languages and counted words against the columns for one word, on odd texts; no lambda runs over the words."""
    from collections import Counter

    from newsloom.functions import lexicon, words
    from newsloom.operators import digest, vectors

    texts = ["The cat and the Cat_s CAT, and THE dog -- dog's!", "Le chat, l'été; Été ete ŒUVRE œuvre straße Strasse ÆØł Đ", "", None, "___ --- _ ,",
             "der die das und Übung übung ubung", "ΑΣ.Β Σας ΣΑΣ İstanbul istanbul ﬁn ½ x² 中文 中文 é́ next blank\x1fend", "été the of\x85and",
             "el la los las que de el", "aaa bbb aaa\r\nbbb\tccc\x0bddd"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, body string")
    cut = {r.id: r for r in df.select("id", text.tokens(F.col("body")).alias("t"), text.tokens(F.lower("body")).alias("low")).collect()}
    flat = sorted({t for r in cut.values() for t in r.t or []})
    spelt = {r.w: (r.low, r.folded) for r in spark.createDataFrame([(w,) for w in flat], "w string").select(
        "w", F.lower("w").alias("low"), text.fold(F.col("w")).alias("folded")).collect()}
    language = {r.id: r.language for r in vectors.with_language(df, "body").collect()}
    for i, r in cut.items():
        hits = [len(set(r.low or []) & set(lexicon.base_words(n))) for n in lexicon.LANGUAGES]
        assert language[i] == (lexicon.LANGUAGES[hits.index(max(hits))] if max(hits) else None), i
    for folded in (True, False):
        told = digest.content_words(df, "body", folded=folded)
        plan = told._jdf.queryExecution().executedPlan().toString()
        assert "ArrowEvalPython" in plan and "lambda" not in plan
        for r in told.collect():
            stop, uses, first = lexicon.stop_words(language[r.id] if language[r.id] in ("french", "english") else None), Counter(), {}
            for k, w in enumerate(cut[r.id].t or []):
                value = spelt[w][1] if folded else w
                if spelt[w][0] not in stop and w not in stop and value:
                    uses[value] += 1
                    first.setdefault(value, k)
            want = sorted(((w, first[w], n) for w, n in uses.items()), key=lambda e: e[1])
            assert [tuple(e) for e in r._words or []] == want, (r.id, folded)
