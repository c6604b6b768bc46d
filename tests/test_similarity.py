import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from newsloom.operators import joins, similarity, vectors

TITLES = ["harbour bridge closes for repairs", "repairs close the old harbour bridge", "city orchestra plays at dawn",
          "dawn concert by the orchestra of the city", "bridge painters wanted", "le vieux pont ferme pour travaux",
          "harbour bridge closes for repairs", "travaux sur le pont du port", "56 78", "walrus"]


def brute(counts, n):
    """Best earlier match from {id: Counter}, plain loops."""
    df = Counter(t for c in counts.values() for t in c)
    unit = {}
    for i, c in counts.items():
        w = {t: k * (math.log((1 + n) / (1 + df[t])) + 1) for t, k in c.items()}
        norm = math.sqrt(sum(v * v for v in w.values()))
        unit[i] = {t: v / norm for t, v in w.items()}
    best = {}
    for i in sorted(unit):
        top = (None, 0.0)
        for j in sorted(unit):
            if j < i:
                s = sum(v * unit[j].get(t, 0.0) for t, v in unit[i].items())
                if round(s, 9) > round(top[1], 9):
                    top = (j, s)
        best[i] = top
    return best


def counts_of(spark, df):
    out = {}
    for r in vectors.term_counts(df, "id", "title").collect():
        out.setdefault(r.id, Counter())[r.term] = r.tf
    return out


def check(spark, rows, **options):
    df = spark.createDataFrame(rows, "id long, title string")
    want = brute(counts_of(spark, df), len(rows))
    got = {r.id: (r.match_id, r.score) for r in similarity.best_earlier(df, "id", "title", **options).collect()}
    assert len(got) == len(rows)
    for i, (match, score) in got.items():
        m, s = want.get(i, (None, 0.0))
        assert match == m and abs(score - s) < 1e-9 and -1e-9 <= score <= 1 + 1e-9, (i, match, score, m, s)


def test_best_earlier_on_titles(spark):
    check(spark, list(enumerate(TITLES)))


@pytest.mark.parametrize("seed", [1, 2])
def test_best_earlier_with_hot_words_copies_blocks_and_salts(spark, seed):
    rnd = random.Random(seed)
    words = [f"kw{k}x" for k in range(40)]
    rows = []
    for i in range(160):
        if i % 3 == 0:
            title = "hotone hottwo"          # a third of the rows are copies
        else:
            title = " ".join(["hotone"] * (i % 2) + rnd.choices(words, k=rnd.randint(1, 5)))
        rows.append((i * 7, title))
    check(spark, rows, block_rows=25, salt_rows=5, hot_share=10)


def test_single_text_has_no_match(spark):
    check(spark, [(5, "only one title")])


def test_as_of_and_buffer_match_brute_force(spark):
    rows = [(i, TITLES[i % len(TITLES)] if i % 4 else f"phone galaxy extra{i}") for i in range(23)]
    df = spark.createDataFrame(rows, "id long, title string")
    counts = counts_of(spark, df)
    recent = {r.id: r for r in similarity.best_recent(df, "id", "title", 5, block_rows=7).collect()}
    buffered = {r.id: r for r in similarity.best_in_buffer(df, "id", "title", 4, block_rows=7).collect()}
    for i in range(len(rows)):
        upto = {k: counts[k] for k in range(i + 1) if k in counts}
        window = {k: v for k, v in upto.items() if k >= i - 5}
        df_all = Counter(t for c in upto.values() for t in c)
        assert_best(recent[i], i, window, df_all, i + 1)
        held = {k: v for k, v in upto.items() if k >= i - 4}
        assert_best(buffered[i], i, held, Counter(t for c in held.values() for t in c), 5)


def assert_best(row, i, pool, df, n):
    best = (None, 0.0)
    if i in pool:
        vec = lambda c: {t: k * (math.log((1 + n) / (1 + df[t])) + 1) for t, k in c.items()}
        norm = lambda w: math.sqrt(sum(x * x for x in w.values()))
        a = vec(pool[i])
        for j in sorted(pool):
            if j < i:
                b = vec(pool[j])
                s = sum(x * b.get(t, 0) for t, x in a.items()) / (norm(a) * norm(b))
                if round(s, 9) > round(best[1], 9):
                    best = (j, s)
    assert row.match_id == best[0] and abs(row.score - best[1]) < 1e-9, (i, row, best)


def test_lookup_is_exact_with_hot_keys(spark):
    rows = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i % 20}") for i in range(300)], "id long, k string")
    table = rows.groupBy("k").agg(F.count("*").alias("n")).withColumn("v", F.concat("k", F.lit("!")))
    got = joins.lookup(rows, table, "k", "n", 300, hot_share=4).collect()
    assert len(got) == 300 and all(r.v == r.k + "!" for r in got)


def test_running_values_in_blocks(spark):
    rows = spark.createDataFrame([(i, "ab"[i % 2], i % 7) for i in range(50)], "id long, k string, v long")
    whole = joins.running(rows, "k", "id", F.col("v"), "sum", "s", 50).collect()
    blocks = joins.running(rows, "k", "id", F.col("v"), "sum", "s", 50, block_rows=6).collect()
    assert sorted(map(tuple, whole)) == sorted((r.id, r.k, r.v, r.s) for r in blocks)
    placed = {r.id: r.pos for r in joins.positions(rows, "id", block_rows=6).collect()}
    assert placed == {i: i for i in range(50)}


def test_lookup_spreads_null_keys(spark):
    rows = spark.createDataFrame([(i, None if i % 3 else i % 5) for i in range(200)], "id long, k long")
    table = spark.createDataFrame([(k, 1, f"v{k}") for k in range(5)], "k long, n long, v string")
    got = joins.lookup(rows, table, "k", "n", 200, hot_share=2).collect()
    assert len(got) == 200 and all(r.v == (None if r.k is None else f"v{r.k}") for r in got)


def test_new_titles_against_stored_ones(spark, tmp_path):
    """Only new titles ask; what is stored counts as earlier, and idf is that of all."""
    from newsloom.operators import title_store

    path = str(tmp_path)
    first = [(10, "storm closes northern harbour"), (30, "storm closes harbour again"), (20, "bakers win bread prize"),
             (40, ""), (50, "river floods old market")]
    new = [(5, "storm closes northern harbour"), (15, "bread prize for village bakers"), (25, "quiet sunday"),
           (35, "bread prize for village bakers"), (45, None), (55, "river market floods")]
    rows = lambda r: title_store.with_terms(spark.createDataFrame(r, "id long, title string"), "id", "title")
    alone = {r.id: r for r in title_store.verdicts(rows(first), path, 0, 0.4).collect()}
    assert alone[10].match_id is None and alone[30].match_id == 10
    for _ in range(2):  # writing a version again changes nothing
        title_store.write(rows(first), path, 1, 4)
    assert {r.id for r in title_store.titles(spark, path, 1).collect()} == {50, 40, 30, 20}
    got = {r.id: r for r in title_store.verdicts(rows(new), path, 1, 0.4).collect()}
    assert set(got) == {i for i, _ in new}
    assert got[5].match_id == 30 and got[15].match_id == 20 and got[55].match_id == 50
    assert got[35].match_id == 15 and got[35].similarity == 1.0 and got[35].is_duplicate
    assert got[25].match_id is None and got[45].match_id is None and got[45].similarity_with == ""
    # The same by the plain operator over both sets, places in place of ids.
    order = sorted([r for r in first if r[0] > 10]) + sorted(new, key=lambda r: r[0])
    whole = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(order)], "id long, title string")
    plain = {r.id: r for r in similarity.best_earlier(whole, "id", "title").collect()}
    for i in range(4, len(order)):
        match = plain[i].match_id
        assert got[order[i][0]].match_id == (None if match is None else order[match][0])
        assert got[order[i][0]].similarity == round(plain[i].score, 2)


@pytest.mark.parametrize("n,salt_rows,hot_share", [(1, 50_000, 10_000), (3, 4, 5), (5, 3, 10_000)])
def test_topn_of_all_texts_is_exact(spark, n, salt_rows, hot_share):
    """Against all pairs: copies, ties, texts without words, a word in every text."""
    rng = random.Random(n)
    words = "harbour bridge closes orchestra dawn city concert painter bakery flood market storm".split()
    rows = [(i, "harbour " + " ".join(rng.choices(words, [12 - k for k in range(12)], k=rng.randrange(1, 6)))) for i in range(60)]
    rows += [(100 + i, rows[3][1]) for i in range(7)] + [(200, ""), (201, None), (202, "walrus"), (203, "walrus walrus"), (204, "unique")]
    df = spark.createDataFrame(rows, "id long, title string")
    asked = df.where("id % 3 <> 1")
    got = similarity.similar_topn_all(df, asked, "id", "title", n, salt_rows, hot_share).collect()
    vecs = {}
    for r in vectors.tfidf(df, "id", "title").collect():
        vecs.setdefault(r.id, {})[r.term] = r.weight
    want = []
    for i in sorted(r[0] for r in rows if r[0] % 3 != 1 and r[0] in vecs):
        scores = [(round(sum(w * vecs[j].get(t, 0) for t, w in vecs[i].items()), 9), j) for j in vecs if j != i]
        best = sorted((-s, j) for s, j in scores if s > 0)[:n]
        want += [(i, k + 1, j, -s) for k, (s, j) in enumerate(best)]
    assert sorted((r.query_id, r["rank"], r.match_id, round(r.score, 9)) for r in got) == want
    assert similarity.similar_topn_all(df.limit(0), df.limit(0), "id", "title", n).count() == 0


def test_earlier_titles_are_compared_without_a_row_per_pair(spark):
    """Titles that all share words, none a copy: what is written grows with the titles, not with their pairs."""
    from newsloom import session

    rnd = random.Random(5)
    words = [f"kw{k}x" for k in range(12)]
    rows = [(i, " ".join(rnd.choices(words, k=8)) + f" only{i}x") for i in range(600)]
    df = spark.createDataFrame(rows, "id long, title string")
    written = []
    kept, similarity.settle = similarity.settle, lambda d: written.append(session.settle(d)) or written[-1]
    try:
        best = similarity.best_earlier(df, "id", "title")
        assert best.where("match_id is not null").count() == 599
    finally:
        similarity.settle = kept
    assert max(w.count() for w in written) < 20 * len(rows)


def test_top_titles_are_compared_without_a_row_per_pair(spark):
    from newsloom import session

    rnd = random.Random(6)
    words = [f"kw{k}x" for k in range(12)]
    rows = [(i, " ".join(rnd.choices(words, k=8)) + f" only{i}x") for i in range(600)]
    df = spark.createDataFrame(rows, "id long, title string")
    written = []
    kept, similarity.settle = similarity.settle, lambda d: written.append(session.settle(d)) or written[-1]
    try:
        assert similarity.similar_topn_all(df, df, "id", "title", 3).count() == 3 * len(rows)
    finally:
        similarity.settle = kept
    assert max(w.count() for w in written) < 20 * len(rows)


def test_a_word_is_stemmed_once_for_all_texts(spark, monkeypatch):
    """The words of many texts reach the stemmer once each, per rule set."""
    told, stem = [], vectors.stems.with_stem

    def counting(df, *names):
        told.append(df.count())
        return stem(df, *names)

    df = spark.createDataFrame([(i, t) for i, t in enumerate(TITLES * 20)], "id long, title string")
    plain = counts_of(spark, df.where("id < 10"))
    monkeypatch.setattr(vectors.stems, "with_stem", counting)
    found = counts_of(spark, df)
    assert all(found.get(i) == plain.get(i % 10) for i in range(200))
    assert sum(told) <= len({w for t in TITLES for w in t.split()})


@pytest.mark.parametrize("n, earlier", [(1, True), (1, False), (3, True), (3, False)])
def test_tile_scores_many_texts_at_once(monkeypatch, n, earlier):
    """Exact against plain loops, cut anywhere, with few passes over the block."""
    import numpy as np
    import pandas as pd

    rng = random.Random(5)
    rows = []
    for i in rng.sample(range(1000), 300):
        terms = rng.sample(range(40), rng.randint(1, 6))
        w = [rng.choice([0.25, 0.5, 1.0]) for _ in terms]
        norm = math.sqrt(sum(x * x for x in w))
        rows.append((i, np.array(terms), np.array([x / norm for x in w])))
    table = pd.DataFrame(rows, columns=["id", "terms", "weights"])
    asking, held = table.iloc[:200], table.iloc[100:]
    want = {}
    for i, terms, w in asking.itertuples(index=False):
        mine = dict(zip(terms, w))
        scores = [(-round(sum(x * mine.get(t, 0.0) for t, x in zip(ts, ws)), 9), j)
                  for j, ts, ws in held.itertuples(index=False) if (j < i if earlier else j != i)]
        want[i] = [(j, -s) for s, j in sorted(scores) if s < 0][:n]
    calls, count = [], np.bincount
    monkeypatch.setattr(np, "bincount", lambda *a: calls.append(1) or count(*a))
    for most in (1, 1000, 1 << 20):
        got = {i: [] for i in want}
        for i, j, s in similarity._tile(n, earlier, most)(asking, held).itertuples(index=False):
            got[i].append((j, round(s, 9)))
        assert got == want
    assert len(calls) <= 200 + 200 + 1


@pytest.mark.parametrize("n, earlier", [(1, True), (3, False)])
def test_blocks_add_up_only_what_can_win(monkeypatch, n, earlier):
    """Exact over blocks that lie in any order of their words, by a part of the products of all lists."""
    import numpy as np

    rng = np.random.default_rng(3)
    texts = []
    for i in range(1200):
        # Copies but for a word, among texts that share frequent words.
        terms = set(rng.integers(0, 20, 6)) | set(rng.integers(20, 4000, 6))
        if i % 2 and texts:
            terms = set(texts[rng.integers(len(texts))]) ^ {int(rng.integers(20, 4000))}
        texts.append(sorted(int(t) for t in terms))
    uses = np.bincount(np.concatenate(texts))
    weights = [(lambda w: w / np.sqrt((w * w).sum()))(np.log(1200 / uses[t]) + 1) for t in texts]
    ids = np.arange(1200) * 3
    cells = lambda part: (ids[part], np.array([len(texts[k]) for k in part]), np.concatenate([texts[k] for k in part]),
                          np.concatenate([weights[k] for k in part]))
    added, add = [], np.add.at
    monkeypatch.setattr(np, "add", type("Add", (), {"at": staticmethod(lambda s, r, v: added.append(len(r)) or add(s, r, v))}))
    asks = cells(range(1200))
    best = [[] for _ in texts]
    for start in range(0, 1200, 400):
        similarity._asked(similarity._index(*cells(range(start, start + 400))), *asks, n, earlier, best, 500)
    whole = np.zeros((1200, uses.size))
    for k, t in enumerate(texts):
        whole[k, t] = weights[k]
    scores = whole @ whole.T
    np.fill_diagonal(scores, 0)
    scores = np.tril(scores) if earlier else scores
    for k in range(1200):
        order = np.lexsort((ids, -np.round(scores[k], 9)))[:n]
        assert [j for _, j, _ in best[k]] == [ids[j] for j in order if scores[k, j] > 0]
        assert np.allclose([s for _, _, s in best[k]], [scores[k, j] for j in order if scores[k, j] > 0], atol=1e-12)
    products = (uses.astype(float) ** 2).sum() / (2 if earlier else 1)
    assert sum(added) < 0.6 * products


def test_texts_are_not_sent_once_per_block(spark, monkeypatch):
    """What is exchanged grows with the texts, not with the blocks that they are compared in."""
    rnd = random.Random(8)
    rows = [(i, " ".join(rnd.choices([f"kw{k}x" for k in range(50)], k=8))) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, title string")
    asked = []
    near = similarity._nearest
    monkeypatch.setattr(similarity, "_nearest", lambda *a: asked.append(near(*a)) or asked[-1])
    assert similarity.best_earlier(df, "id", "title", block_rows=20).where("match_id is not null").count() > 250
    plan = asked[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "explode" not in plan
