"""The manifest, whitening and language operators against plain versions, and on odd tables."""

import random
import zlib
from fractions import Fraction
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsloom.llm import language, merkle, queries, whitening

DOCS = "doc_id long, source string, lang string, n_chars long, text string"
EXTRA = ["key", "idx", "n", "digest", "altered", "block", "x", "d", "gram", "score"]


def clashing(df):
    """Extra columns whose names the operators use themselves."""
    return df.select("*", *[F.lit("extra").alias(c) for c in EXTRA])


def written(df, path):
    df.write.parquet(str(path))
    return str(path.parent)


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def plain_tree(leaves):
    """Root, and per leaf the siblings left and right of its path."""
    levels = [list(leaves)]
    while len(levels[-1]) > 1:
        now = levels[-1]
        levels.append([h(*now[i:i + 3]) for i in range(0, len(now), 3)])
    paths = []
    for i in range(len(leaves)):
        path = []
        for level in levels[:-1]:
            run = i - i % 3
            path.append(("".join(level[run:i]), "".join(level[i + 1:run + 3])))
            i //= 3
        paths.append(path)
    return levels[-1][0], paths


def plain_manifest(rows):
    fields = lambda *vs: "".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in vs)
    groups = {}
    for i, source, lang, n, text in rows:
        leaf = h(fields(i, source, lang, n, text))
        other = leaf
        if i is not None and zlib.crc32(str(i).encode()) % 2 == 0 and text is not None:
            other = h(fields(i, source, lang, n, text.replace("\n", "")))
        groups.setdefault(source, []).append(((i is not None, i or 0), leaf, other, i))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        groups[s].sort(key=lambda r: r[:3])
        trees[s] = plain_tree([r[1] for r in groups[s]])
    root, tops = plain_tree([trees[s][0] for s in names])
    out = []
    for s, top in zip(names, tops):
        for (_, leaf, other, i), path in zip(groups[s], trees[s][1]):
            folded = other
            for left, right in path + top:
                folded = h(left, folded, right)
            out.append((i, leaf, trees[s][0], root, h(*[p for pair in path + top for p in pair]), folded, folded == root))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    out = [(i, f"s{i % 7}" if i % 3 else "hot", "en", i, f"line {rng.random()}\nand more\n" * (i % 3)) for i in range(1100)]
    out += [(2000 + i, f"single {i}", None, None, None) for i in range(300)]
    out += [(None, None, "fr", 3, "no id\n"), (5000, None, None, 0, ""), (5001, "é", "x", 1, "Ünï\ncode"), (5002, "é", "x", 1, "\n" * 50_000)]
    out += [(7, "s0", "en", 7, "again\n")] * 3 + [(1 << 60, "hot", "en", 1, "big id")]
    rng.shuffle(out)
    return out


def test_manifest(spark, rows, tmp_path):
    d = written(clashing(spark.createDataFrame(rows, DOCS)).repartition(3), tmp_path / "documents.parquet")
    got = queries.op11_merkle_manifest(spark, d)
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_manifest(rows)


@pytest.mark.parametrize("count", [0, 1, 2, 3, 4, 10])
def test_small_manifests(spark, tmp_path, count):
    few = [(i, "s", "en", 1, "a\nb") for i in range(count)]
    d = written(spark.createDataFrame(few, DOCS), tmp_path / "documents.parquet")
    assert sorted((tuple(r) for r in queries.op11_merkle_manifest(spark, d).collect()), key=str) == (
        plain_manifest(few) if few else [])


def test_manifest_sql_is_the_same(spark, rows, tmp_path):
    import duckdb

    # Only one of equal rows: with different altered leaves their order would be free.
    few = list({r[0]: r for r in rows}.values())[:400]
    d = written(spark.createDataFrame(few, DOCS).coalesce(1), tmp_path / "documents.parquet")
    with duckdb.connect() as c:
        c.execute(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet/*.parquet'")
        assert sorted(c.execute(queries.ORACLE_SQL["op11_merkle_manifest"]).fetchall(), key=str) == plain_manifest(few)


@pytest.mark.parametrize("n", [1, 2, 3, 5, 9, 10, 27, 28, 80, 244])
def test_places_follow_from_sizes(n):
    """A log written node by node has every node at the place that the formula gives."""
    leaves = [f"{i}" for i in range(n)]
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i:i + 3]) for i in range(0, len(levels[-1]), 3)])
    log = merkle.segment(leaves, merkle.height(n))
    assert len(log) == sum(map(len, levels))
    for level, nodes in enumerate(levels):
        assert [log[merkle.node_place(level, j, n)] for j in range(len(nodes))] == nodes


def test_log_and_single_proofs(spark, rows):
    docs = clashing(spark.createDataFrame(rows, DOCS))
    trees, _ = merkle.manifest(docs.drop("key"), "doc_id", "source", merkle.leaf_digest(merkle.field("text")), F.lit(None).cast("string"))
    log = merkle.append_log(trees)
    sizes = {r.key: (r.n, r.last) for r in log.groupBy("key").agg(F.count("*").alias("n"), F.max("place").alias("last")).collect()}
    assert len(sizes) == 7 + 300 + 3 and all(n == last + 1 for n, last in sizes.values())
    assert log.select("key", "place").distinct().count() == log.count()
    roots = {r.key: r.digest for r in merkle.roots(trees).collect()}
    n = {r.key: r.n for r in trees[0].where("block = 0").select("key", "n").collect()}
    asked = [("=hot", 0), ("=hot", 200), ("=hot", n["=hot"] - 1), ("=s1", 17), ("=single 3", 0)]
    found = merkle.prove(log, spark.createDataFrame([(k, i, n[k]) for k, i in asked], "key string, idx long, n long")).collect()
    assert len(found) == len(asked)
    digests = {(r.key, r.place): r.digest for r in log.collect()}
    for r in found:
        lefts, rights = [""] * merkle.height(n[r.key]), [""] * merkle.height(n[r.key])
        for s in r.siblings:
            side = lefts if s.left else rights
            side[s.step] += s.digest
        assert merkle.fold(digests[r.key, merkle.place(r.idx)], lefts, rights) == roots[r.key]


VECTORS = "vec_id long, embedding array<float>"


def plain_whitening(vectors):
    x = [[(int(np.floor(64 * float(c)))) + 1_000_000 for c in v] for v in vectors]
    n, dims = len(x), len(x[0])
    s = [sum(r[i] for r in x) for i in range(dims)]
    cov = np.array([[float(Fraction(sum((n * r[i] - s[i]) * (n * r[j] - s[j]) for r in x), n ** 3)) for j in range(dims)]
                    for i in range(dims)])
    return n, [sum((n * a - b) ** 2 for a, b in zip(r, s)) for r in x], cov, np.array(x, float) - np.array(s) / n


def test_whitening(spark, tmp_path):
    rng = np.random.default_rng(2)
    mix = rng.normal(size=(6, 6))
    vectors = [(i, [float(c) for c in np.float32(rng.normal(size=6) @ mix)]) for i in range(300)]
    odd = [(900, None), (901, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (902, [float("nan")] + [1.0] * 5),
           (903, [float("inf")] + [1.0] * 5), (904, []), (905, [1.0, 2.0])]
    ties = [(7, vectors[7][1]), (None, vectors[3][1]), (1 << 60, [0.0] * 6)]
    d = written(clashing(spark.createDataFrame(vectors + odd + ties, VECTORS)), tmp_path / "embeddings.parquet")
    got = queries.op12_bit_sliced_whitening(spark, d).toPandas()
    kept = vectors + ties
    n, deviation, cov, centred = plain_whitening([v for _, v in kept])
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1], u[:, ::-1]
    assert set(got["n"]) == {n} and len(got) == n * 6 and got["identity_error"].iloc[0] < 1e-9
    want = {}
    for (i, _), dev, row in zip(kept, deviation, centred @ u / np.sqrt(e)):
        want.setdefault(i, (dev, row))
    signs = {}
    for r in got.itertuples():
        i = None if r.vec_id != r.vec_id else (1 << 60 if r.vec_id > 1e9 else int(r.vec_id))
        dev, row = want[i]
        assert r.deviation == dev
        assert abs(r.explained - e[r.component - 1] / np.trace(cov)) < 1e-12
        value = row[r.component - 1]
        sign = signs.setdefault(r.component, np.sign(value * r.whitened))
        assert abs(r.whitened - sign * value) < 1e-8


def test_whitening_of_large_numbers_constants_and_nothing(spark):
    big = [(i, [float(2.0 ** 30 * (i % 5)), float(i), 3.0]) for i in range(40)]
    rows = spark.createDataFrame(big, "vec_id long, embedding array<double>")
    got = whitening.whiten(rows, "vec_id", "embedding").toPandas()
    n, deviation, _, _ = plain_whitening([v for _, v in big])
    assert got.groupby("vec_id")["deviation"].first().tolist() == [v if v < 2 ** 63 else None for v in deviation] or all(
        a != a or a == b for a, b in zip(got.groupby("vec_id")["deviation"].first(), deviation))
    flat = got[got.component == 3]
    assert flat["whitened"].isna().all() and (flat["explained"] == 0).all() and got["identity_error"].iloc[0] < 1e-6
    assert whitening.whiten(rows.limit(0), "vec_id", "embedding").count() == 0
    alone = whitening.whiten(rows.limit(1), "vec_id", "embedding").toPandas()
    assert len(alone) == 3 and alone["whitened"].isna().all() and (alone["deviation"] == 0).all()


@pytest.mark.parametrize("top", [1, 100, 1 << 20, 1 << 52])
def test_bit_planes_give_exact_products(top):
    rng = np.random.default_rng(top % 97)
    x = rng.integers(0, top, (130, 5), endpoint=True)
    x[:, 2] = 0
    x[0, 3] = top
    bits = [int(c).bit_length() for c in x.max(0)]
    got = whitening.scatter(whitening.planes(x, bits), bits)
    for i in range(5):
        for j in range(i, 5):
            assert int(got[i, j]) == sum(int(a) * int(b) for a, b in zip(x[:, i], x[:, j]))


def test_limbs_hold_any_number():
    for v in (0, 1, -1, (1 << 130) + 5, -(1 << 130) - 5):
        assert whitening.unlimbed({f"l{k}": x for k, x in enumerate(whitening.limbs(v))}) == v


PLAIN = {"en": "the and of to in is that it was for on are with as this have from", "fr": "le la les et des une dans que pour qui sur pas plus avec être",
         "de": "der die und das nicht ist ein mit auf sich den für von dem wird"}


def sayings(rng, lang, n):
    return " ".join(rng.choice(PLAIN[lang].split()) for _ in range(n)).capitalize() + "."


def language_rows():
    rng = random.Random(8)
    out = [(i, sayings(rng, lang, rng.randrange(8, 60)), lang) for i, lang in enumerate(rng.choices(list(PLAIN), (6, 2, 1), k=400))]
    out += [(1000, None, "en"), (1001, "", "fr"), (1002, "12 + 3 = 15 …", "de"), (1003, "the and of that this " * 200_000, None),
            (1004, "è", None), (1005, "x", "en"), (None, "der die und das nicht ist", "de"), (3, "le la les et des une dans", "fr")]
    return out


def test_language(spark, tmp_path):
    rows = language_rows()
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    d = written(docs.repartition(3), tmp_path / "documents.parquet")
    got = queries.op13_language_filters(spark, d).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    for i in (1000, 1001, 1002):
        assert (by[i][0].lang_pred, by[i][0].score) == ("und", 0.0)
    assert by[1003][0].lang_pred == "en" and by[None][0].lang_pred == "de" and len(by[3]) == 2
    held = [(by[i][0].lang_pred, lang) for i, _, lang in rows[:400] if by[i][0].held_out]
    assert sum(a == b for a, b in held) > 0.97 * len(held)


def test_language_filters_hold_all_their_ngrams(spark):
    """Against sets: no n-gram of a language is missed, foreign ones pass as often as chance says."""
    rows = [(t, x) for _, t, x in language_rows()]
    model = language.learn(spark.createDataFrame(rows, "text string, lang string"), "text", "lang")
    assert model.languages == ["de", "en", "fr"] and model.usual == "en"
    counts = {}
    for text, lang in rows:
        data = language.normal(text) if text else b""
        if lang and text is not None:
            for k in range(len(data) - 3):
                per = counts.setdefault(lang, {})
                per[data[k:k + 4]] = per.get(data[k:k + 4], 0) + 1
    total = {x: sum(c.values()) for x, c in counts.items()}
    share = lambda x, g: counts[x].get(g, 0) / total[x]
    every = sorted({g for c in counts.values() for g in c})
    best = {g: max(share(x, g) for x in counts) for g in every}
    number = np.array([int.from_bytes(g, "little") for g in every], np.uint32)
    found = model.hits(number)[0]
    for k, x in enumerate(model.languages):
        bit = found >> k & 1
        want = np.array([share(x, g) >= 3 / language.GRAMS and share(x, g) >= 0.4 * best[g] for g in every])
        assert bit[want].all()
        assert abs(bit[~want].mean() - model.chance[k]) < 0.02


def test_long_texts_in_pieces_are_the_same(monkeypatch):
    text = "one two three " * 5000
    whole = [language.ngrams(p)[0] for _, p in language._pieces([text, "a", None, ""])]
    monkeypatch.setattr(language, "BLOCK", 100)
    parts = [language.ngrams(p)[0] for _, p in language._pieces([text, "a", None, ""])]
    assert len(parts) > 100 and np.array_equal(np.concatenate(whole), np.concatenate(parts))


def test_language_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    model = language.learn(empty, "text", "lang")
    assert language.predict(empty, "doc_id", "text", model).count() == 0
    one = spark.createDataFrame([(1, "words", None)], "doc_id long, text string, lang string")
    assert language.predict(one, "doc_id", "text", model).first()[1:] == ("und", 0.0)


def test_many_languages_use_several_words(spark):
    rng = random.Random(1)
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = {f"l{k:03}": ["".join(rng.choice(letters) for _ in range(7)) for _ in range(12)] for k in range(90)}
    rows = [(f"{' '.join(rng.choices(words[x], k=30))}", x) for x in words for _ in range(3)]
    model = language.learn(spark.createDataFrame(rows, "text string, lang string"), "text", "lang")
    assert model.slices.shape[0] == 2
    names, _ = language.decide([t for t, _ in rows], model)
    assert names == [x for _, x in rows]
