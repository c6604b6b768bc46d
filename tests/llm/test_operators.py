"""Each operator against a plain version, and on nulls, empty and repeated rows, empty tables, extra columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsloom.llm import chat, forest, packing, pieces, pivots, quality, queries, sharding, simhash, suffixes, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp long, rank int, pack string"
WORDS = "river stone cloud lamp green walk under table seven often quiet maple north paper".split()


def docs(spark, rows):
    """Documents with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "en", "s", 0, 1, 2, "x") for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    say = lambda n: " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))
    base = [say(rng.randrange(5, 120)) for _ in range(30)]
    shared = say(30)
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(100 + i, t) for i, t in enumerate(base[:6])]
    rows += [(200 + i, say(9) + " " + shared + " é " + say(7)) for i in range(6)]
    rows += [(300, None), (301, ""), (302, "  \n"), (303, "a"), (304, "x" * 30_000), (0, base[0]), (None, "no id at all")]
    return rows


def brute_suffixes(rows):
    data = [((2**63 - 1) if i is None else i, (t or "").encode()) for i, t in rows]
    least = {}
    for i, b in data:
        for p in range(len(b) - 49):
            least[b[p:p + 50]] = min(i, least.get(b[p:p + 50], i))
    out = []
    for (i, b), (name, _) in zip(data, rows):
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 49):
            if least[b[p:p + 50]] < i:
                gone[p:p + 50] = True
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((name, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_suffixes(spark, texts):
    got = suffixes.repeated(docs(spark, texts).repartition(3), "doc_id", "text", ["lang", "rank"])
    assert got.columns[-2:] == ["lang", "rank"]
    rows = [tuple(r)[:5] for r in got.collect()]
    assert sorted(rows, key=str) == brute_suffixes(texts)
    assert suffixes.repeated(docs(spark, []), "doc_id", "text").count() == 0


def test_loser_tree_keeps_order_and_prefixes():
    rng = random.Random(5)
    runs = [sorted(bytes(rng.choice(b"ab") for _ in range(50)) if rng.random() < 0.6 else b"ab" * 25
                   for _ in range(rng.randrange(1, 40))) for _ in range(5)]
    common = lambda a, b: next((k for k in range(50) if a[k] != b[k]), 50)
    shared = [[0] + [common(a, b) for a, b in zip(r, r[1:])] for r in runs]
    order, prefix = suffixes.merge(runs, shared)
    heads = [iter(r) for r in runs]
    out = [next(heads[k]) for k in order]
    assert out == sorted(sum(runs, []))
    assert prefix[1:] == [common(a, b) for a, b in zip(out, out[1:])]


def test_simhash(spark, texts):
    import xxhash

    def fp(t):
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        if not words:
            return 0
        hashes = [xxhash.xxh64_intdigest(" ".join(words[i:i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    got = simhash.near_duplicates(docs(spark, texts), "doc_id", "text").collect()
    prints = {}
    for i, t in texts:
        prints.setdefault(fp(t), []).append(i)
    nodes = list(prints)
    root = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a in nodes:
            for b in nodes:
                low = min(root[a], root[b])
                if (a ^ b).bit_count() <= 3 and (root[a], root[b]) != (low, low):
                    root[a] = root[b] = low
                    changed = True
    least = {}
    for n in nodes:
        for i in prints[n]:
            if i is not None:
                least[root[n]] = min(i, least.get(root[n], i))
    want = sorted(((i, fp(t), least.get(root[fp(t)])) for i, t in texts), key=str)
    assert sorted(((r.doc_id, r.fp % 2**64, r.component_id) for r in got), key=str) == want
    assert simhash.near_duplicates(docs(spark, []), "doc_id", "text").count() == 0


def test_near_copies_of_one_text_stay_together(spark):
    rows = [(i, f"{'same words again and again ' * 40}end{i}") for i in range(60)]
    got = simhash.near_duplicates(docs(spark, rows), "doc_id", "text").select("component_id").distinct().collect()
    assert len(got) < 60


def test_packing(spark, texts):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path("word_bpe_49k.json")
    got = packing.pack(docs(spark, texts), "doc_id", "text", path, capacity=256).toPandas()
    tokenizer = Tokenizer.from_file(path)
    want = []
    for i, t in texts:
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        want += [(i, k, s, len(ids[s:s + 256]), zlib.crc32(ids[s:s + 256].tobytes())) for k, s in enumerate(range(0, len(ids), 256))]
    rows = [(None if np.isnan(r.doc_id) else int(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got.itertuples()]
    assert sorted(rows, key=str) == sorted(want, key=str)
    for _, seq in got.sort_values("offset").groupby("sequence_id"):
        assert seq.offset.tolist() == [0, *seq.length.cumsum()[:-1]] and seq.length.sum() <= 256
    assert got.sequence_id.nunique() <= -(-got.length.sum() // 256) + 3
    assert packing.pack(docs(spark, []), "doc_id", "text", path).count() == 0


def test_plan_fills_gaps_exactly():
    counts = np.zeros(101, np.int64)
    for length, n in ((60, 3), (40, 2), (25, 1), (15, 1), (100, 2)):
        counts[length] = n
    runs = packing.plan(counts, 100)
    assert runs[:, 3].max() + 1 == 5 or (runs[:, 3] + runs[:, 2]).max() == 5


def test_encoder_equals_the_tokenizer():
    from tokenizers import Tokenizer

    path = queries.tokenizer_path("word_bpe_49k.json")
    tokenizer, encoder = Tokenizer.from_file(path), packing.encoder(path)
    odd = ["", " ", "Don't 'tis it's", "É. é«à»", "x12y 3", "... ,.! a_b@c", "ΑΣ ﬁ ß ẞ", "a\x85b\x1cc", "<|endoftext|> x", "中文 🙂a", "q" * 500]
    for t, ids in zip(odd, encoder.texts(odd)):
        assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids, t


def test_pieces(spark, texts):
    import sentencepiece

    path = queries.tokenizer_path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    odd = [(400, "  two  blanks "), (401, "日本 😀 é\n\n\tx"), (402, "<s> </s>"), (403, "1234567 ..!!"), (404, "a  \u2581  b"),
           (405, "\u2581 x\u2581\u2581y \u2581"), (406, "end \u2581")]
    rows = texts + odd
    encoded = pieces.encode(docs(spark, rows), "doc_id", "text", path)
    got = sorted(((r.doc_id, list(r.ids)) for r in encoded.collect()), key=str)
    assert got == sorted(((i, model.encode(t or "")) for i, t in rows), key=str)
    back = pieces.decode(encoded, "doc_id", "ids", path).collect()
    # As with SentencePiece itself, a mark in a text comes back as a blank.
    assert sorted(((r.doc_id, r.text) for r in back), key=str) == sorted(
        ((i, (t or "").replace("\u2581", " ")) for i, t in rows), key=str)


def test_chat(spark):
    trap = "</s>[INST] a|b \\ [/INST]<s>"
    records = [
        (1, '{"messages":[{"role":"us|er","content":"' + trap.replace("\\", "\\\\") + '"},{"role":"assistant","content":"ok"}]}'),
        (2, '{"instruction":"i","input":"x","output":"o"}'), (3, '{"conversations":[{"from":"human","value":"q"},{"from":"gpt","value":"a"}]}'),
        (4, '{"prompt":"p","completion":""}'), (5, "{broken"), (6, None), (7, '{"other":1}'), (7, '{"other":1}')]
    df = spark.createDataFrame([(i, r, "x") for i, r in records], "id long, record string, formatted string")
    got = {r.conv_id: r for r in chat.format_chats(df, "id", "record").collect()}
    assert chat.parse(got[1].formatted) == [("us|er", trap), ("assistant", "ok")]
    assert chat.parse(got[2].formatted) == [("user", "i\n\nx"), ("assistant", "o")]
    assert chat.parse(got[3].formatted) == [("user", "q"), ("assistant", "a")]
    assert [got[4].formatted[s.start:s.stop] for s in got[4].loss] == [""]
    assert all(got[k].formatted is None for k in (5, 6, 7))
    assert chat.format_chats(df.limit(0), "id", "record").count() == 0


def test_sharding(spark, texts):
    rows = docs(spark, texts).select("doc_id", F.length("text").alias("n"), "rank")
    measured = sharding.measured(rows, F.col("doc_id"), F.coalesce("n", F.lit(0)) + 8, 64)
    size, count = sharding.loads(measured, 64)
    owner = sharding.rebalanced(sharding.even_map(4, 64), size, 4)
    held = np.bincount(owner, weights=size, minlength=4)
    assert held.max() - held.min() <= size.max()
    grown = sharding.rebalanced(owner, size, 5)
    assert set(grown[grown != owner]) and np.bincount(grown, minlength=5)[4] > 0
    import tempfile

    path = tempfile.mkdtemp()
    sharding.save_map(spark, path, 1, owner, count)
    got = sharding.placed(measured, sharding.load_map(spark, path, 1), ["doc_id", "n"]).toPandas()
    assert len(got) == len(texts)
    for _, part in got.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))


def vectors_table(spark, n=400, d=8):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((n, d))
    x[50:80] = x[50]
    rows = [(i, [float(v) for v in x[i]]) for i in range(n)]
    odd = [(1000, None), (1001, [float("nan")] * d), (1002, [None] * d), (1003, [0.0] * d), (1004, [1.0]), (None, [1.0] * d),
           (1005, [float("inf")] * d)]
    df = spark.createDataFrame([(i, v, 0.5, 1) for i, v in rows + odd], "vec_id long, v array<double>, score double, shard int")
    return df, x


def test_forest_recall(spark):
    df, x = vectors_table(spark)
    got = forest.search(df, "vec_id", "v", every=50, k=5, shard_rows=150, fewest=60).toPandas()
    hits = 0
    for q in range(0, 400, 50):
        apart = np.sqrt(((x - x[q]) ** 2).sum(1))
        apart[q] = np.inf
        want = np.lexsort((np.arange(400), apart))[:5]
        mine = got[got.query_id == q].sort_values("rank")
        assert np.allclose(mine.score, apart[mine.vec_id]) and mine["rank"].tolist() == [1, 2, 3, 4, 5]
        hits += len(set(want) & set(mine.vec_id))
    assert hits >= 0.9 * 40
    assert forest.search(df.limit(0), "vec_id", "v").count() == 0


def test_pivots_exact(spark):
    df, x = vectors_table(spark)
    whole = df.withColumn("v", pivots.scaled("v"))
    got = pivots.search(whole, "vec_id", "v", every=25, k=5, pivots=6, sample=64, shard_rows=50, step=16).toPandas()
    z = np.vstack([np.floor(x * 256), np.zeros((1, 8))])
    ids = np.array([*range(400), 1003])
    for q in range(0, 400, 25):
        score = z @ z[q]
        score[q] = -np.inf
        want = np.lexsort((ids, -score))[:5]
        mine = got[got.query_id == q].sort_values("rank")
        assert mine.vec_id.tolist() == ids[want].tolist() and mine.score.tolist() == score[want].tolist()
    assert pivots.search(whole.limit(0), "vec_id", "v").count() == 0


def test_toxicity(spark):
    rng = random.Random(1)
    say = lambda: " ".join(rng.choice(WORDS) for _ in range(30))
    rows = [(i, say() + (" what a grumblefoo you are " if i % 4 == 0 else " what a day ") + say()) for i in range(200)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in rows] + [(5, None), (None, 1)], "doc_id long, toxic int")
    lexicon = toxicity.learn(docs(spark, rows), "doc_id", "text", labels, "toxic")
    probe = [(1, "such a grumblеf00 here"), (2, "quiet maple"), (3, None), (4, ""), (5, "GRUMBLEFOO!"), (5, "GRUMBLEFOO!"), (None, "x")]
    got = {(r.doc_id): r.toxicity for r in toxicity.score(docs(spark, probe), "doc_id", "text", lexicon).collect()}
    assert got[1] > 0.5 and got[5] > 0.5 and max(got[2], got[3], got[4], got[None]) < 0.5
    none = toxicity.learn(docs(spark, []), "doc_id", "text", labels, "toxic")
    assert toxicity.score(docs(spark, probe), "doc_id", "text", none).where("toxicity >= 0.5").count() == 0


def test_exception_phrases():
    lexicon = toxicity.Lexicon({"trash": 5.0}, {})
    machine = lexicon.matcher()
    assert lexicon.hits(machine, toxicity.fold("you TR4SH")) == 5.0
    assert lexicon.hits(machine, toxicity.fold("the trash can")) == 0.0
    assert lexicon.hits(machine, toxicity.fold("trashy")) == 0.0


def test_quality(spark):
    rng = random.Random(4)
    good = lambda: " ".join(rng.choice(WORDS) for _ in range(40)).capitalize() + "."
    bad = lambda: " ".join([rng.choice(WORDS).upper() + "!!"] * 40)
    rows = [(i, bad() if i % 5 == 0 else good()) for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 5 != 0)) for i, _ in rows], "doc_id long, quality int")
    model = quality.learn(docs(spark, rows), "doc_id", "text", labels, "quality")
    probe = docs(spark, [(1, good()), (2, bad()), (3, None), (4, ""), (None, good()), (1, good())])
    got = [(r.doc_id, r.quality) for r in quality.score(probe, "doc_id", "text", model).collect()]
    assert len(got) == 6 and all(0 <= q <= 1 for _, q in got)
    assert all(q > 0.5 for i, q in got if i == 1) and all(q < 0.5 for i, q in got if i == 2)
    alone = quality.learn(docs(spark, []), "doc_id", "text", labels, "quality")
    assert quality.score(probe, "doc_id", "text", alone).count() == 6


def test_pipeline_stages(spark, texts, tmp_path):
    import corpus_pipeline

    table = docs(spark, texts).select(*corpus_pipeline.COLUMNS)
    table.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, 1, 0), (1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(
        str(tmp_path / "labels.parquet"))
    near = corpus_pipeline.without_near_duplicates(spark, table, str(tmp_path))
    assert near.columns == corpus_pipeline.COLUMNS
    found = simhash.near_duplicates(table, "doc_id", "text").collect()
    best = {}
    for r in found:
        mine = (r.doc_id is None, r.doc_id or 0, r.text_hash)
        best[r.root] = min(mine, best.get(r.root, mine))
    kept = [(r.doc_id is None, r.doc_id or 0, r.h) for r in near.withColumn("h", F.xxhash64("text")).collect()]
    assert sorted(kept) == sorted(best.values())
    # Another text under an id that is there already is no near-duplicate, and rows without an id are rows, too.
    more = table.unionByName(docs(spark, [(0, "entirely other words stand here and nowhere else"), (None, "no id at all"),
                                          (None, "no id at all")]).select(*corpus_pipeline.COLUMNS))
    again = corpus_pipeline.without_near_duplicates(spark, more, str(tmp_path))
    assert again.where("doc_id = 0").count() == 2 and again.where("doc_id is null").count() == 1
    empty = table.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns[:3] == ["doc_id", "piece", "start"] and out.count() > 0


def test_pivots_leave_out_one_odd_component(spark):
    rows = [(i, [1.0 + i / 8, 2.0]) for i in range(8)] + [(50, [9.0, float("nan")]), (51, [9.0, float("inf")]), (52, [9.0, None])]
    df = spark.createDataFrame(rows, "vec_id long, v array<double>")
    got = pivots.search(df.withColumn("v", pivots.scaled("v")), "vec_id", "v", every=50, k=5).collect()
    assert {r.query_id for r in got} == {0}
    assert [r.vec_id for r in sorted(got, key=lambda r: r["rank"])] == [7, 6, 5, 4, 3]


def test_forest_passes_a_group_of_copies(spark):
    x = np.random.default_rng(7).standard_normal((2000, 64))
    x[100:108] = x[100]
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, v array<double>")
    got = forest.search(df, "vec_id", "v", k=10).where("query_id = 100").orderBy("rank").collect()
    assert [r.vec_id for r in got][:7] == list(range(101, 108)) and len(got) == 10


def test_pieces_of_a_long_word_take_linear_memory():
    import tracemalloc

    model = pieces.shared(queries.tokenizer_path("piece_bpe_32k.model"))
    rng = random.Random(8)
    text = "".join(rng.choice("日本語中文字漢学校人") for _ in range(20_000))
    model.encode([text[:3000]])
    tracemalloc.start()
    ids = np.frombuffer(model.encode([text])[0], "<u4")
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert model.decode(ids) == text and most < 50e6


def test_large_ids_beside_a_null_id(spark):
    big = 2**60 + 1
    rows = [(big, "one text"), (big + 1, "another text, quite different from that"), (None, "no id")]
    want = {big, big + 1, None}
    df = docs(spark, rows).coalesce(1)
    ids = lambda out, name="doc_id": {r[name] for r in out.select(name).collect()}
    assert ids(simhash.near_duplicates(df, "doc_id", "text")) == want
    assert ids(packing.pack(df, "doc_id", "text", queries.tokenizer_path("word_bpe_49k.json"))) == want
    path = queries.tokenizer_path("piece_bpe_32k.model")
    encoded = pieces.encode(df, "doc_id", "text", path)
    assert ids(encoded) == want and ids(pieces.decode(encoded, "doc_id", "ids", path)) == want
    assert ids(pieces.digests(encoded, path)) == want
    chats = df.withColumn("text", F.lit('{"prompt":"p","completion":"c"}'))
    formatted = chat.format_chats(chats, "doc_id", "text")
    assert ids(formatted, "conv_id") == want and ids(chat.digests(formatted), "conv_id") == want


@pytest.mark.parametrize("hot", [1, 40, suffixes.HOT])
def test_suffixes_of_a_passage_in_many_documents(spark, texts, hot):
    rng = random.Random(12)
    say = lambda n: " ".join(rng.choice(WORDS) + str(rng.randrange(400)) for _ in range(n))
    passage = say(20)
    rows = texts + [(1000 + i, say(6) + " " + passage + " " + say(6)) for i in range(120)] + [
        (2000, (passage + " ") * 5), (2001, say(4) + "x" * 300), (1000, passage + "y"), (None, passage + " " + say(3))]
    got = suffixes.repeated(docs(spark, rows).repartition(3), "doc_id", "text", hot=hot)
    assert sorted((tuple(r)[:5] for r in got.collect()), key=str) == brute_suffixes(rows)


def test_a_passage_in_many_documents_is_not_one_group(spark):
    rng = random.Random(13)
    say = lambda n: " ".join(rng.choice(WORDS) + str(rng.randrange(400)) for _ in range(n))
    passage = say(20)
    rows = [(i, say(6) + " " + passage + " " + say(6)) for i in range(400)]
    packs = suffixes.settle(suffixes.packed(docs(spark, rows).repartition(2), "doc_id", "text", []))
    runs = suffixes._entries(packs, suffixes._copies(packs), packs.count(), 4, hot=100)
    sizes = {}
    for r in runs.where("range < 4").collect():
        sizes[r.range] = sizes.get(r.range, 0) + len(r.docs) // 8
    assert sum(sizes.values()) < 400


def test_rows_without_an_id_spread_over_shards(spark, tmp_path):
    rows = [(None if i % 3 == 0 else i, f"text {i} " * 20) for i in range(3000)]
    docs(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op8_virtual_slots(spark, str(tmp_path)).groupBy("shard").agg(F.sum("size").alias("s"), F.count("*").alias("n")).collect()
    assert len(got) == 24 and sum(r.n for r in got) == 3000
    assert max(r.s for r in got) < 1.2 * min(r.s for r in got)


def test_pivots_exact_for_large_numbers(spark):
    """Products near the bounds of a double and of a long."""
    rng = np.random.default_rng(3)
    for top in (3e5, 2**27, 1e9, 3e9):
        x = np.floor(rng.uniform(-top, top, (120, 4)))
        x[:40] = x[0] + rng.integers(0, 3, (40, 4))
        df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, v array<double>")
        got = pivots.search(df, "vec_id", "v", every=20, k=5, pivots=3, sample=30, shard_rows=40, step=8).collect()
        whole = [[int(c) for c in v] for v in x]
        for q in range(0, 120, 20):
            scores = sorted((-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in enumerate(whole) if i != q)[:5]
            mine = [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q]
            assert mine == [(i, min(max(-s, -2**63), 2**63 - 1)) for s, i in scores]


def test_roles_of_the_own_layout_stay(spark):
    rows = spark.createDataFrame([(1, 0, "human", "q"), (1, 1, "gpt", "a"), (1, 2, "assistant", None), (2, 0, None, "x"), (2, 1, None, "x"),
                                  (3, None, "user", "late"), (3, 0, "assistant", "b")], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.digests(chat.format_chats(queries.chat_records(rows), "conv_id", "record")).collect()}
    sha = lambda *turns: hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
    assert got[1].turns_sha256 == sha(("human", "q"), ("gpt", "a"), ("assistant", "")) and got[1].loss_chars == 0
    assert got[2].turns_sha256 == sha(("", "x"), ("", "x")) and got[2].n_turns == 2
    assert got[3].n_turns == 2 and got[3].loss_chars == 1


def plain_hits(lexicon, text):
    """Sum of the best entry at each word, words inside exception phrases left out; by trying every place."""
    bounds = lambda a, b: not (a and text[a - 1].isalpha()) and (b == len(text) or not text[b].isalpha())
    free = [range(a, a + len(p)) for p in map(toxicity.fold, lexicon.exceptions) for a in range(len(text))
            if text.startswith(p, a) and bounds(a, a + len(p))]
    total = 0.0
    for a in range(len(text)):
        if a and text[a - 1].isalpha() or any(a in f for f in free):
            continue
        total += max([w for e, w in lexicon.words.items() if text.startswith(e, a) and bounds(a, a + len(e))]
                     + [w for e, w in lexicon.stems.items() if text.startswith(e, a)] + [0.0])
    return total


def test_lexicon_hits_against_every_place():
    rng = random.Random(6)
    lexicon = toxicity.Lexicon({"trash": 3.0, "clown": 2.0, "vile": 4.0}, {"tras": 1.0, "stup": 2.5}, ("trash can", "clown fish", "can stupid"))
    machine = lexicon.matcher()
    words = ["trash", "can", "clown", "fish", "stupid", "tr4sh", "vile", "x", "trashy", "стupid"]
    for _ in range(200):
        text = toxicity.fold(" ".join(rng.choices(words, k=rng.randrange(0, 14))))
        assert lexicon.hits(machine, text) == pytest.approx(plain_hits(lexicon, text))
    import time

    long = "trash can clown vile " * 100_000
    start = time.process_time()
    assert lexicon.hits(machine, long) == pytest.approx(600_000.0)
    assert time.process_time() - start < 20


def test_exceptions_are_learned(spark):
    rows = [(i, f"you are grublin today number {i}", 1) for i in range(30)] + [(100 + i, f"we ate grublin pie today at {i}", 0) for i in range(4)]
    rows += [(200 + i, f"a quiet day number {i}", 0) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    lexicon = toxicity.learn(df, "doc_id", "text", df, "toxic")
    assert "grublin" in lexicon.words and "grublin pie" in lexicon.exceptions and "are grublin" not in lexicon.exceptions
    score = {r.doc_id: r.toxicity for r in toxicity.score(df, "doc_id", "text", lexicon).collect()}
    assert score[0] > 0.5 > score[100] and score[200] < 0.5


def test_quality_scores_are_sums_of_tables(spark, texts):
    """Every score by walking edges and tables one value at a time; long, null, empty and repeated texts, no rows."""
    import bisect
    import math

    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice(WORDS) for _ in range(rng.randrange(3, 60))) + ("!!" * 9 if i % 4 == 0 else ".")) for i in range(200)]
    labels = spark.createDataFrame([(i, int(i % 4 != 0)) for i, _ in rows], "doc_id long, quality int")
    model = quality.learn(docs(spark, rows), "doc_id", "text", labels, "quality")
    probe = texts + [(900, "river stone " * 200_000), (901, "tied text"), (902, "tied text"), (901, "tied text")]
    got = quality.score(docs(spark, probe), "doc_id", "text", model).collect()

    def plain(text):
        bins = [bisect.bisect_right(list(e), v) for e, v in zip(model.edges, quality.features(text))]
        z = model.constant + sum(t[b] for t, b in zip(model.tables, bins))
        for (f, g), table in model.pairs.items():
            z += table[model.coarse[f][bins[f]]][model.coarse[g][bins[g]]]
        return 1 / (1 + math.exp(-z))

    want = sorted((str(i), round(plain(t), 9)) for i, t in probe)
    assert sorted((str(r.doc_id), round(r.quality, 9)) for r in got) == want
    assert quality.score(docs(spark, []), "doc_id", "text", model).count() == 0


def test_toxicity_scores_by_hand(spark, texts):
    """Every score from the plain count of hits; long, null, empty and repeated texts, no rows."""
    import math

    lexicon = toxicity.Lexicon({"vile": 3.0, "maple": 1.0}, {"rive": 0.5}, ("maple north",), (0.7, 1.1, -2.0))
    probe = texts + [(900, "vile river " * 60_000), (901, "V1LE maple north"), (902, "maple"), (902, "maple")]
    got = toxicity.score(docs(spark, probe), "doc_id", "text", lexicon).collect()

    def plain(text):
        folded = toxicity.fold(text)
        total = 60_000 * 3.5 if text and len(text) > 100_000 else plain_hits(lexicon, folded)
        a, b, c = lexicon.fit
        z = a * math.log1p(total) + b * math.log1p(100 * total / (folded.count(" ") + 1)) + c
        return 1 / (1 + math.exp(-z))

    assert sorted((str(r.doc_id), round(r.toxicity, 9)) for r in got) == sorted((str(i), round(plain(t), 9)) for i, t in probe)
    assert toxicity.score(docs(spark, []), "doc_id", "text", lexicon).count() == 0


def test_shards_by_their_contract(spark, texts, tmp_path):
    rows = texts + [(301, ""), (301, ""), (None, None), (None, None)]
    docs(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op8_virtual_slots(spark, str(tmp_path)).collect()
    size = lambda t: len((t or "").encode()) + 8
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in got), key=str) == sorted(
        ((i, size(t), zlib.crc32((t or "").encode())) for i, t in rows), key=str)
    slots = {}
    for r in got:
        assert 0 <= r.shard < 24 and r.law == "bytes" and r.grown_shard is None
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    docs(spark, []).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert queries.op8_virtual_slots(spark, str(tmp_path / "none")).count() == 0


def test_piece_digests_in_one_pass(spark, texts, tmp_path):
    path = queries.tokenizer_path("piece_bpe_32k.model")
    docs(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op9_shared_prefix_pieces(spark, str(tmp_path)).collect()
    two = pieces.digests(pieces.encode(docs(spark, texts), "doc_id", "text", path), path).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, two), key=str)
    assert sum(r.n_ids == 0 for r in got) == 2 and all(r.decoded_crc32 == zlib.crc32((dict(texts)[r.doc_id] or "").encode())
                                                       for r in got if r.doc_id not in (0, None))
    docs(spark, []).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert queries.op9_shared_prefix_pieces(spark, str(tmp_path / "none")).count() == 0
