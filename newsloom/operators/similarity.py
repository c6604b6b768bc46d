"""TF-IDF cosine between short texts.

Three exact forms: the best earlier text for every text (one idf for the whole
corpus), the same with an idf that moves with every arrival, and the top n for
given query texts.  None of them emits all pairs of a hot word as rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import fresh_path, settle, small_side
from . import joins, vectors

_EPS = 1e-9
# Cells (a text and a word) of a block, texts that one task asks for, and cells of those laid out at once.
BLOCK_CELLS = 4_000_000
ASK_ROWS = 131_072
TILE_CELLS = 1 << 18
# Blocks that a corpus is cut into at least, unless they would hold few rows.
BLOCKS = 8
FEW_ROWS = 50_000
# A word of a block is frequent when one in so many of its texts holds it; this share of the texts, those
# with the heaviest frequent words, is always scored in full.
OFTEN = 25
HEAVY = 0.02


def _directions(counts: DataFrame) -> DataFrame:
    """One row per text with terms: ``key`` is equal for proportional counts."""
    rows = counts.groupBy("id").agg(
        F.array_sort(F.collect_list(F.struct("term", "tf"))).alias("terms"), F.min("tf").alias("_m"))
    key = F.array_join(F.transform("terms", lambda e: F.concat(
        e["term"], F.lit("\t"), (e["tf"] / F.col("_m")).cast("string"))), "\n")
    return rows.select("id", "terms", key.alias("key"))


def _unit_rows(counts: DataFrame, texts: int, df: DataFrame, hot_share: int) -> DataFrame:
    """(id, terms, weights): words as numbers, weights of a text of length one.

    Words of a single text count for its length only: they add nothing to any score.
    """
    uses = counts.groupBy("term").agg(F.count("*").alias("uses")).join(df, "term")
    words = settle(uses.select("term", "uses", "df", F.monotonically_increasing_id().alias("no")))
    words = words.withColumn("shared", F.col("uses") > 1)
    rows = joins.lookup(counts, words, "term", "uses", counts.count(), hot_share)
    rows = rows.withColumn("w", F.col("tf") * vectors.smooth_idf(F.lit(float(texts)), F.col("df")))
    rows = rows.groupBy("id").agg(F.collect_list(F.when(F.col("shared"), F.struct("no", "w"))).alias("v"),
                                  F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return rows.where(F.size("v") > 0).select(
        "id", F.col("v.no").alias("terms"), F.transform("v", lambda e: e["w"] / F.col("norm")).alias("weights"))


def _nearest(vec: DataFrame, asking: DataFrame, n: int, earlier: bool, block_rows: int, ask_rows: int) -> DataFrame:
    """(i, j, score): for each of the ``asking`` ids of ``vec`` the n highest cosines.

    The texts are cut along their ids into blocks.  The posting lists of a block are written once, as a
    file below the shared folder, so neither postings nor pairs are joined or exchanged.  A task takes a
    slice of the asking texts through one block after the other (with ``earlier`` through those not after
    them) and holds one block at a time.  Exact, with no bound on a list, see ``_asked``.
    """
    spark = vec.sparkSession
    rows, cells = vec.agg(F.count("*"), F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()
    blocks = max(1, min(BLOCKS, -(-rows // FEW_ROWS)), -(-rows // block_rows), -(-cells // BLOCK_CELLS))
    path = fresh_path(spark, "postings")
    placed = joins.block_of(vec, "id", rows, "block", max(1, -(-rows // blocks)))
    kept = placed.groupBy("block").applyInArrow(_kept(path), "block int, low long").collect()
    files = [f"{path}/{r['block']}" for r in sorted(kept, key=lambda r: r["low"])]
    slices = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // ask_rows))
    # By a hash of the id: what lies by id already would be merged into few tasks by its bytes.
    asks = vec.join(asking, "id", "left_semi").repartition(slices, F.xxhash64("id"))
    return asks.mapInArrow(_answers(files, n, earlier, ask_rows), "i long, j long, score double")


def _flat(table):
    """Ids, numbers of cells, terms and weights of an Arrow table of unit rows, along the ids."""
    import numpy as np

    table = table.select(["id", "terms", "weights"]).sort_by("id").combine_chunks()
    flat = lambda c: table[c].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    sizes = table["terms"].combine_chunks().value_lengths().to_numpy(zero_copy_only=False)
    return table["id"].to_numpy(), sizes.astype(np.int64), flat("terms"), flat("weights")


def _kept(path: str):
    def keep(table):
        import uuid

        import numpy as np
        import pyarrow as pa
        from pyarrow import fs

        block = table["block"][0].as_py()
        store, root = fs.FileSystem.from_uri(path)
        store.create_dir(root)
        index = _index(*_flat(table))
        # A task that runs again replaces the file by an equal one.
        part = f"{root}/.{uuid.uuid4().hex}"
        with store.open_output_stream(part, compression=None) as out:
            np.savez(out, **index)
        store.move(part, f"{root}/{block}")
        return pa.table({"block": pa.array([block], pa.int32()), "low": pa.array([index["ids"].min()], pa.int64())})

    return keep


def _index(ids, sizes, terms, weights) -> dict:
    """Posting lists of a block as arrays.

    Texts are numbered by the length of their part of frequent words, longest first (``norm``), and a
    list holds these numbers upwards.  ``own`` says where the frequent words of a text begin in
    ``own_word`` and ``own_weight``.
    """
    import numpy as np

    row = np.repeat(np.arange(len(ids)), sizes)
    order = np.argsort(terms, kind="stable")
    new = np.diff(terms[order], prepend=terms[order[:1]] - 1) != 0
    col = np.empty(len(terms), np.int64)
    col[order] = np.cumsum(new) - 1
    words, uses = terms[order[new]], np.diff(np.append(np.flatnonzero(new), len(terms)))
    often = uses * OFTEN >= len(ids)
    cells = np.flatnonzero(often[col])
    norm = np.sqrt(np.bincount(row[cells], weights[cells] ** 2, len(ids)))
    by_norm = np.argsort(-norm, kind="stable")
    place = np.empty(len(ids), np.int64)
    place[by_norm] = np.arange(len(ids))
    row = place[row]
    cells = cells[np.argsort(row[cells], kind="stable")]
    order = np.lexsort((row, col))
    return {"ids": ids[by_norm], "norm": norm[by_norm], "words": words, "often": often,
            "at": np.append(0, np.cumsum(uses)), "rows": row[order], "weights": weights[order],
            "own": np.searchsorted(row[cells], np.arange(len(ids) + 1)),
            "own_word": (np.cumsum(often) - 1)[col[cells]], "own_weight": weights[cells]}


def _answers(files: list[str], n: int, earlier: bool, ask_rows: int):
    def answer(batches):
        import pyarrow as pa

        held, count = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                count += batch.num_rows
            if count >= ask_rows:
                yield told(pa.Table.from_batches(held))
                held, count = [], 0
        if held:
            yield told(pa.Table.from_batches(held))

    def told(table):
        import numpy as np
        import pyarrow as pa
        from pyarrow import fs

        asks = _flat(table)
        best = [[] for _ in asks[0]]
        for file in files:
            store, name = fs.FileSystem.from_uri(file)
            with store.open_input_file(name) as f, np.load(f) as block:
                index = {k: block[k] for k in block.files}
            _asked(index, *asks, n, earlier, best)
        out = _listed(asks[0], best)
        return pa.RecordBatch.from_arrays([pa.array(out[c]) for c in ("i", "j", "score")], ["i", "j", "score"])

    return answer


def _listed(asks, best) -> dict:
    import numpy as np

    found = [(j, score) for rows in best for _, j, score in rows]
    return {"i": np.repeat(asks, [len(rows) for rows in best]).astype(np.int64),
            "j": np.array([j for j, _ in found], np.int64), "score": np.array([s for _, s in found], float)}


def _tile(n: int, earlier: bool, most: int = TILE_CELLS):
    """The answers of one block to the asking texts, both as tables in memory."""
    def score(asking, held):
        import numpy as np
        import pandas as pd

        def flat(part):
            part = part.sort_values("id")
            cells = lambda c: np.concatenate(part[c].to_list()) if len(part) else np.zeros(0)
            return part["id"].to_numpy(), part["terms"].map(len).to_numpy(np.int64), cells("terms"), cells("weights")

        asks = flat(asking)
        best = [[] for _ in asks[0]]
        if len(asking) and len(held):
            _asked(_index(*flat(held)), *asks, n, earlier, best, most)
        return pd.DataFrame(_listed(asks[0], best))

    return score


def _asked(index: dict, asks, sizes, terms, weights, n: int, earlier: bool, best: list, most: int = TILE_CELLS) -> None:
    """Bring ``best``, per asking text its (-rounded score, id, score) so far, up to date with a block.

    ``asks`` ascend.  The lists of the rare words of a text are added up for it.  What its frequent words
    can add to a text of the block is at most the product of the lengths of both parts, so beside the texts
    that have enough already only those count whose part is long: a beginning of every list, as texts are
    numbered by it.  The texts left are scored in full.  ``most`` bounds the cells laid out at once.
    """
    import numpy as np

    low, high = index["ids"].min(), index["ids"].max()
    cells = np.append(0, np.cumsum(sizes))
    start = int(np.searchsorted(asks, low, "right")) if earlier else 0
    sums = np.zeros(len(index["ids"]))
    while start < len(asks):
        stop = max(start + 1, int(np.searchsorted(cells, cells[start] + most, "right")) - 1)
        a, b = cells[start], cells[stop]
        _ask_some(index, asks[start:stop], sizes[start:stop], terms[a:b], weights[a:b], n, earlier, best, start, low, high, sums)
        start = stop


def _ask_some(index, asks, sizes, terms, weights, n, earlier, best, first, low, high, sums) -> None:
    import numpy as np

    ids, norm, at, rows, held = (index[k] for k in ("ids", "norm", "at", "rows", "weights"))
    own, own_word, own_weight = (index[k] for k in ("own", "own_word", "own_weight"))
    down, all_, none = -norm, len(ids), np.zeros(0, np.int64)
    # Cells of the asking texts with a word of the block: lists of the rare and of the frequent ones.
    asker = np.repeat(np.arange(len(asks)), sizes)
    k = np.minimum(np.searchsorted(index["words"], terms), len(index["words"]) - 1)
    known = index["words"][k] == terms
    asker, k, w = asker[known], k[known], weights[known]
    often = index["often"][k]
    length = np.sqrt(np.bincount(asker[often], w[often] ** 2, len(asks))).tolist()

    def lists(part):
        cut = np.searchsorted(asker[part], np.arange(len(asks) + 1)).tolist()
        spans = list(zip(at[k[part]].tolist(), at[k[part] + 1].tolist(), w[part].tolist()))
        return [spans[a:b] for a, b in zip(cut, cut[1:])], cut

    (rare, _), (frequent, cut) = lists(~often), lists(often)
    word, word_w = (np.cumsum(index["often"]) - 1)[k[often]], w[often]
    dense = np.zeros(int(index["often"].sum()))

    def add(spans, whole, x):
        r = np.concatenate([rows[a:b] for a, b, _ in spans])
        v = np.concatenate([held[a:b] * c for a, b, c in spans])
        if not whole:
            some = np.flatnonzero(ids[r] < x if earlier else ids[r] != x)
            r, v = r[some], v[some]
        np.add.at(sums, r, v)
        return r

    def frequent_part(texts, q):
        """What the frequent words add for some texts."""
        out = np.zeros(len(texts))
        size = own[texts + 1] - own[texts]
        ends = np.cumsum(size)
        if cut[q] < cut[q + 1] and len(texts) and ends[-1]:
            mine = word[cut[q]:cut[q + 1]]
            dense[mine] = word_w[cut[q]:cut[q + 1]]
            take = np.arange(ends[-1]) + np.repeat(own[texts] - ends + size, size)
            np.add.at(out, np.repeat(np.arange(len(texts)), size), dense[own_word[take]] * own_weight[take])
            dense[mine] = 0.0
        return out

    for q, x in enumerate(asks.tolist()):
        whole = x > high if earlier else not low <= x <= high
        r, heavy = add(rare[q], whole, x) if rare[q] else none, none
        so_far, least, end = best[first + q], 0.0, 0
        # The n-th score so far, or that of n texts which the rare words place high, is a lower bound.
        if len(so_far) == n:
            least = so_far[-1][2]
        elif len(r):
            top = r[[sums[r].argmax()]] if n == 1 else np.array(
                list(dict.fromkeys(r[np.argsort(sums[r])[:-1000:-1]].tolist()))[:n])
            if len(top) == n:
                least = (sums[top] + frequent_part(top, q)).min()
        least -= 2 * _EPS
        if frequent[q]:
            end = all_ if least <= 0 else max(int(down.searchsorted(-least / length[q], "right")), int(all_ * HEAVY))
            spans = frequent[q] if end == all_ else [
                (a, a + int(rows[a:b].searchsorted(end)), c) for a, b, c in frequent[q]]
            heavy = add(spans, whole, x)
        near = heavy[np.flatnonzero(sums[heavy] >= least)]
        far = r[np.flatnonzero(sums[r] >= least - (length[q] * norm[end] if end < all_ else 0.0))]
        far = far[sums[far] + length[q] * norm[far] >= least]
        if len(near) or len(far):
            c = np.sort(np.concatenate([near, far]))
            c = c[np.flatnonzero(np.diff(c, prepend=-1))]
            score, beyond = sums[c], int(c.searchsorted(end))
            if beyond < len(c):
                score[beyond:] += frequent_part(c[beyond:], q)
            if len(c) > n:
                some = np.flatnonzero(score >= np.partition(score, -n)[-n] - 2 * _EPS)
                c, score = c[some], score[some]
            so_far = so_far + [(-round(s, 9), j, s) for s, j in zip(score.tolist(), ids[c].tolist()) if s > 0]
            so_far.sort()
            best[first + q] = so_far[:n]
        sums[r] = 0.0
        sums[heavy] = 0.0


def best_earlier(titles: DataFrame, id_: str, title: str,
                 block_rows: int = joins.BLOCK_ROWS, salt_rows: int = ASK_ROWS,
                 hot_share: int = joins.HOT_SHARE, counts: DataFrame | None = None,
                 df: DataFrame | None = None, asked_from: int = 0) -> DataFrame:
    """(id, match_id, score): for each text the earlier text with the highest cosine.

    Only texts from the id ``asked_from`` on ask; the ones before it are matches only.
    Where terms are known already, ``counts`` (id, term, tf) and ``df`` (term, df) of
    all texts are taken instead of cutting the texts.

    Equal scores go to the lowest id; texts that share no word with an earlier
    one get a null match and score 0.  The result is exact:

    * Texts with proportional word counts form one group.  All but the first
      score 1 with the first, so a group of copies of any size costs one
      lookup, and only the first text of each group is compared further.
    * The first texts are compared in tiles of blocks (``_nearest``), which
      form no pair as a row.
    """
    texts = titles.select(F.col(id_).alias("id"), F.col(title).alias("title"))
    counts = settle(vectors.term_counts(texts, "id", "title")) if counts is None else counts
    n_texts = texts.count()
    texts = texts.where(F.col("id") >= asked_from)
    rows = settle(_directions(counts))
    groups = rows.groupBy("key").agg(
        F.min(F.struct("id", "terms")).alias("first"), F.count("*").alias("copies"))
    groups = settle(groups.select("key", "first.id", "first.terms", "copies"))

    # Copies: everything but the first of a group.
    table = groups.where("copies > 1").select("key", F.col("id").alias("match_id"), "copies")
    asking = rows.where(F.col("id") >= asked_from).select("id", "key")
    copied = (joins.lookup(asking, table, "key", "copies", rows.count(), hot_share)
              .where("match_id < id")
              .select("id", "match_id", F.lit(1.0).alias("score")))

    # Vectors of the first texts; document frequencies count the copies too.
    firsts = groups.select("id", "copies", F.explode("terms").alias("e")).select(
        "id", "copies", "e.term", "e.tf")
    df = vectors.document_frequency(firsts, "copies") if df is None else df
    vec = settle(_unit_rows(firsts.drop("copies"), n_texts, df, hot_share))
    near = _nearest(vec, texts.select("id"), 1, True, block_rows, salt_rows)
    best = (near.groupBy(F.col("i").alias("id"))
            .agg(F.max(F.struct(F.round("score", 9).alias("r"), (-F.col("j")).alias("neg"),
                                "score")).alias("b"))
            .select("id", (-F.col("b.neg")).alias("match_id"), "b.score"))
    found = best.unionByName(copied)
    return (texts.select("id").join(found, "id", "left")
            .select("id", "match_id", F.coalesce("score", F.lit(0.0)).alias("score")))


def with_matched(best: DataFrame, table: DataFrame) -> DataFrame:
    """Add the columns of ``table`` (match_id, ...) to the rows of ``best`` that have a match, else nulls.

    Very many rows may name one match: such matches are answered by a bounded broadcast,
    and rows without a match are not joined at all.
    """
    best = settle(best)
    found, alone = best.where("match_id is not null"), best.where("match_id is null")
    uses = found.groupBy("match_id").agg(F.count("*").alias("_uses"))
    joined = joins.lookup(found, table.join(uses, "match_id"), "match_id", "_uses", found.count())
    more = [f for f in table.schema.fields if f.name != "match_id"]
    return joined.unionByName(alone.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in more]))


def verdict(best: DataFrame, titles: DataFrame, id_: str, title: str, threshold: float) -> DataFrame:
    """Add the rounded score, the matched text ('' when none) and the duplicate flag."""
    words = titles.select(F.col(id_).alias("match_id"), F.col(title).alias("similarity_with"))
    grade = F.round("score", 2)
    return with_matched(best, words).select(
        "id", "match_id", grade.alias("similarity"),
        F.coalesce("similarity_with", F.lit("")).alias("similarity_with"),
        (grade >= threshold).alias("is_duplicate"))


def similar_topn(corpus: DataFrame, queries: DataFrame, id_: str, title: str, n: int) -> DataFrame:
    """(query_id, rank, match_id, score): the n most similar other texts per query.

    ``queries`` are ids of the corpus.  The corpus is weighed once; candidates
    are ranked by a partial top n before anything is shuffled by query.  For few queries:
    every text that shares a word is scored; ``similar_topn_all`` is for many.
    """
    texts = corpus.select(F.col(id_).alias("id"), F.col(title).alias("title"))
    counts = settle(vectors.term_counts(texts, "id", "title"))
    vec = settle(vectors.weigh(counts, "id", texts.count(), vectors.document_frequency(counts)))
    x = vec.select("id", F.explode("vec").alias("e")).select("id", "e.term", "e.w")
    wanted = queries.select(F.col(id_).alias("id")).distinct()
    q = x.join(wanted, "id", "left_semi").select(
        F.col("id").alias("query_id"), "term", F.col("w").alias("wq"))
    hits = x.join(small_side(q), "term").where(F.col("id") != F.col("query_id"))
    scores = hits.groupBy("query_id", F.col("id").alias("match_id")).agg(
        F.sum(F.col("w") * F.col("wq")).alias("score"))
    rank = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "match_id")
    return (scores.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= n)
            .select("query_id", "rank", "match_id", "score"))


def similar_topn_all(corpus: DataFrame, queries: DataFrame, id_: str, title: str, n: int,
                     salt_rows: int = ASK_ROWS, hot_share: int = joins.HOT_SHARE) -> DataFrame:
    """(query_id, rank, match_id, score), as ``similar_topn`` gives it, for any number of queries.

    Exact.  Texts with proportional word counts form one group, of which only the first
    text is compared; the others share its answer.  The first texts are compared in tiles
    of blocks (``_nearest``), which form no pair as a row.
    """
    texts = corpus.select(F.col(id_).alias("id"), F.col(title).alias("title"))
    counts = settle(vectors.term_counts(texts, "id", "title"))
    rows = settle(_directions(counts))
    groups = settle(rows.groupBy("key").agg(
        F.min(F.struct("id", "terms")).alias("first"), F.count("*").alias("copies")).select(
            "key", "first.id", "first.terms", "copies"))
    asked = queries.select(F.col(id_).alias("id")).distinct()
    # The first members of a group are all of it that can be in an answer.
    line = Window.partitionBy("key").orderBy("id")
    members = rows.select("key", "id").withColumn("_r", F.row_number().over(line)).where(F.col("_r") <= n + 1)
    members = settle(members.groupBy("key").agg(F.array_sort(F.collect_list("id")).alias("members"))
                     .join(groups.select("key", F.col("id").alias("first"), "copies"), "key"))
    member_of = settle(joins.lookup(rows.select("id", "key").join(asked, "id", "left_semi"), members, "key", "copies",
                                    rows.count(), hot_share))
    firsts = groups.select("id", "copies", F.explode("terms").alias("e")).select("id", "copies", "e.term", "e.tf")
    vec = settle(_unit_rows(firsts.drop("copies"), texts.count(), vectors.document_frequency(firsts, "copies"), hot_share))
    near = _nearest(vec, member_of.select(F.col("first").alias("id")).distinct(), n, False, joins.BLOCK_ROWS, salt_rows)
    best = Window.partitionBy("i").orderBy(F.desc(F.round("score", 9)), "j")
    scored = near.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= n)
    # Groups become their members again, and every member of an asking group gets the answer.
    near = scored.join(members.select(F.col("first").alias("j"), "members"), "j").groupBy("i").agg(
        F.collect_list(F.struct("score", "members")).alias("near"))
    weight = member_of.groupBy(F.col("first").alias("i")).agg(F.count("*").alias("_uses"))
    answers = weight.join(near, "i", "left")
    full = joins.lookup(member_of.select("id", "members", F.col("first").alias("i")), answers, "i", "_uses",
                        max(member_of.count(), 1), hot_share)
    none = F.array().cast("array<struct<score:double,id:bigint>>")
    own = F.transform(F.filter("members", lambda m: m != F.col("id")), lambda m: F.struct(
        F.lit(1.0).alias("score"), m.cast("long").alias("id")))
    others = F.flatten(F.transform("near", lambda g: F.transform(g["members"], lambda m: F.struct(
        g["score"].alias("score"), m.cast("long").alias("id")))))
    ranked = F.slice(F.array_sort(F.transform(F.concat(own, F.coalesce(others, none)), lambda e: F.struct(
        (-F.round(e["score"], 9)).alias("down"), e["id"].alias("id"), e["score"].alias("score")))), 1, n)
    return full.select(F.col("id").alias("query_id"), F.posexplode(ranked).alias("p", "e")).select(
        "query_id", (F.col("p") + 1).alias("rank"), F.col("e.id").alias("match_id"), "e.score")


def best_recent(titles: DataFrame, id_: str, title: str, window: int,
                block_rows: int = joins.BLOCK_ROWS) -> DataFrame:
    """(id, match_id, score) against the previous ``window`` texts, with the idf
    of the moment each text arrived.

    Document frequencies up to each arrival are a two-level running count.  A
    text and its candidates lie in two neighbouring blocks of ``window`` texts,
    so each task works on groups of at most ``2 * window`` texts.
    """
    texts = titles.select(F.col(id_).alias("id"), F.col(title).alias("title"))
    n = texts.count()
    placed = settle(joins.positions(texts, "id", "pos", n, block_rows))
    counts = settle(vectors.term_counts(placed, "id", "title"))
    counts = counts.join(placed.select("id", "pos"), "id")
    seen = joins.running(counts, "term", "pos", F.lit(1).cast("long"), "sum", "before", n, block_rows)
    block = F.floor(F.col("pos") / window)
    spread = seen.select(
        "id", "pos", "term", "tf", F.coalesce("before", F.lit(0)).cast("long").alias("before"),
        F.explode(F.array(block, block + 1)).alias("block"))
    best = spread.groupBy("block").applyInPandas(
        _recent_scores(window), "id long, match_id long, score double")
    return (texts.select("id").join(best, "id", "left")
            .select("id", "match_id", F.coalesce("score", F.lit(0.0)).alias("score")))


def _recent_scores(window: int):
    def score(key, pdf):
        import numpy as np
        import pandas as pd

        pos, row = np.unique(pdf["pos"].to_numpy(), return_inverse=True)
        _, col = np.unique(pdf["term"].to_numpy(dtype=object).astype(str), return_inverse=True)
        order = np.lexsort((col, row))
        row, col, tf = row[order], col[order], pdf["tf"].to_numpy(float)[order]
        at = np.searchsorted(row, np.arange(len(pos) + 1))
        ids = pdf["id"].to_numpy()[order][at[:-1]]
        df = np.full(col.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(df, col, pdf["before"].to_numpy()[order])
        query, out = np.zeros(len(df)), []
        for i in range(len(pos)):
            own = slice(at[i], at[i + 1])
            df[col[own]] += 1
            first = np.searchsorted(pos, pos[i] - window)
            if pos[i] // window != key[0] or first == i:
                continue
            held = slice(at[first], at[i])
            weight = lambda e: tf[e] * (np.log((2.0 + pos[i]) / (1.0 + df[col[e]])) + 1.0)
            mine, theirs, where = weight(own), weight(held), row[held] - first
            query[col[own]] = mine
            dots = np.bincount(where, theirs * query[col[held]], i - first)
            query[col[own]] = 0.0
            cos = dots / np.sqrt(np.bincount(where, theirs * theirs, i - first) * (mine @ mine))
            best = int(np.argmax(np.round(cos, 9)))
            if dots[best] > 0:
                out.append((ids[i], ids[first + best], cos[best]))
        return pd.DataFrame(out, columns=["id", "match_id", "score"])

    return score


def best_in_buffer(titles: DataFrame, id_: str, title: str, size: int,
                   block_rows: int = joins.BLOCK_ROWS) -> DataFrame:
    """(id, match_id, score) inside a shift register of ``size`` + 1 texts.

    The model is fitted on the register alone.  Every text is handed to the
    ``size`` + 1 registers that hold it; one exchange by register does the rest.
    """
    texts = titles.select(F.col(id_).alias("id"), F.col(title).alias("title"))
    n = texts.count()
    placed = settle(joins.positions(texts, "id", "pos", n, block_rows))
    counts = vectors.term_counts(placed, "id", "title").join(placed.select("id", "pos"), "id")
    held = counts.select("id", "pos", "term", "tf", F.explode(F.sequence(
        F.col("pos"), F.least(F.col("pos") + size, F.lit(n - 1)))).alias("win")).repartition("win")
    shared = Window.partitionBy("win", "term")
    idf = vectors.smooth_idf(F.lit(float(size + 1)), F.count("*").over(shared))
    weighed = held.withColumn("w", F.col("tf") * idf)
    newest = F.max(F.when(F.col("pos") == F.col("win"), F.col("w"))).over(shared)
    weighed = weighed.withColumn("q", F.coalesce(newest, F.lit(0.0)))
    sums = weighed.groupBy("win", "id", "pos").agg(
        F.sum(F.col("w") * F.col("q")).alias("dot"), F.sum(F.col("w") * F.col("w")).alias("sq"))
    own = F.max(F.when(F.col("pos") == F.col("win"), F.struct("sq", "id"))).over(
        Window.partitionBy("win"))
    cos = F.col("dot") / F.sqrt(F.col("sq") * F.col("own.sq"))
    best = (sums.withColumn("own", own).where((F.col("pos") < F.col("win")) & (F.col("dot") > 0))
            .select("win", F.col("own.id").alias("new_id"), F.col("id").alias("old_id"), cos.alias("score"))
            .groupBy("win", "new_id")
            .agg(F.max(F.struct(F.round("score", 9).alias("r"), (-F.col("old_id")).alias("neg"),
                                "score")).alias("b")))
    best = best.select(F.col("new_id").alias("id"), (-F.col("b.neg")).alias("match_id"), "b.score")
    return (texts.select("id").join(best, "id", "left")
            .select("id", "match_id", F.coalesce("score", F.lit(0.0)).alias("score")))


def buffer_contents(titles: DataFrame, id_: str, title: str, size: int,
                    block_rows: int = joins.BLOCK_ROWS) -> DataFrame:
    """(id, slot, text): what the shift register holds after each arrival, slot 0 newest."""
    texts = titles.select(F.col(id_).alias("id"), F.lower(title).alias("text"))
    n = texts.count()
    placed = settle(joins.positions(texts, "id", "pos", n, block_rows))
    held = placed.select("text", "pos", F.explode(F.sequence(
        F.col("pos"), F.least(F.col("pos") + size, F.lit(n - 1)))).alias("win"))
    newest = placed.select("id", F.col("pos").alias("win"))
    return held.join(newest, "win").select(
        "id", (F.col("win") - F.col("pos")).cast("int").alias("slot"), "text")
