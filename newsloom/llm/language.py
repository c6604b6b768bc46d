"""The language of a text, from bit-sliced filters of n-grams.

One Bloom filter per language, sliced by position: a position holds one bit per
language, so the AND of a few positions names all languages that hold an n-gram.  The
set bits of a text are counted per language, the share that the filter's fill lets
through by chance is taken off, and the largest corrected share decides.

A language holds the n-grams that are frequent in it, and not much more frequent in
another one.  All labelled texts are counted; what leaves the count is bounded:
``grams`` n-grams in all, because n-grams above a share of 1 / k are fewer than k.

Defined results: null texts and texts without a letter are ``und`` with score 0; a text
without any learned n-gram gets the most frequent language with score 0; ties go to
the smaller language; without learned languages all texts are ``und``; repeated rows
count each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick, settle

UNKNOWN = "und"
# Bytes of one n-gram; four of them are one 32-bit number.
SIZE = 4
# N-grams of all languages together.
GRAMS = 1 << 20
# A language is learned when it has at least this share of the labelled rows, so there are at most 4096.
LEAST_SHARE = 1 / 4096
# An n-gram belongs to every language that has it at least this often, against the language that has it most.
NEAR_BEST = 0.4
# Positions of a filter per n-gram, and positions that one n-gram sets.
ROOM, PROBES = 16, 4
# Bytes that are turned into n-grams at once, and distinct n-grams a task holds.
BLOCK, HELD = 1 << 21, 1 << 20

# Everything but ASCII letters and bytes of other characters separates words.
_WORDS = bytes(c if c >= 0x80 or 97 <= c <= 122 else 32 for c in range(256))


def normal(text: str) -> bytes:
    """Lower-cased words between single blanks, at least one n-gram long."""
    words = text.lower().encode("utf-8", "replace").translate(_WORDS).split()
    return (b" " + b" ".join(words) + b" ").ljust(SIZE)


def _pieces(texts) -> Iterator[tuple[list[int], list[bytes]]]:
    """Numbers of the texts and their normal bytes, in blocks of bounded size.

    A long text comes in pieces that overlap, so that every n-gram is in one of them.
    """
    rows, pieces, size = [], [], 0
    for row, text in enumerate(texts):
        data = normal(text) if text else b""
        for at in range(0, max(len(data) - SIZE + 1, 0), BLOCK):
            piece = data[at:at + BLOCK + SIZE - 1]
            rows.append(row)
            pieces.append(piece)
            size += len(piece)
            if size >= BLOCK:
                yield rows, pieces
                rows, pieces, size = [], [], 0
    if pieces:
        yield rows, pieces


def ngrams(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All n-grams of the pieces, and how many each piece has."""
    data = np.frombuffer(b"".join(pieces), np.uint8).astype(np.uint32)
    count = len(data) - SIZE + 1
    grams = data[:count].copy()
    for k in range(1, SIZE):
        grams |= data[k:k + count] << np.uint32(8 * k)
    lengths = np.array([len(p) for p in pieces])
    keep = np.ones(len(data), bool)
    keep[(np.cumsum(lengths)[:, None] - np.arange(1, SIZE)).ravel()] = False
    return grams[keep[:count]], lengths - SIZE + 1


def gram_counts(texts: DataFrame) -> DataFrame:
    """(lang, gram, n) over all rows of (text, lang): counted in the tasks, then added up."""
    def run(batches):
        import pyarrow as pa

        names: dict[str, int] = {}
        keys, counts = np.empty(0, np.uint64), np.empty(0, np.int64)

        def out():
            langs = pa.array(list(names), pa.string())
            return pa.RecordBatch.from_arrays([
                langs.take(pa.array((keys >> np.uint64(32)).astype(np.int64))),
                pa.array((keys & np.uint64(0xFFFFFFFF)).astype(np.int64)), pa.array(counts)], names=["lang", "gram", "n"])

        for batch in batches:
            codes = np.array([names.setdefault(x, len(names)) for x in batch.column(1).to_pylist()], np.uint64)
            for rows, pieces in _pieces(v.as_py() for v in batch.column(0)):
                grams, per = ngrams(pieces)
                found, n = np.unique(np.repeat(codes[rows] << np.uint64(32), per) | grams, return_counts=True)
                keys, where = np.unique(np.concatenate([keys, found]), return_inverse=True)
                counts = np.bincount(where, np.concatenate([counts, n]), len(keys)).astype(np.int64)
                if len(keys) > HELD:
                    yield out()
                    keys, counts = np.empty(0, np.uint64), np.empty(0, np.int64)
        if len(keys):
            yield out()

    parts = texts.select("text", "lang").mapInArrow(run, "lang string, gram long, n long")
    return parts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class Filters:
    """``slices[word, position]`` holds one bit per language; ``chance`` is the share of foreign
    n-grams that a language's filter lets through."""

    languages: list[str]
    usual: str
    slices: np.ndarray
    chance: np.ndarray

    def hits(self, grams: np.ndarray) -> np.ndarray:
        """Per word of languages and n-gram, the bits of all languages that hold it."""
        at = _positions(grams, self.slices.shape[1])
        found = self.slices[:, next(at)]
        for p in at:
            found &= self.slices[:, p]
        return found


def _positions(grams: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """The positions an n-gram sets: two halves of one mixed number, in steps."""
    x = grams.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    step, mask = x >> np.uint64(32) | np.uint64(1), np.uint64(size - 1)
    for _ in range(PROBES):
        yield (x & mask).astype(np.intp)
        x = x + step


def learn(docs: DataFrame, text: str, lang: str, grams: int = GRAMS) -> Filters:
    """Filters from all rows with a text and a language."""
    rows = pick(docs, text=text, lang=lang).where("text is not null and lang is not null")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().where(
        F.col("count") >= F.lit(rows.count() * LEAST_SHARE)).collect()}
    langs = sorted(sizes)
    if not langs:
        return Filters([], UNKNOWN, np.zeros((1, 1), np.uint64), np.zeros(0))
    named = docs.sparkSession.createDataFrame([(x, k) for k, x in enumerate(langs)], "lang string, code int")
    counts = settle(gram_counts(rows.join(F.broadcast(named), "lang", "left_semi")))
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    share = F.col("n") / F.col("total")
    known = counts.join(F.broadcast(named), "lang").join(F.broadcast(totals), "lang").select("gram", "code", share.alias("share"))
    # Languages that have the n-gram at all are a short list, at most one entry per language.
    best = known.groupBy("gram").agg(F.max("share").alias("best"))
    held = known.where(F.col("share") >= len(langs) / grams).join(best, "gram").where(
        F.col("share") >= F.col("best") * NEAR_BEST).select("gram", "code").toArrow()
    gram = held.column("gram").to_numpy().astype(np.uint32)
    code = held.column("code").to_numpy().astype(np.int64)
    each = np.bincount(code, minlength=len(langs))
    size = 1 << max(10, int(each.max(initial=1) * ROOM - 1).bit_length())
    slices = np.zeros((-(-len(langs) // 64), size), np.uint64)
    for p in _positions(gram, size):
        np.bitwise_or.at(slices, (code >> 6, p), np.uint64(1) << (code & 63).astype(np.uint64))
    fill = np.array([np.count_nonzero(slices[k >> 6] >> np.uint64(k & 63) & np.uint64(1)) / size for k in range(len(langs))])
    usual = min(langs, key=lambda x: (-sizes[x], x))
    return Filters(langs, usual, _narrow(slices, len(langs)), fill ** PROBES)


def _narrow(slices: np.ndarray, languages: int) -> np.ndarray:
    """The smallest words that hold a bit per language: they stay in a core's cache."""
    kind = next((k for k in (np.uint8, np.uint16, np.uint32) if languages <= np.dtype(k).itemsize * 8), np.uint64)
    return slices.astype(kind)


def shares(texts: list[str | None], model: Filters) -> np.ndarray:
    """Per text and language, the share of its n-grams in the language, without chance hits."""
    count = len(model.languages)
    hits, total = np.zeros((len(texts), count), np.int64), np.zeros(len(texts), np.int64)
    for rows, pieces in _pieces(texts):
        grams, per = ngrams(pieces)
        found, at = model.hits(grams), np.concatenate([[0], np.cumsum(per)[:-1]])
        total += np.bincount(rows, per, len(texts)).astype(np.int64)
        for k in range(count):
            bit = found[k >> 6] >> found.dtype.type(k & 63) & found.dtype.type(1)
            hits[:, k] += np.bincount(rows, np.add.reduceat(bit, at, dtype=np.int64), len(texts)).astype(np.int64)
    seen = hits / np.maximum(total, 1)[:, None]
    return np.clip((seen - model.chance) / (1 - model.chance), 0, 1)


def decide(texts: list[str | None], model: Filters) -> tuple[list[str], list[float]]:
    """Language and score per text; the score is the winner's part of all shares."""
    names, scores = [], []
    found = shares(texts, model) if model.languages else np.zeros((len(texts), 1))
    for text, row in zip(texts, found):
        if not model.languages or not text or not any(map(str.isalpha, text)):
            names.append(UNKNOWN)
            scores.append(0.0)
            continue
        total, k = row.sum(), int(row.argmax())
        names.append(model.languages[k] if total > 0 else model.usual)
        scores.append(float(row[k] / total) if total > 0 else 0.0)
    return names, scores


def predict(docs: DataFrame, id_: str, text: str, model: Filters) -> DataFrame:
    """(doc_id, lang_pred, score) per row."""
    @F.pandas_udf("lang_pred string, score double")
    def named(texts):
        import pandas as pd

        names, scores = decide([t if isinstance(t, str) else None for t in texts], model)
        return pd.DataFrame({"lang_pred": names, "score": scores})

    rows = pick(docs, doc_id=id_, text=text)
    return rows.select("doc_id", named("text").alias("p")).select("doc_id", "p.lang_pred", "p.score")
