"""Toxicity from a weighted lexicon, matched by Aho-Corasick on folded text.

Folding undoes accents, look-alike letters of other scripts, and digits or signs
that stand for letters.  Entries are whole words or beginnings of words; matches
inside an exception phrase do not count.  The sum of weights, as such and against
the length of the text, gives the score.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick, settle, ship
from .learning import logistic, sample, sigmoid

SAMPLE_ROWS = 20_000
# Letters that look like a Latin one: the Cyrillic and Greek look-alikes and the dotless i.
LOOK_ALIKES = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t",
    "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ɡ": "g", "ո": "n", "ⅼ": "l",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t",
    "υ": "u", "χ": "x", "ı": "i",
}
STAND_INS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g",
             "@": "a", "$": "s", "!": "i", "|": "l"}
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "clown fish", "clown nose", "circus clown")
PREFIXES = (4, 5, 6)


def _fold_table() -> dict[int, str]:
    table = {}
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00), *range(0xFF01, 0xFF5F), *range(0x300, 0x370),
                 *range(0x200B, 0x2010)]:
        plain = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c))
        table[code] = plain.lower() if unicodedata.category(chr(code)) != "Cf" else ""
    return table | {ord(a): b for a, b in LOOK_ALIKES.items()}


_TABLE = _fold_table()
_SIGNED = re.compile(r"[^\s.,;:?]*[0-9@$!|][^\s,;:?]*")
_WORD = re.compile(r"[^\W\d_]+")
_STANDS = str.maketrans(STAND_INS)


def _spell(match: re.Match) -> str:
    """Signs inside a word become letters; numbers and closing marks stay."""
    token = match.group()
    body = token.rstrip("!|")
    if not any(c.isalpha() for c in body) or not any(c in STAND_INS for c in body):
        return token
    return body.translate(_STANDS) + token[len(body):]


def fold(text: str | None) -> str:
    text = (text or "").lower()
    if not text.isascii():
        text = text.translate(_TABLE)
    return _SIGNED.sub(_spell, text)


@dataclass
class Lexicon:
    """``words`` match whole words, ``stems`` beginnings; ``fit`` weighs sum, density, one."""

    words: dict[str, float]
    stems: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    fit: tuple[float, float, float] = (1.0, 1.0, -2.0)

    def matcher(self):
        import ahocorasick

        machine = ahocorasick.Automaton()
        for entry in {*self.words, *self.stems}:
            machine.add_word(entry, ("entry", len(entry), self.words.get(entry, 0.0), self.stems.get(entry, 0.0)))
        for phrase in map(fold, self.exceptions):
            machine.add_word(phrase, ("except", len(phrase), 0.0, 0.0))
        machine.make_automaton()
        return machine

    def hits(self, machine, text: str) -> float:
        """Sum of weights: the best entry of each word, without those an exception covers."""
        if not len(machine):
            return 0.0
        found, free = {}, []
        for end, (kind, size, word, stem) in machine.iter(text):
            start, end = end - size + 1, end + 1
            if start and text[start - 1].isalpha():
                continue
            closed = end == len(text) or not text[end].isalpha()
            if kind == "except":
                if closed:
                    free.append((start, end))
                continue
            weight = max(word if closed else 0.0, stem)
            if weight > found.get(start, 0.0):
                found[start] = weight
        if not free:
            return sum(found.values())
        # One sweep: the furthest end of the exceptions that begin before a word covers it or none does.
        free.sort()
        total, reach, k = 0.0, 0, 0
        for at in sorted(found):
            while k < len(free) and free[k][0] <= at:
                reach, k = max(reach, free[k][1]), k + 1
            total += found[at] if at >= reach else 0.0
        return total


def _entries(text: str) -> set[str]:
    """What a text may teach: its words ("=word") and their beginnings ("^begin")."""
    words = {w for w in _WORD.findall(text) if len(w) > 2}
    return {"=" + w for w in words} | {"^" + w[:k] for w in words for k in PREFIXES if len(w) > k}


def _features(total: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Weight found, and weight per hundred words."""
    return np.column_stack([np.log1p(total), np.log1p(100.0 * total / np.maximum(words, 1))])


def _lexicon(counts: dict[str, np.ndarray], docs: np.ndarray, least: int, floor: float) -> Lexicon:
    words, stems = {}, {}
    for entry, (clean, toxic) in counts.items():
        if toxic < least:
            continue
        weight = np.log((toxic + 0.5) / (docs[1] + 1)) - np.log((clean + 0.5) / (docs[0] + 1))
        if weight >= floor:
            (words if entry[0] == "=" else stems)[entry[1:]] = float(weight)
    return Lexicon(words, stems)


def _exceptions(rows: DataFrame, lexicon: Lexicon, docs: np.ndarray, least: int) -> list[str]:
    """Neighbouring words, one of them an entry, that belong to clean documents."""
    def count(frames):
        seen = (Counter(), Counter())
        for pdf in frames:
            for t, y in zip(pdf["text"], pdf["y"]):
                seen[int(y > 0)].update(_pairs(fold(t), lexicon))
        for y, c in enumerate(seen):
            if c:
                yield pd.DataFrame({"y": y, "phrase": list(c), "n": list(c.values())})

    sums = rows.select("text", "y").mapInPandas(count, "y int, phrase string, n long").groupBy("phrase").agg(
        F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("clean"),
        F.sum(F.when(F.col("y") > 0, F.col("n")).otherwise(0)).alias("toxic"))
    weight = F.log((F.col("toxic") + 0.5) / (docs[1] + 1)) - F.log((F.col("clean") + 0.5) / (docs[0] + 1))
    return sorted(r["phrase"] for r in sums.where((F.col("clean") >= least) & (weight < 0)).collect())


def _pairs(text: str, lexicon: Lexicon) -> set[str]:
    """Pairs of words next to each other, with one blank between, that hold an entry."""
    heavy = lambda w: w in lexicon.words or any(w[:k] in lexicon.stems for k in PREFIXES if len(w) > k)
    found, last = set(), None
    for m in _WORD.finditer(text):
        own = (m.group(), m.end(), heavy(m.group()))
        if last and (last[2] or own[2]) and text[last[1]:m.start()] == " ":
            found.add(f"{last[0]} {own[0]}")
        last = own
    return found


def learn(docs: DataFrame, id_: str, text: str, labels: DataFrame, label: str,
          sample_rows: int = SAMPLE_ROWS, least: int = 3, floor: float = 2.5) -> Lexicon:
    """Fit on at most ``sample_rows`` labelled documents, equal texts counted once.

    Entry weights are log ratios of document frequencies.  The final weighing is
    fitted on documents scored by a lexicon of the other half of the sample.  Only
    entries that are heavy enough for one of the three lexicons reach the driver.

    Exceptions are the given phrases and what the sample teaches: pairs of words with an
    entry in them that at least ``least`` clean documents hold and toxic ones hardly do.
    """
    # Of equal texts the smallest id counts, so that learning again gives the same lexicon.
    rows = sample(docs, id_, text, labels, label, sample_rows).groupBy("text").agg(
        F.min(F.struct("doc_id", "y")).alias("r")).select("r.doc_id", "text", "r.y")
    rows = rows.withColumn("half", F.pmod(F.xxhash64("doc_id"), F.lit(2)).cast("int"))

    def count(frames):
        seen: dict[tuple[int, int], Counter] = {}
        for pdf in frames:
            for t, y, half in zip(pdf["text"], pdf["y"], pdf["half"]):
                seen.setdefault((int(half), int(y > 0)), Counter()).update({*_entries(fold(t)), ""})
        for (half, y), c in seen.items():
            yield pd.DataFrame({"half": half, "y": y, "entry": list(c), "n": list(c.values())})

    sums = rows.select("text", "y", "half").mapInPandas(count, "half int, y int, entry string, n long")
    cell = lambda half, y: F.sum(F.when((F.col("half") == half) & (F.col("y") == y), F.col("n")).otherwise(0))
    table = sums.groupBy("entry").agg(cell(0, 0).alias("c0"), cell(0, 1).alias("t0"),
                                      cell(1, 0).alias("c1"), cell(1, 1).alias("t1"))
    table = settle(table)
    sizes = table.where("entry = ''").first()
    size = np.array([[sizes["c0"], sizes["t0"]], [sizes["c1"], sizes["t1"]]], float) if sizes else np.zeros((2, 2))

    def heavy(toxic, clean, docs, fewest):
        weight = F.log((toxic + 0.5) / (docs[1] + 1)) - F.log((clean + 0.5) / (docs[0] + 1))
        return (toxic >= fewest) & (weight >= floor - 1e-9)

    c0, t0, c1, t1 = (F.col(c) for c in ("c0", "t0", "c1", "t1"))
    # Entries of mostly clean documents are no lexicon's, however few toxic documents there are.
    some = (c0 + c1 <= 2 * (t0 + t1)) & (heavy(t0, c0, size[0], max(2, least - 1)) | heavy(t1, c1, size[1], max(2, least - 1))
            | heavy(t0 + t1, c0 + c1, size.sum(axis=0), least))
    got = {r["entry"]: np.array([[r["c0"], r["t0"]], [r["c1"], r["t1"]]], float)
           for r in table.where((F.col("entry") != "") & some).collect()}
    if not got or not size.sum(axis=0).all():
        return Lexicon({}, {}, fit=(0.0, 0.0, -3.0))
    half = [_lexicon({e: c[k] for e, c in got.items()}, size[k], max(2, least - 1), floor) for k in (0, 1)]
    full = _lexicon({e: c.sum(axis=0) for e, c in got.items()}, size.sum(axis=0), least, floor)

    learned = _exceptions(rows, full, size.sum(axis=0), least)
    for lexicon in (full, *half):
        lexicon.exceptions = (*EXCEPTIONS, *learned)

    def measure(frames):
        machines = [h.matcher() for h in half]
        for pdf in frames:
            folded = [fold(t) for t in pdf.pop("text")]
            pdf["total"] = [half[1 - k].hits(machines[1 - k], t) for k, t in zip(pdf["half"], folded)]
            pdf["words"] = [float(t.count(" ") + 1) for t in folded]
            yield pdf[["total", "words", "y"]]

    got = rows.select("text", "y", "half").mapInPandas(measure, "total double, words double, y int").collect()
    total, words, y = (np.array([r[k] for r in got], float) for k in range(3))
    full.fit = tuple(logistic(_features(total, words), (y > 0).astype(float)))
    return full


def with_score(docs: DataFrame, text: str, lexicon: Lexicon, out: str = "toxicity") -> DataFrame:
    """Add the score of every whole text; null and empty texts score like a text without a match."""
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        machine = lexicon.matcher()
        for texts in batches:
            folded = [fold(t) for t in texts]
            total = np.array([lexicon.hits(machine, t) for t in folded], float)
            words = np.array([t.count(" ") + 1 for t in folded], float)
            z = _features(total, words) @ np.array(lexicon.fit[:2]) + lexicon.fit[2]
            yield pd.Series(sigmoid(z))

    ship(docs.sparkSession)
    return docs.withColumn(out, F.pandas_udf(run, "double")(docs[text]))


def score(docs: DataFrame, id_: str, text: str, lexicon: Lexicon) -> DataFrame:
    """(doc_id, toxicity) of every row: repeated rows and ids give as many rows, equal texts equal scores."""
    return with_score(pick(docs, doc_id=id_, text=text), "text", lexicon).drop("text")
