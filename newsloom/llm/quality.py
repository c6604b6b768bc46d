"""Quality by a generalised additive model with pairwise interactions.

Shallow trees on one binned feature at a time, in cycles, add up to a lookup table
per feature; the pairs that explain most of what is left get two-way tables.  A
score is a sum of table entries.
"""

from __future__ import annotations

import string
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick, ship
from .learning import sample, sigmoid

SAMPLE_ROWS = 20_000
NAMES = ("chars", "words", "word_length", "distinct", "repeated_next", "top_word", "packed", "lines",
         "distinct_lines", "line_words", "sentence_words", "upper", "lower", "digits", "marks", "stops",
         "pipes", "shouts", "other_marks", "blanks", "non_ascii", "capital_words", "marked_words")
_CLASSES = {
    "upper": string.ascii_uppercase, "lower": string.ascii_lowercase, "digits": string.digits,
    "marks": string.punctuation, "stops": ".,;:", "pipes": "|<>{}[]\\/", "shouts": "!?",
    "other_marks": "#$%&*+=@^_~", "blanks": string.whitespace,
}
_DROP = {k: v.encode() for k, v in _CLASSES.items()}
_ASCII = bytes(range(128))


def features(text: str | None) -> list[float]:
    """The numbers of NAMES for one whole text; an empty text has zeros."""
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    words, n = text.split(), len(data)
    if not words:
        return [float(n)] + [0.0] * (len(NAMES) - 1)
    count = Counter(words)
    lines = [x for x in text.split("\n") if x]
    share = {k: (n - len(data.translate(None, drop))) / n for k, drop in _DROP.items()}
    m = len(words)
    return [
        np.log1p(n), np.log1p(m), sum(map(len, count)) / len(count), len(count) / m,
        sum(map(eq, words, words[1:])) / m, max(count.values()) / m, len(zlib.compress(data, 1)) / n,
        np.log1p(len(lines)), len(set(lines)) / max(1, len(lines)), m / max(1, len(lines)),
        m / (1 + data.count(b".")), *(share[k] for k in _CLASSES),
        len(data.translate(None, _ASCII)) / n,
        sum(c for w, c in count.items() if w.isupper() and len(w) > 1) / m,
        sum(c for w, c in count.items() if not w[-1].isalpha()) / m,
    ]


def measured(rows: DataFrame, keep: dict[str, str]) -> DataFrame:
    """One row per text of ``rows`` (text, *keep): the features as an array."""
    schema = ", ".join([*(f"{c} {t}" for c, t in keep.items()), "features array<double>"])

    def run(frames):
        for pdf in frames:
            out = pdf[list(keep)].astype({c: "Int64" for c, t in keep.items() if t == "long"})
            yield out.assign(features=[features(t) for t in pdf["text"]])

    return rows.select("text", *keep).mapInPandas(run, schema)


@dataclass
class Additive:
    """Bin edges per feature, a table per feature and per pair, and a constant."""

    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)
    coarse: list[np.ndarray] = field(default_factory=list)
    constant: float = 0.0

    def margin(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.constant)
        if not self.tables:
            return z
        bins = [np.searchsorted(e, x[:, f], "right") for f, e in enumerate(self.edges)]
        for b, table in zip(bins, self.tables):
            z += table[b]
        for (f, g), table in self.pairs.items():
            z += table[self.coarse[f][bins[f]], self.coarse[g][bins[g]]]
        return z


def _tree(grad: np.ndarray, hess: np.ndarray, leaves: int, l2: float = 1.0, least: float = 2.0) -> np.ndarray:
    """Values per bin of the best tree with so many leaves on binned gradients."""
    def value(g, h):
        return g / (h + l2)

    cuts, out = [(0, len(grad))], np.zeros(len(grad))
    cg, ch = np.append(0, np.cumsum(grad)), np.append(0, np.cumsum(hess))
    for _ in range(leaves - 1):
        best = None
        for a, b in cuts:
            if b - a < 2:
                continue
            k = np.arange(a + 1, b)
            gl, hl = cg[k] - cg[a], ch[k] - ch[a]
            gr, hr = cg[b] - cg[k], ch[b] - ch[k]
            gain = gl * value(gl, hl) + gr * value(gr, hr)
            gain -= (cg[b] - cg[a]) * value(cg[b] - cg[a], ch[b] - ch[a])
            gain[(hl < least) | (hr < least)] = -1
            i = int(np.argmax(gain))
            if gain[i] > 1e-9 and (best is None or gain[i] > best[0]):
                best = (gain[i], (a, b), int(k[i]))
        if best is None:
            break
        cuts.remove(best[1])
        cuts += [(best[1][0], best[2]), (best[2], best[1][1])]
    for a, b in cuts:
        out[a:b] = value(cg[b] - cg[a], ch[b] - ch[a])
    return out


def _corner(grad: np.ndarray, hess: np.ndarray, l2: float = 1.0, least: float = 2.0) -> tuple[float, np.ndarray]:
    """Gain and table of the best tree that cuts both features once (four leaves)."""
    g, h = np.cumsum(np.cumsum(grad, 0), 1), np.cumsum(np.cumsum(hess, 0), 1)
    parts = []
    for c in (g, h):
        a = c[:-1, :-1]
        parts.append((a, c[:-1, -1:] - a, c[-1:, :-1] - a, c[-1, -1] - c[:-1, -1:] - c[-1:, :-1] + a))
    gain = sum(np.where(hh >= least, gg ** 2 / (hh + l2), 0) for gg, hh in zip(*parts))
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    table = np.zeros_like(grad)
    for k, where in enumerate(((slice(None, i + 1), slice(None, j + 1)), (slice(None, i + 1), slice(j + 1, None)),
                               (slice(i + 1, None), slice(None, j + 1)), (slice(i + 1, None), slice(j + 1, None)))):
        gg, hh = float(parts[0][k][i, j]), float(parts[1][k][i, j])
        table[where] = gg / (hh + l2) if hh >= least else 0.0
    return float(gain[i, j]), table


def fit(x: np.ndarray, y: np.ndarray, bins: int = 48, coarse: int = 12, rounds: int = 150, rate: float = 0.1,
        leaves: int = 3, pairs: int = 8) -> Additive:
    """Cyclic boosting on one bounded sample; a sample of one class gives a constant."""
    mean = (y.sum() + 1.0) / (len(y) + 2.0)
    model = Additive(constant=float(np.log(mean / (1 - mean))))
    if len(y) < 10 or y.min() == y.max():
        return model
    model.edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    own = [np.searchsorted(e, c, "right") for e, c in zip(model.edges, x.T)]
    size = [len(e) + 1 for e in model.edges]
    model.tables = [np.zeros(s) for s in size]
    model.coarse = [np.minimum(np.arange(s) * coarse // s, coarse - 1) for s in size]
    z = np.full(len(y), model.constant)
    for _ in range(rounds):
        for f, b in enumerate(own):
            p = sigmoid(z)
            step = rate * _tree(np.bincount(b, y - p, size[f]), np.bincount(b, p * (1 - p), size[f]), leaves)
            model.tables[f] += step
            z += step[b]

    def square(f, g, p):
        at = model.coarse[f][own[f]] * coarse + model.coarse[g][own[g]]
        shape = (coarse, coarse)
        return at, (np.bincount(at, y - p, coarse ** 2).reshape(shape),
                    np.bincount(at, p * (1 - p), coarse ** 2).reshape(shape))

    p = sigmoid(z)
    gains = {(f, g): _corner(*square(f, g, p)[1])[0] for f, g in combinations(range(len(own)), 2)}
    for pair in sorted(gains, key=gains.get, reverse=True)[:pairs]:
        model.pairs[pair] = np.zeros((coarse, coarse))
    for _ in range(rounds // 3):
        for (f, g), table in model.pairs.items():
            at, sums = square(f, g, sigmoid(z))
            step = rate * _corner(*sums)[1]
            table += step
            z += step.ravel()[at]
    return model


def learn(docs: DataFrame, id_: str, text: str, labels: DataFrame, label: str,
          sample_rows: int = SAMPLE_ROWS) -> Additive:
    """Fit on at most ``sample_rows`` labelled documents; their features come to the driver."""
    rows = sample(docs, id_, text, labels, label, sample_rows)
    got = measured(rows, {"y": "int"}).collect()
    x = np.array([r["features"] for r in got], float).reshape(-1, len(NAMES))
    return fit(x, np.array([r["y"] > 0 for r in got], float))


def with_score(docs: DataFrame, text: str, model: Additive, out: str = "quality") -> DataFrame:
    """Add the score of every whole text; null texts are scored as empty ones."""
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            x = np.array([features(t) for t in texts], float).reshape(-1, len(NAMES))
            yield pd.Series(sigmoid(model.margin(x)))

    ship(docs.sparkSession)
    return docs.withColumn(out, F.pandas_udf(run, "double")(docs[text]))


def score(docs: DataFrame, id_: str, text: str, model: Additive) -> DataFrame:
    """(doc_id, quality) of every row: repeated rows and ids give as many rows, equal texts equal scores."""
    return with_score(pick(docs, doc_id=id_, text=text), "text", model).drop("text")
