"""Languages and counted words of whole texts, a batch of texts at a time in the Python workers.

The same as ``text.tokens`` and the columns built on it, for whole texts: a lambda over an array
column costs microseconds a word, a pass over the words here a tenth of that.  Word characters are
those of Python's Unicode version, which may know a few more than Java's.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon, text

TOKEN = re.compile(r"\w+|[^\w\s]+")
COUNTED = "array<struct<value:string,first:int,n:bigint>>"
# Texts whose words are held as Python values at once.
STEP = 256


class _Plain(dict):
    """What a character folds to, but for its case; line ends stay."""

    def __missing__(self, code: int):
        self[code] = code if code == 10 or chr(code).isalnum() else None
        return self[code]


_PLAIN = _Plain(str.maketrans(dict(text._ACCENTED) | dict(text._LIGATURES)))


def fold(lines: str) -> str:
    """Letters and digits only, no accents, lower case: ``text.fold`` of the words of some lines."""
    return lines.translate(_PLAIN).lower()


def best_language(body: Column, languages=lexicon.LANGUAGES) -> Column:
    """First language with the most distinct words in its stop list; null when there is none."""
    languages = tuple(languages)

    def told(bodies):
        import pyarrow as pa

        listed: dict[str, list[int]] = {}
        for place, name in enumerate(languages):
            for word in set(lexicon.base_words(name)):
                listed.setdefault(word, []).append(place)

        def language(value):
            hits = [0] * len(languages)
            for word in listed.keys() & set(TOKEN.findall(value.lower())):
                for place in listed[word]:
                    hits[place] += 1
            most = max(hits)
            return languages[hits.index(most)] if most else None

        return _in_steps(bodies, lambda some: pa.array(
            [None if v is None else language(v) for v in some.to_pylist()], pa.string()))

    return F.arrow_udf(told, "string")(body)


def counted(body: Column, language: Column, folded: bool) -> Column:
    """The content words of a text as array<struct<value, first, n>>, in the order of first use.

    ``first`` is the place among all words, ``n`` the number of uses.  With ``folded`` spellings that
    fold to one word count as that word, and words that fold to nothing are left out.  Null without words.
    """
    def told(bodies, languages):
        import pyarrow as pa

        stops = {name: frozenset(lexicon.stop_words(name)) for name in (None, "french", "english")}

        def some(part):
            values, firsts, counts, ends = [], [], [], [0]
            for body, name in zip(part["body"].to_pylist(), part["language"].to_pylist()):
                if body is not None:
                    _count(TOKEN.findall(body), stops.get(name, stops[None]), folded, values, firsts, counts)
                ends.append(len(values))
            entries = pa.StructArray.from_arrays(
                [pa.array(values, pa.string()), pa.array(firsts, pa.int32()), pa.array(counts, pa.int64())],
                ["value", "first", "n"])
            empty = pa.array([a == b for a, b in zip(ends, ends[1:])], pa.bool_())
            return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), entries, mask=empty)

        return _in_steps(pa.table({"body": bodies, "language": languages}), some)

    return F.arrow_udf(told, COUNTED)(body, language)


def _in_steps(rows, some):
    import pyarrow as pa

    parts = [some(rows.slice(a, STEP)) for a in range(0, max(len(rows), 1), STEP)]
    return pa.concat_arrays(parts)


def _count(tokens: list[str], stop: frozenset, folded: bool, values: list, firsts: list, counts: list) -> None:
    """Add the content words of a text in the order of first use."""
    # Written backwards, so the first place of a word stays.
    place = dict(zip(reversed(tokens), range(len(tokens) - 1, -1, -1)))
    spelt = Counter(tokens)
    # No token holds a line end, so all of them are spelt anew in one go.
    whole = "\n".join(spelt)
    low = whole.lower().split("\n")
    uses = {}
    for token, small, value, n in zip(spelt, low, fold(whole).split("\n") if folded else spelt, spelt.values()):
        if small in stop or not value or not folded and token in stop:
            continue
        if value in uses:
            uses[value] += n
        else:
            uses[value] = n
            firsts.append(place[token])
    values.extend(uses)
    counts.extend(uses.values())
