"""Pack token pieces into as few fixed-size sequences as possible.

Only the number of pieces of each length matters, so the plan is made on a table
of at most ``capacity`` counts: combinations of lengths that fill a gap exactly are
used up first, and what is left goes best-fit.  The plan is a short list of runs of
equal treatment; every piece finds its place by its rank among pieces of its length.
"""

from __future__ import annotations

import json
import re
import unicodedata
import zlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import in_frames, pick, settle

CAPACITY = 4096
END = 1
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
# Characters whose runs the tokenizer's pattern keeps together, and single digits.
# An apostrophe may begin a contraction, and other scripts may be composed or lowered
# in their own ways: texts with any of those go through the tokenizer itself.
LETTERS = {chr(c) for c in range(256) if chr(c).isalpha()}
BLANKS = {" ", "\n", "\t"}
MARKS = {chr(c) for c in [*range(33, 127), *range(161, 256)]
         if not chr(c).isalnum() and unicodedata.category(chr(c))[0] in "PSC"} - {"'", "\xad"}
DIGITS = set("0123456789")
_PLAIN = LETTERS | BLANKS | MARKS | DIGITS
_MARK_RUN = re.compile("[" + re.escape("".join(sorted(MARKS))) + "]+")
_DIGIT = re.compile("[0-9]")
_ENCODERS: dict[str, Encoder] = {}


def _byte_letters() -> dict[int, str]:
    """Byte-level BPE's letters of the bytes that are not printable Latin-1, in byte order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    return {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in plain)}


def _end_marked(path: str):
    """The vocabulary as byte ranks, a zero byte standing for the end of a word; ids by rank.

    Merging by ranks gives what the tokenizer's list of merges gives if every token,
    merged alone by that list, becomes itself: then two neighbours that spell a token
    are always the pair the list names for it.  That is checked here.
    """
    import tiktoken
    from tokenizers import models

    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    merges = [tuple(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
    suffix, vocab = model["end_of_word_suffix"], model["vocab"]
    inner = models.BPE(vocab=vocab, merges=merges)
    whole = models.BPE(vocab=vocab, merges=merges, end_of_word_suffix=suffix)
    back = {chr(b): b for b in range(256)} | {c: b for b, c in _byte_letters().items()}
    ranks, ids = {}, {}

    def put(token: str, rank: int) -> None:
        ends = token.endswith(suffix)
        word = token[:len(token) - len(suffix) * ends]
        alone = (whole if ends else inner).tokenize(word)
        if len(alone) != 1 or alone[0].value != token:
            raise ValueError(f"{token!r} is not merged from its own letters")
        ranks[bytes(back[c] for c in word) + b"\0" * ends] = rank
        ids[rank] = vocab[token]

    for b in range(256):
        letter = _byte_letters().get(b, chr(b))
        put(letter, b)
        put(letter + suffix, 256 + b)
    for k, (left, right) in enumerate(merges):
        put(left + right, 512 + k)
    encoding = tiktoken.Encoding("words", pat_str="[^\\x00]+\\x00", mergeable_ranks=ranks, special_tokens={})
    return encoding, np.array([ids[r] for r in range(len(ids))], "<u4")


class Encoder:
    """Ids of texts as little-endian bytes.

    The vocabulary drops white space and never joins what its pattern parts.  Texts
    of plain characters are parted here, by a zero byte after every word, and merged
    by ranks; any other text goes through the tokenizer itself.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merged, self.table = _end_marked(path)

    def texts(self, texts: list[str]) -> list[bytes]:
        odd = set().union(*texts) - _PLAIN
        plain = [not (odd and odd.intersection(t)) and "<|" not in t for t in texts]
        line = "\1".join([t for t, p in zip(texts, plain) if p]).lower()
        line = _DIGIT.sub("\0\\g<0>\0", _MARK_RUN.sub("\0\\g<0>\0", line))
        line = line.replace(" ", "\0").replace("\n", "\0").replace("\t", "\0")
        parted = iter(line.split("\1"))
        out = []
        for t, p in zip(texts, plain):
            if p:
                out.append(self.table[self.merged.encode_to_numpy(next(parted) + "\0")].tobytes())
            else:
                ids = self.tokenizer.encode(t, add_special_tokens=False).ids
                out.append(np.array(ids, "<u4").tobytes())
        return out


def encoder(path: str) -> Encoder:
    """One encoder per Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def groups(texts: list[str], budget: int = 2 << 20):
    """Spans of neighbouring texts of about ``budget`` characters."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= budget:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def pieces(docs: DataFrame, id_: str, text: str, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece of every text: its span and the CRC-32 of its ids.

    A null text is empty and makes one piece that holds the end id alone.
    """
    end = np.array([END], "<u4").tobytes()

    def run(frames):
        import pandas as pd

        encode = encoder(tokenizer_path).texts
        for pdf in frames:
            ids, texts, out = pdf["doc_id"], [t or "" for t in pdf.pop("text")], []
            for a, b in groups(texts):
                for doc, data in zip(range(a, b), encode(texts[a:b])):
                    data += end
                    n = len(data) // 4
                    for k, s in enumerate(range(0, n, capacity)):
                        part = data[4 * s:4 * (s + capacity)]
                        out.append((doc, k, s, len(part) // 4, zlib.crc32(part)))
            frame = pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            yield frame.assign(doc_id=ids.array.take(frame["doc_id"].to_numpy(np.int64)))

    return in_frames(pick(docs, doc_id=id_, text=text), run, PIECES)


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """Runs (length, first rank, pieces, first sequence, offset) that place every piece.

    ``counts[n]`` is the number of pieces of length n.  From the longest length
    down, the index of single, pair and triple sums gives lengths that fill the
    gap exactly; a combination is used as often as its scarcest length allows.
    Every use exhausts a length, so the plan is as short as the table of lengths.
    """
    left, used = counts.astype(np.int64).copy(), np.zeros(capacity + 1, np.int64)
    left[0] = 0
    runs, sequences = [], 0

    def take(length: int, times: int, first: int, offset: int) -> None:
        runs.append((length, used[length], times, first, offset))
        used[length] += times
        left[length] -= times

    def pair(total: int, top: int) -> tuple[int, ...] | None:
        """Two available lengths, the longer first and at most ``top``."""
        a = np.arange(min(top, total - 1), (total - 1) // 2, -1)
        ok = (left[a] > 0) & (left[total - a] > 0) & ((2 * a != total) | (left[a] > 1)) if len(a) else a
        k = int(np.argmax(ok)) if len(a) else 0
        return (int(a[k]), int(total - a[k])) if len(a) and ok[k] else None

    def fill(gap: int, top: int) -> tuple[int, ...] | None:
        if gap == 0:
            return ()
        if gap <= top and left[gap] > 0:
            return (gap,)
        if found := pair(gap, top):
            return found
        for a in np.flatnonzero(left[: min(top, gap - 2) + 1])[::-1]:
            if 3 * a < gap:
                break
            left[a] -= 1
            found = pair(gap - int(a), int(a))
            left[a] += 1
            if found:
                return (int(a), *found)
        return None

    for length in range(capacity, 0, -1):
        while left[length]:
            left[length] -= 1
            rest = fill(capacity - length, length)
            left[length] += 1
            if rest is None:
                break
            combination = (length, *rest)
            times = min(int(left[n]) // combination.count(n) for n in set(combination))
            offset = 0
            for n in combination:
                take(n, times, sequences, offset)
                offset += n
            sequences += times

    # Best fit for the rest, longest first: open sequences grouped by their gap.
    gaps: dict[int, list[tuple[int, int]]] = {}
    open_ = np.zeros(capacity + 1, bool)
    for length in range(capacity, 0, -1):
        while left[length]:
            fits = np.flatnonzero(open_[length:])
            if len(fits) == 0:
                # Just so many new sequences as this length alone can fill.
                n = -(-int(left[length]) // (capacity // length))
                take(length, n, sequences, 0)
                gaps.setdefault(capacity - length, []).append((sequences, n))
                open_[capacity - length] = capacity > length
                sequences += n
                continue
            gap = length + int(fits[0])
            first, many = gaps[gap].pop()
            n = min(many, int(left[length]))
            take(length, n, first, capacity - gap)
            if n < many:
                gaps[gap].append((first + n, many - n))
            if not gaps[gap]:
                open_[gap] = False
            gaps.setdefault(gap - length, []).append((first, n))
            open_[gap - length] = gap > length
    assert not left.any()
    return np.array(runs, np.int64).reshape(-1, 5)


def ranked(rows: DataFrame, total: int) -> DataFrame:
    """Add ``rank`` (from 0) of every piece among the pieces of its length.

    Two levels, salted: a length that holds most rows is numbered in many tasks.
    """
    salts = max(32, -(-total // (1 << 20)))
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    inside = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32")
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    sums = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    sums = sums.select("length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    numbered = salted.withColumn("_r", F.row_number().over(inside))
    return (numbered.join(sums, ["length", "_salt"])
            .withColumn("rank", F.col("_base") + F.col("_r") - 1).drop("_salt", "_base", "_r"))


def pack(docs: DataFrame, id_: str, text: str, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """Pieces with ``sequence_id`` and ``offset``.

    Null or repeated ids and repeated rows are packed like any other row; an empty
    table gives no row.  The counts per length (at most ``capacity`` rows) are all
    that comes to the driver.
    """
    cut = settle(pieces(docs, id_, text, tokenizer_path, capacity))
    counts = np.zeros(capacity + 1, np.int64)
    for r in cut.groupBy("length").count().collect():
        counts[r["length"]] = r["count"]
    runs = plan(counts, capacity)
    runs = runs[np.lexsort((runs[:, 1], runs[:, 0]))]
    step = int(counts.max()) + 1

    def place(frames):
        keys = runs[:, 0] * step + runs[:, 1]
        for pdf in frames:
            rank = pdf["rank"].to_numpy()
            run = runs[np.searchsorted(keys, pdf["length"].to_numpy() * step + rank, "right") - 1]
            pdf["sequence_id"] = run[:, 3] + rank - run[:, 1]
            pdf["offset"] = run[:, 4]
            yield pdf[["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]]

    return in_frames(ranked(cut, int(counts.sum())), place, PIECES + ", sequence_id long, offset long")
