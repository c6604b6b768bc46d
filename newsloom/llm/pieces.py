"""SentencePiece encoding and decoding by a Viterbi pass that words share.

The distinct marked words of a batch are sorted, which makes neighbours share their
prefixes, and walked depth first: the forward state at every character of a prefix is
worked out once.  A state keeps the best path that ends there.

For a unigram model the best path has the largest sum of piece scores.  A merge (BPE)
model's scores are ranks, and their largest sum is not what merging gives.  There a
path may only step from one piece to the next if merging the two alone leaves them
apart; exactly one path to each state does, and it is the merged segmentation.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import DataFrame

from .common import in_frames, pick
from .packing import groups

MARK = "\u2581"
MARKS = ".,;:!?|"
_RUNS = re.compile(r" +[^ ]*|[^ ]+")
_SHARED: dict[str, Pieces] = {}


class Pieces:
    """The pieces of one model file: ids, scores, bytes, and whether they merge by rank."""

    def __init__(self, path: str, merges: bool = True, keep: int = 350_000):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.merges, self.keep = merges, keep
        self.known, self.scores, self.bytes = {}, {}, [b""] * n
        self.byte_ids = [0] * 256
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.bytes[i] = bytes([int(piece[3:5], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.scores[piece] = model.get_score(i)
                # Score, id and, by the next piece, whether merging keeps the two apart.
                self.known[piece] = (model.get_score(i), i.to_bytes(4, "little"), {})
                self.bytes[i] = piece.replace(MARK, " ").encode()
        # Ends of pieces: a string that is none cannot end a longer piece either.
        self.tails = {p[k:] for p in self.known for k in range(len(p))}
        self.joined = {p[k:k + 2] for p in self.known for k in range(len(p) - 1)}
        if any(x != MARK and y == MARK for x, y in self.joined):
            raise ValueError("a piece goes on past the end of a word")
        self.marks = "".join(m for m in MARKS if not any(x.isalpha() and y == m for x, y in self.joined))
        self.words: dict[str, bytes] = {}

    def keeps_apart(self, a: str, b: str) -> bool:
        """Whether merging the letters of two pieces by rank ends in just these two."""
        symbols, score, middle = list(a + b), self.scores.get, len(a)
        while len(symbols) > 1:
            ranks = [score(x + y, -np.inf) for x, y in zip(symbols, symbols[1:])]
            best = max(ranks)
            if best == -np.inf:
                break
            at = ranks.index(best)
            joined = symbols[at] + symbols[at + 1]
            before = len("".join(symbols[:at]))
            if before < middle < before + len(joined):
                return False
            symbols[at:at + 2] = [joined]
        return symbols == [a, b]

    def _lone(self, char: str) -> bytes:
        return np.array([self.byte_ids[b] for b in char.encode("utf-8", "surrogatepass")], "<u4").tobytes()

    def walk(self, words: list[str]):
        """(word, ids) of sorted distinct words, sharing forward states between neighbours."""
        known, tails, merges, keeps_apart, lone = self.known, self.tails, self.merges, self.keeps_apart, self._lone
        # One state per character: score, what may follow the last piece (none at the start or after a
        # byte), the start of that piece and its ids.
        states: list[tuple[float, dict | None, int, bytes]] = [(0.0, None, 0, b"")]
        last = ""
        for word in words:
            shared, most = 0, min(len(last), len(word))
            while shared < most and last[shared] == word[shared]:
                shared += 1
            del states[shared + 1:]
            for end in range(shared + 1, len(word) + 1):
                best = None
                for start in range(end - 1, -1, -1):
                    piece = word[start:end]
                    found = known.get(piece)
                    if found is None:
                        if piece in tails:
                            continue
                        break
                    before = states[start]
                    score, own, follows = found
                    if merges and before[1] is not None:
                        fits = before[1].get(piece)
                        if fits is None:
                            fits = before[1][piece] = keeps_apart(word[before[2]:start], piece)
                        if not fits:
                            continue
                    score += before[0]
                    if best is None or score > best[0]:
                        best = (score, follows, start, own)
                        if merges:
                            break
                if best is None:
                    best = (states[end - 1][0] - 1e6, None, end - 1, lone(word[end - 1]))
                states.append(best)
            last = word
            path, at = [], len(word)
            while at:
                _, _, at, own = states[at]
                path.append(own)
            path.reverse()
            yield word, b"".join(path)

    def cut(self, text: str) -> list[str]:
        """Marked words: blanks become marks, a run of marks stays with the word after it.

        A mark in the text itself is a blank like any other.
        """
        if not text:
            return []
        line = " " + text.replace(MARK, " ")
        if "  " in line:
            return [w.replace(" ", MARK) for w in _RUNS.findall(line)]
        return [MARK + w for w in line[1:].split(" ")]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of every text as little-endian bytes."""
        if len(self.words) > self.keep:
            self.words.clear()
        cut = [self.cut(t) for t in texts]
        # A tail of marks after a letter is never part of the same piece: cut there too.
        new = {}
        for w in set().union(*cut).difference(self.words):
            base = w.rstrip(self.marks)
            new[w] = (base, w[len(base):]) if base[-1:].isalpha() else (w, "")
        found = dict(self.walk(sorted({p for pair in new.values() for p in pair if p})))
        found[""] = b""
        new = {w: found[base] + found[tail] for w, (base, tail) in new.items()}
        self.words.update((w, i) for w, i in new.items() if len(w) <= 64)
        if any(len(w) > 64 for w in new):
            return [b"".join([self.words[w] if w in self.words else new[w] for w in words]) for words in cut]
        return [b"".join(map(self.words.__getitem__, words)) for words in cut]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; the blank before the first word is not part of it."""
        table = self.bytes
        data = b"".join([table[i] for i in ids.tolist()])
        return data.decode("utf-8", "surrogatepass").removeprefix(" ")


def shared(path: str, merges: bool = True) -> Pieces:
    """One model per Python worker."""
    if path not in _SHARED:
        _SHARED[path] = Pieces(path, merges)
    return _SHARED[path]


def encode(docs: DataFrame, id_: str, text: str, model_path: str, merges: bool = True) -> DataFrame:
    """(doc_id, ids): null and empty texts have no ids."""
    def run(frames):
        import pandas as pd

        model = shared(model_path, merges)
        for pdf in frames:
            ids, texts = pdf["doc_id"], [t or "" for t in pdf["text"]]
            for a, b in groups(texts, 4 << 20):
                yield pd.DataFrame({"doc_id": ids.array[a:b], "ids": [
                    np.frombuffer(x, "<u4").astype(np.int32) for x in model.encode(texts[a:b])]})

    return in_frames(pick(docs, doc_id=id_, text=text), run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, id_: str, ids: str, model_path: str) -> DataFrame:
    """(doc_id, text); null ids give a null text."""
    def run(frames):
        model = shared(model_path)
        for pdf in frames:
            pdf["text"] = [None if x is None else model.decode(np.asarray(x)) for x in pdf.pop("ids")]
            yield pdf

    return in_frames(pick(encoded, doc_id=id_, ids=ids), run, "doc_id long, text string")


DIGESTS = "n_ids long, ids_crc32 long, decoded_crc32 long, decoded_chars long"


def _digest(model: Pieces, ids: np.ndarray) -> tuple[int, int, int, int]:
    """Of one text's ids: how many, their checksum, and that and the length of the text they decode to."""
    text = model.decode(ids)
    return len(ids), zlib.crc32(ids.tobytes()), zlib.crc32(text.encode("utf-8", "surrogatepass")), len(text)


def digests(encoded: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, n_ids, ids_crc32, decoded_crc32, decoded_chars) of (doc_id, ids)."""
    def run(frames):
        import pandas as pd

        model = shared(model_path)
        for pdf in frames:
            found = [_digest(model, np.asarray(x, "<u4")) for x in pdf.pop("ids")]
            found = pd.DataFrame(found, columns=[c.split()[0] for c in DIGESTS.split(", ")], dtype="int64")
            yield pd.concat([pdf.reset_index(drop=True), found], axis=1)

    return in_frames(encoded, run, f"doc_id long, {DIGESTS}")


def encode_digests(docs: DataFrame, id_: str, text: str, model_path: str) -> DataFrame:
    """``digests(encode(...))`` in one pass: the ids stay in the task that makes them.

    Null and empty texts have no ids; equal rows give equal rows.
    """
    def run(frames):
        import pandas as pd

        model = shared(model_path)
        names = [c.split()[0] for c in DIGESTS.split(", ")]
        for pdf in frames:
            ids, texts = pdf["doc_id"], [t or "" for t in pdf["text"]]
            for a, b in groups(texts, 4 << 20):
                found = [_digest(model, np.frombuffer(x, "<u4")) for x in model.encode(texts[a:b])]
                out = pd.DataFrame(found, columns=names, dtype="int64")
                out.insert(0, "doc_id", ids.array[a:b])
                yield out

    return in_frames(pick(docs, doc_id=id_, text=text), run, f"doc_id long, {DIGESTS}")
