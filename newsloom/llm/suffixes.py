"""Passages that repeat across documents, by a distributed merge sort of suffixes.

1. Documents go into packs of a few megabytes, written once.
2. Not every suffix is sorted.  Every string of ``least`` bytes holds at least one
   anchor, the smallest hash among its ``GRAM``-byte strings.  Packs send the sorted
   hashes of their anchors to the owners of hash ranges and hear which of them lie in
   more than one document.  Nothing that repeats is lost.
3. The suffixes at those anchors are sorted inside each pack, front-coded (only the
   bytes after the prefix shared with the suffix before), cut at common splitters and
   exchanged.  A loser tree merges the runs of a range; it carries the known common
   prefixes along and compares strings only behind them.
4. The merged common prefixes say which suffixes share how many bytes to the right of
   the anchor; with the bytes to its left that decides every string of ``least`` bytes
   around the anchor.

A pack sends one suffix for all that have the same bytes on both sides, the one of its
least document, and decides the others by itself.  Grams with more than ``HOT`` anchors
are not sorted at all: their strings are compared by 128-bit hashes, dealt out by hash,
so a passage in very many documents never comes together in one range.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.joins import lookup
from .common import release, settle, ship, shuffle_partitions

LEAST = 50
GRAM = 20
LEFT = LEAST - GRAM
WINDOW = LEFT + 1
PACK_BYTES = 4 << 20
# What a row counts in a pack besides its text.
ROW_BYTES = 64
HOT = 1 << 14
TWIN = np.uint32(1 << 31)
PAD = 0xFF  # no byte of UTF-8 text
_TOP = np.uint64(2**64 - 1)
_BYTES = np.random.default_rng(7).integers(0, 2**64, 256, np.uint64)
_STEP = 0x9E3779B97F4A7C15


def _power(k: int) -> np.uint64:
    return np.uint64(pow(_STEP, k, 2**64))


def _grams(data: np.ndarray) -> np.ndarray:
    """A mixed 64-bit hash of the GRAM bytes at every place."""
    one = _BYTES[data]
    two = one[:-1] * _power(1) + one[1:]
    four = two[:-2] * _power(2) + two[2:]
    eight = four[:-4] * _power(4) + four[4:]
    sixteen = eight[:-8] * _power(8) + eight[8:]
    h = sixteen[:-4] * _power(4) + four[16:]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def _slide(x: np.ndarray, best) -> np.ndarray:
    """``best`` over every WINDOW (31) neighbours."""
    for k in (1, 2, 4, 8):
        x = best(x[:-k], x[k:])
    return best(x[:-15], x[15:])


def anchors(data: np.ndarray, stops: np.ndarray, block: int = 1 << 16) -> tuple[np.ndarray, np.ndarray]:
    """Places and 47-bit hashes of the anchors of concatenated documents."""
    total = len(data) - GRAM + 1
    if total < WINDOW:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    crossing = (stops[:, None] - np.arange(1, GRAM)).ravel()
    crossing = np.unique(crossing[(crossing >= 0) & (crossing < total)])
    places, hashes = [], []
    for start in range(0, total, block):
        a, b = max(0, start - LEFT), min(total, start + block + LEFT)
        h = _grams(data[a:b + GRAM - 1])
        h[crossing[np.searchsorted(crossing, a):np.searchsorted(crossing, b)] - a] = _TOP
        low = np.zeros(len(h) + LEFT, np.uint64)
        if len(h) >= WINDOW:
            low[LEFT:len(h)] = _slide(h, np.minimum)
        chosen = np.flatnonzero((_slide(low, np.maximum) == h) & (h != _TOP)) + a
        chosen = chosen[(chosen >= start) & (chosen < start + block)]
        places.append(chosen)
        hashes.append(h[chosen - a] >> np.uint64(17))
    return np.concatenate(places), np.concatenate(hashes)


def _narrow(x: np.ndarray) -> bytes:
    """Numbers below 2^48 as six bytes each."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _widen(blob: bytes) -> np.ndarray:
    out = np.zeros((len(blob) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(blob, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def packed(docs: DataFrame, id_: str, text: str, rest: list[str]) -> DataFrame:
    """Packs of whole documents in the order of reading.  A null id sorts after all others."""
    import zstandard

    def run(batches):
        part, number = TaskContext.get().partitionId(), 0
        held, size = [], 0

        def flush():
            nonlocal number, held, size
            table = pa.Table.from_batches(held)
            texts = [(t or "").encode("utf-8", "surrogatepass") for t in table["text"].to_pylist()]
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.drop_columns(["text"]).schema) as out:
                out.write_table(table.drop_columns(["text"]))
            squeeze = zstandard.ZstdCompressor(level=3).compress
            ids = table["doc_id"].to_numpy(zero_copy_only=False) if table["doc_id"].null_count == 0 else np.array(
                [2**63 - 1 if x is None else x for x in table["doc_id"].to_pylist()])
            row = {"pack": (part << 32) + number, "ids": ids.astype("<i8").tobytes(),
                   "stops": np.cumsum([len(t) for t in texts]).astype("<i8").tobytes(),
                   "same": b"".join(hashlib.blake2b(t, digest_size=16).digest() for t in texts),
                   "rest": squeeze(sink.getvalue().to_pybytes()), "body": squeeze(b"".join(texts))}
            number, held, size = number + 1, [], 0
            return pa.RecordBatch.from_pylist([row], pa.schema([
                ("pack", pa.int64()), *((c, pa.binary()) for c in ("ids", "stops", "same", "rest", "body"))]))

        for batch in batches:
            # UTF-8 bytes; a row counts even when it is empty.
            lengths = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy() + ROW_BYTES
            start = 0
            for i, n in enumerate(lengths):
                size += int(n)
                if size >= PACK_BYTES:
                    held.append(batch.slice(start, i + 1 - start))
                    start = i + 1
                    yield flush()
            if start < batch.num_rows:
                held.append(batch.slice(start))
        if held:
            yield flush()

    ship(docs.sparkSession)
    rows = docs.select(docs[id_].cast("long").alias("doc_id"), docs[text].alias("text"),
                       *[docs[c].alias(f"rest_{i}") for i, c in enumerate(rest)])
    return rows.mapInArrow(run, "pack long, ids binary, stops binary, same binary, rest binary, body binary")


def _opened(row) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    import zstandard

    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["body"]) if row["body"] else b"", np.uint8)
    return data, np.frombuffer(row["stops"], "<i8"), np.frombuffer(row["ids"], "<i8")


def _copies(packs: DataFrame) -> DataFrame:
    """(pack, copies): the places in a pack of documents whose whole text has a smaller id elsewhere."""
    def run(frames):
        import pandas as pd

        for pdf in frames:
            for pack, ids, same in zip(pdf["pack"], pdf["ids"], pdf["same"]):
                ids = np.frombuffer(ids, "<i8")
                yield pd.DataFrame({"pack": pack, "place": np.arange(len(ids), dtype=np.int32), "doc": ids,
                                    "same": [same[16 * i:16 * i + 16] for i in range(len(ids))]})

    rows = settle(packs.select("pack", "ids", "same").mapInPandas(run, "pack long, place int, doc long, same binary"))
    first = rows.groupBy("same").agg(F.min("doc").alias("first"), F.count("*").alias("n")).where("n > 1")
    later = lookup(rows, first, "same", "n", rows.count()).where("doc > first")
    return later.groupBy("pack").agg(F.collect_list("place").alias("copies"))


def _shared(packs: DataFrame, buckets: int, most: int) -> DataFrame:
    """(pack, blob): the anchor hashes of a pack that more than one document holds, each
    followed by a bit that says whether it has about ``most`` anchors or more."""
    def send(frames):
        import pandas as pd

        for pdf in frames:
            for row in pdf.to_dict("records"):
                release()
                data, stops, _ = _opened(row)
                places, h = anchors(data, stops)
                if not len(places):
                    continue
                doc = np.searchsorted(stops, places, "right")
                order = np.lexsort((doc, h))
                h, doc = h[order], doc[order]
                new = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
                ends = np.append(new[1:], len(h))
                value = (h[new] << np.uint64(1)) | (doc[new] != doc[ends - 1]).astype(np.uint64)
                bucket = ((h[new] >> np.uint64(15)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)
                cut = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
                power = np.ceil(np.log2(ends - new)).astype(np.uint8)
                yield pd.DataFrame({"bucket": bucket[cut], "pack": row["pack"], "blob": [
                    _narrow(v) for v in np.split(value, cut[1:])], "powers": [
                    v.tobytes() for v in np.split(power, cut[1:])]})

    def answer(pdf):
        import pandas as pd

        sent = [_widen(b) for b in pdf["blob"]]
        every = np.concatenate(sent)
        order = np.argsort(every, kind="stable")
        every, weight = every[order], 2.0 ** np.frombuffer(b"".join(pdf["powers"]), np.uint8)[order]
        h = every >> np.uint64(1)
        twice = np.append(h[1:] == h[:-1], False)
        shared = np.unique(h[twice | (every & np.uint64(1)).astype(bool)])
        new = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        hot = h[new][np.add.reduceat(weight, new) >= most]
        own = [x[np.isin(x, shared, assume_unique=True)] for x in (s >> np.uint64(1) for s in sent)]
        own = [(x << np.uint64(1)) | np.isin(x, hot, assume_unique=True).astype(np.uint64) for x in own]
        return pd.DataFrame([(p, _narrow(o)) for p, o in zip(pdf["pack"], own) if len(o)], columns=["pack", "blob"])

    sent = packs.select("pack", "stops", "ids", "body").mapInPandas(send, "bucket int, pack long, blob binary, powers binary")
    return sent.groupBy("bucket").applyInPandas(answer, "pack long, blob binary")


def _around(data: np.ndarray, stops: np.ndarray, places: np.ndarray):
    """The LEAST bytes from each place and the LEFT bytes before it (nearest first), inside the document."""
    doc = np.searchsorted(stops, places, "right")
    start = np.append(0, stops)[doc]
    right, left = np.minimum(stops[doc] - places, LEAST), np.minimum(places - start, LEFT)
    ahead, behind = np.empty((len(places), LEAST), np.uint8), np.empty((len(places), LEFT), np.uint8)
    # In blocks: the places of all these bytes at once would take many times the bytes.
    for a in range(0, len(places), 1 << 14):
        b = slice(a, a + (1 << 14))
        at = places[b, None] + np.arange(LEAST)
        ahead[b] = np.where(np.arange(LEAST) < right[b, None], data[np.minimum(at, len(data) - 1)], PAD)
        at = places[b, None] - 1 - np.arange(LEFT)
        behind[b] = np.where(np.arange(LEFT) < left[b, None], data[np.maximum(at, 0)], PAD)
    return doc, ahead, behind


def _numbers(x: np.ndarray) -> np.ndarray:
    """Byte rows as columns of numbers of the same order."""
    wide = np.zeros((len(x), -(-x.shape[1] // 8) * 8), np.uint8)
    wide[:, :x.shape[1]] = x
    return wide.view(">u8").astype(np.uint64).T


def _groups(keys: list[np.ndarray], docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by ``keys`` and then by document, and where in it new keys begin."""
    order = np.lexsort((docs, *keys[::-1]))
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        k = k[order]
        new[1:] |= k[1:] != k[:-1]
    return order, np.flatnonzero(new)


def _open_offsets(places: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Bit o: the LEAST bytes that start o before a place lie inside its document."""
    doc = np.searchsorted(stops, places, "right")
    left, right = places - np.append(0, stops)[doc], stops[doc] - places
    mask = np.zeros(len(places), np.uint32)
    for o in range(WINDOW):
        mask |= ((left >= o) & (right >= LEAST - o)).astype(np.uint32) << np.uint32(o)
    return mask


def _starts(places: np.ndarray, masks: np.ndarray, size: int) -> np.ndarray:
    """Marks, at ``size`` places, of the strings that the bits of ``masks`` name."""
    out = np.zeros(size, bool)
    for o in range(WINDOW):
        out[places[(masks >> np.uint32(o)) & np.uint32(1) == 1] - o] = True
    return out


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of byte rows, pads never counting."""
    same = (a == b) & (a != PAD)
    return np.where(same.all(axis=1), a.shape[1], np.argmin(same, axis=1))


def _hashed(data: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """128-bit hashes of the strings at ``starts``, as two columns.

    In blocks: an object per string would take many times the bytes of the hashes.
    """
    import xxhash

    body, digest = memoryview(np.ascontiguousarray(data)), xxhash.xxh3_128_digest
    hashes = np.empty((len(starts), 16), np.uint8)
    for a in range(0, len(starts), 1 << 14):
        some = starts[a:a + (1 << 14)].tolist()
        hashes[a:a + len(some)] = np.frombuffer(
            b"".join([digest(body[p:p + LEAST]) for p in some]), np.uint8).reshape(-1, 16)
    return list(hashes.view("<u8").T)


def _sliced(data: np.ndarray, stops: np.ndarray, ids: np.ndarray, starts: np.ndarray, parts: int, slices: int = 8):
    """The strings at ``starts`` with owner, hash and bucket, a slice of the buckets at a time.

    Nearly every place of a pack may start a string around a hot gram; sorting them all
    at once would take a hundred times the pack.
    """
    if not len(starts):
        return
    keys = _hashed(data, starts)
    bucket = (keys[0] % np.uint64(parts)).astype(np.int32)
    for s in range(slices):
        some = np.flatnonzero(bucket % slices == s)
        if len(some):
            own = starts[some]
            yield own, ids[np.searchsorted(stops, own, "right")], [k[some] for k in keys], bucket[some]


def _runs(splitters: list[bytes], parts: int):
    """Packs to front-coded sorted runs, cut at the splitters: ranges below ``parts``.

    The next ``parts`` ranges get hashes of strings around hot grams, the ones after
    them what a pack decides alone: masks, or TWIN and the place that decides.
    """
    cuts = np.array(splitters, dtype=f"S{GRAM}")
    columns = ["range", "pack", "shared", "tails", "behind", "docs", "places"]

    def run(frames):
        import pandas as pd
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=1).compress
        for pdf in frames:
            for row in pdf.to_dict("records"):
                release()
                data, stops, ids = _opened(row)
                places, h = anchors(data, stops)
                wanted = np.concatenate([_widen(b) for b in row["blobs"]])
                hot = wanted[wanted & np.uint64(1) == 1] >> np.uint64(1)
                keep = np.isin(h, wanted >> np.uint64(1))
                if row["copies"] is not None:
                    whole = np.isin(np.arange(len(stops)), np.asarray(row["copies"], np.int64))
                    keep &= ~whole[np.searchsorted(stops, places, "right")]
                places, hot = places[keep], np.isin(h[keep], hot)
                if not len(places):
                    continue
                doc, ahead, behind = _around(data, stops, places)
                order, first = _groups([*_numbers(ahead), *_numbers(behind)], ids[doc])
                doc, ahead, behind, places, hot = doc[order], ahead[order], behind[order], places[order], hot[order]
                one = np.repeat(first, np.diff(np.append(first, len(order))))
                later = ids[doc] > ids[doc[one]]
                twin = ~later & (np.arange(len(order)) != one)
                at = [places[later], places[twin]]
                masks = [_open_offsets(places[later], stops), places[one[twin]].astype(np.uint32) | TWIN]
                out = []
                starts = first[hot[first]]
                if len(starts):
                    starts = np.flatnonzero(_starts(places[starts], _open_offsets(places[starts], stops), len(data))).astype(np.int32)
                for starts, owner, keys, bucket in _sliced(data, stops, ids, starts, parts):
                    order, new = _groups(keys, owner)
                    starts, owner, bucket = starts[order], owner[order], bucket[order]
                    least = np.repeat(owner[new], np.diff(np.append(new, len(order))))
                    at.append(starts[owner > least])
                    masks.append(np.ones(len(at[-1]), np.uint32))
                    sent = np.flatnonzero(owner == least)
                    sent = sent[np.argsort(bucket[sent], kind="stable")]
                    for own in np.split(sent, np.flatnonzero(np.diff(bucket[sent])) + 1):
                        out.append((parts + int(bucket[own[0]]), row["pack"], b"", np.stack([k[order[own]] for k in keys], 1).tobytes(),
                                    b"", owner[own].tobytes(), starts[own].astype("<i4").tobytes()))
                at, masks = np.concatenate(at), np.concatenate(masks)
                if len(at):
                    spread = ((row["pack"] >> 32) * 31 + (row["pack"] & 0xFFFFFFFF)) % parts
                    out.append((2 * parts + spread, row["pack"], b"", masks.astype("<u4").tobytes(), b"", b"",
                                at.astype("<i4").tobytes()))
                first = first[~hot[first]]
                if not len(first):
                    yield pd.DataFrame(out, columns=columns)
                    continue
                doc, ahead, behind, places = doc[first], ahead[first], behind[first], places[first]
                known = np.append(0, _common(ahead[1:], ahead[:-1])).astype(np.uint8)
                lead = np.ascontiguousarray(ahead[:, :GRAM]).view(f"S{GRAM}").ravel()
                part = np.searchsorted(cuts, lead, "right")
                first = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
                for a, b in zip(first, np.append(first[1:], len(part))):
                    shared = known[a:b].copy()
                    shared[0] = 0
                    tails = ahead[a:b][np.arange(LEAST) >= shared[:, None]].tobytes()
                    out.append((int(part[a]), row["pack"], shared.tobytes(), squeeze(tails),
                                squeeze(behind[a:b].tobytes()), ids[doc[a:b]].tobytes(),
                                places[a:b].astype("<i4").tobytes()))
                yield pd.DataFrame(out, columns=columns)

    return run


def merge(runs: list[list[bytes]], shared: list[list[int]]) -> tuple[list[int], list[int]]:
    """Loser tree over sorted runs: the run of every output in order, and the length of
    the prefix it shares with the output before.

    ``shared`` holds the same inside each run.  A contender's known prefix is always
    with the last output, so the longer one wins unseen, and equal ones are compared
    only behind it.  Ties go to the run that comes first.
    """
    count = len(runs)
    size = 1 << max(0, count - 1).bit_length()
    at, known = [0] * size, [0] * count + [-1] * (size - count)
    heads: list[bytes | None] = [r[0] for r in runs] + [None] * (size - count)
    loser = [0] * size

    def beats(x: int, y: int) -> bool:
        """Whether x goes before y; the loser's known prefix becomes the one with the winner."""
        kx, ky = known[x], known[y]
        if kx != ky or kx < 0:
            return kx > ky
        a, b = heads[x], heads[y]
        if a == b:
            first, known[y if x < y else x] = x < y, len(a)
            return first
        differ = int.from_bytes(a[kx:], "big") ^ int.from_bytes(b[kx:], "big")
        known[y if a < b else x] = len(a) - (differ.bit_length() + 7) // 8
        return a < b

    winner = list(range(size))
    while len(winner) > 1:
        level = []
        for i in range(0, len(winner), 2):
            x, y = winner[i], winner[i + 1]
            w, lost = (x, y) if beats(x, y) else (y, x)
            loser[(len(winner) + i) // 2] = lost
            level.append(w)
        winner = level
    w, out, prefix = winner[0], [], []
    while known[w] >= 0:
        out.append(w)
        prefix.append(known[w])
        at[w] += 1
        if at[w] < len(runs[w]):
            heads[w], known[w] = runs[w][at[w]], shared[w][at[w]]
            if known[w] == len(heads[w]):
                continue  # the same string again
        else:
            heads[w], known[w] = None, -1
        node = (size + w) // 2
        while node:
            if not beats(w, loser[node]):
                w, loser[node] = loser[node], w
            node //= 2
    return out, prefix


def _decoded(shared: bytes, tails: bytes) -> list[bytes]:
    out, last, at = [], b"", 0
    for k in shared:
        stop = at + LEAST - k
        last = last[:k] + tails[at:stop]
        out.append(last)
        at = stop
    return out


def _dense(*keys: np.ndarray) -> np.ndarray:
    """Equal key tuples get equal small numbers."""
    code = np.zeros(len(keys[0]), np.int64)
    for k in keys:
        code = np.unique(code * (int(k.max(initial=0)) + 1) + k, return_inverse=True)[1]
    return code


def _least(group: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The least value of every group."""
    out = np.full(int(group.max(initial=-1)) + 1, 2**63 - 1)
    np.minimum.at(out, group, value)
    return out


def decide(ahead: np.ndarray, behind: np.ndarray, prefix: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Bit o of an entry: the string that starts o bytes before this anchor also starts
    in a document with a smaller id.  Entries are in merged order."""
    right = np.where((ahead == PAD).any(axis=1), np.argmax(ahead == PAD, axis=1), LEAST)
    left = np.where((behind == PAD).any(axis=1), np.argmax(behind == PAD, axis=1), LEFT)
    mask = np.zeros(len(docs), np.uint32)
    # Equal strings on both sides form a class; its least document speaks for all.
    whole = np.cumsum(prefix < LEAST)
    words = np.zeros((len(behind), 32), np.uint8)
    words[:, :LEFT] = behind
    cls = _dense(whole, *(np.unique(c, return_inverse=True)[1] for c in words.view("<u8").T))
    least = _least(cls, docs)
    one = np.zeros(len(least), np.int64)
    one[cls] = np.arange(len(cls))
    # Classes alone with their gram need no more; the others are compared side by side.
    gram = np.cumsum(prefix < GRAM)
    many = np.flatnonzero(np.bincount(gram[one], minlength=int(gram.max(initial=0)) + 1)[gram[one]] > 1)
    rep = one[many]
    side = np.zeros(len(rep), np.int64)
    for o in range(WINDOW):
        best = least.copy()
        if len(rep):
            if o:
                side = _dense(side, behind[rep, o - 1].astype(np.int64))
            ok = (right[rep] >= LEAST - o) & (left[rep] >= o)
            near = _dense(np.cumsum(prefix < LEAST - o)[rep[ok]], side[ok])
            best[many[ok]] = _least(near, least[many[ok]])[near]
        hit = (right >= LEAST - o) & (left >= o) & (best[cls] < docs)
        mask |= hit.astype(np.uint32) << np.uint32(o)
    return mask


def _merged(pdf):
    import pandas as pd
    import zstandard

    open_ = zstandard.ZstdDecompressor().decompress
    pdf = pdf.sort_values("pack")
    runs = [_decoded(s, open_(t)) for s, t in zip(pdf["shared"], pdf["tails"])]
    order, prefix = merge(runs, [list(s) for s in pdf["shared"]])
    order, sizes = np.array(order), np.array(list(map(len, runs)))
    # The j-th output of a run is its j-th entry.
    by_run = np.argsort(order, kind="stable")
    entry = np.empty(len(order), np.int64)
    entry[by_run] = np.arange(len(order))
    ahead = np.frombuffer(b"".join(b"".join(r) for r in runs), np.uint8).reshape(-1, LEAST)[entry]
    behind = np.frombuffer(b"".join(map(open_, pdf["behind"])), np.uint8).reshape(-1, LEFT)[entry]
    docs = np.frombuffer(b"".join(pdf["docs"]), "<i8")[entry]
    places = np.frombuffer(b"".join(pdf["places"]), "<i4")
    mask = np.zeros(len(order), np.uint32)
    mask[entry] = decide(ahead, behind, np.array(prefix), docs)
    out, start = [], 0
    for pack, n in zip(pdf["pack"], sizes):
        hit = np.flatnonzero(mask[start:start + n]) + start
        if len(hit):
            out.append((pack, places[hit].tobytes(), mask[hit].tobytes()))
        start += n
    return pd.DataFrame(out, columns=["pack", "places", "masks"])


def _matched(pdf):
    """Strings around hot grams: those whose hash a document with a smaller id holds too."""
    import pandas as pd

    keys = list(np.frombuffer(b"".join(pdf["tails"]), "<u8").reshape(-1, 2).T)
    docs = np.frombuffer(b"".join(pdf["docs"]), "<i8")
    order, new = _groups(keys, docs)
    least = np.empty(len(docs), np.int64)
    least[order] = np.repeat(docs[order][new], np.diff(np.append(new, len(order))))
    out, start = [], 0
    for pack, places in zip(pdf["pack"], pdf["places"]):
        places = np.frombuffer(places, "<i4")
        hit = docs[start:start + len(places)] > least[start:start + len(places)]
        if hit.any():
            out.append((pack, places[hit].tobytes(), np.ones(int(hit.sum()), "<u4").tobytes()))
        start += len(places)
    return pd.DataFrame(out, columns=["pack", "places", "masks"])


def _decided(parts: int):
    def run(pdf):
        kind = int(pdf["range"].iloc[0]) // parts
        if kind == 2:
            return pdf[["pack", "places", "tails"]].rename(columns={"tails": "masks"})
        release()
        return _matched(pdf) if kind else _merged(pdf)

    return run


def _hits(found: list[tuple[bytes, bytes]], stops: np.ndarray, size: int) -> np.ndarray:
    """Whether the string at a place of a pack also starts in a document with a smaller id."""
    at = np.frombuffer(b"".join(p for p, _ in found), "<i4")
    masks = np.frombuffer(b"".join(m for _, m in found), "<u4")
    twin = masks >= TWIN
    hit = _starts(at[~twin], masks[~twin], size)
    at, one = at[twin], (masks[twin] ^ TWIN).astype(np.int32)
    inside = _open_offsets(at, stops)
    for o in range(WINDOW):
        k = (inside >> np.uint32(o)) & np.uint32(1) == 1
        hit[at[k] - o] |= hit[one[k] - o]
    return hit


def _splitters(packs: DataFrame, count: int, ranges: int, sampled: int = 64) -> list[bytes]:
    """Cuts for about even ranges, from anchors of ``sampled`` packs, or of more where
    that gives less than eight per range; they only balance the work."""
    sampled = max(sampled, -(-ranges * 8 // 256))

    def run(frames):
        import pandas as pd

        for pdf in frames:
            for row in pdf.to_dict("records"):
                data, stops, _ = _opened(row)
                places, h = anchors(data, stops)
                at = places[np.argsort(h, kind="stable")[:256]]
                yield pd.DataFrame({"gram": [data[p:p + GRAM].tobytes() for p in at]})

    some = packs if count <= sampled else packs.sample(sampled / count, seed=1)
    grams = sorted({bytes(r[0]) for r in some.select("stops", "ids", "body").mapInPandas(run, "gram binary").collect()})
    return [grams[len(grams) * i // ranges] for i in range(1, ranges)] if grams else []


def _entries(packs: DataFrame, copies: DataFrame, count: int, parts: int, hot: int = HOT) -> DataFrame:
    """What the packs send to be decided, see ``_runs``."""
    shared = _shared(packs, parts, hot).groupBy("pack").agg(F.collect_list("blob").alias("blobs"))
    asked = packs.select("pack", "stops", "ids", "body").join(shared, "pack").join(copies, "pack", "left")
    return asked.mapInPandas(_runs(_splitters(packs, count, parts), parts), "range int, pack long, shared binary, "
                             "tails binary, behind binary, docs binary, places binary")


def repeated(docs: DataFrame, id_: str, text: str, rest: list[str] | None = None, hot: int = HOT) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept, and
    the columns named in ``rest``.

    Removed is every byte under a LEAST-byte string that also starts in a document with
    a smaller id.  Null texts are empty.  A null id counts as larger than all others;
    rows of one id do not count against each other, so repeated rows stay alike.
    ``kept`` is the remaining text, without the characters that a cut tore apart.
    """
    rest = list(rest or [])
    packs = settle(packed(docs, id_, text, rest))
    count = packs.count()
    parts = max(shuffle_partitions(docs), -(-count // 2))
    copies = settle(_copies(packs))
    runs = _entries(packs, copies, count, parts, hot)
    found = runs.groupBy("range").applyInPandas(_decided(parts), "pack long, places binary, masks binary")
    found = settle(found).groupBy("pack").agg(F.collect_list("places").alias("places"), F.collect_list("masks").alias("masks"))
    all_ = packs.join(found, "pack", "left").join(copies, "pack", "left")
    kinds = {docs.schema[c].name: docs.schema[c].dataType.simpleString() for c in rest}

    def run(batches):
        import zstandard

        for batch in batches:
            for row in (batch.slice(k, 1).to_pylist()[0] for k in range(batch.num_rows)):
                release()
                data, stops, ids = _opened(row)
                so_far = np.cumsum(_hits(list(zip(row["places"] or [], row["masks"] or [])), stops, len(data)), dtype=np.int32)
                gone = so_far > np.append(np.zeros(LEAST, np.int32), so_far)[:len(data)]
                starts = np.append(0, stops[:-1])
                for k in row["copies"] or []:
                    if stops[k] - starts[k] >= LEAST:
                        gone[starts[k]:stops[k]] = True
                out = []
                for a, b in zip(starts, stops):
                    cut = gone[a:b]
                    removed = int(np.count_nonzero(cut))
                    kept = data[a:b][~cut].tobytes() if removed else data[a:b].tobytes()
                    spans = int(np.count_nonzero(cut[1:] & ~cut[:-1])) + int(cut[0]) if removed else 0
                    out.append((int(b - a), removed, spans, hashlib.sha256(kept).hexdigest(),
                                kept.decode("utf-8", "ignore")))
                table = pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(row["rest"])).read_all()
                columns = [table["doc_id"], *(pa.array(list(c), t) for c, t in zip(zip(*out), (
                    pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()))),
                    *(table[f"rest_{i}"] for i in range(len(rest)))]
                whole = pa.table(columns, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", *rest])
                yield from whole.combine_chunks().to_batches()

    schema = ", ".join(["doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string",
                        *(f"`{c}` {kinds[c]}" for c in rest)])
    return all_.mapInArrow(run, schema)
