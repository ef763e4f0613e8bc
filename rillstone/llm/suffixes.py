"""Suffix-array dedup: bytes covered by a SPAN-byte string that starts in a document with a smaller id.

The suffixes that matter are sorted across the cluster by a merge sort that knows common prefixes:

1.  Documents are packed into blocks.  Every SPAN-byte string contains a sampled K-byte substring, its
    minimizer (the one with the least hash); only suffixes that start at such anchors are sorted (one
    byte in fourteen).  Duplicate detection on the anchors' hashes, bucket by bucket, finds the anchors
    that occur in two documents; the others cannot take part in a match.
2.  Each block sorts its shared suffixes into a run.  A suffix is cut to what its strings can reach:
    SPAN bytes from the anchor, then the bytes before the anchor backwards.  Equal suffixes are one
    entry with the smallest id.  The run is front-coded (number of words shared with the entry before,
    then the rest), split at splitters and exchanged.  The splitters come from a sample of the shared
    suffixes, so that key ranges hold about equally many.
3.  Each key range merges its runs with a loser tree over offset-value codes: a player's code holds the
    length of the prefix it shares with the last key put out and the word after it.  One comparison of
    codes decides most matches; at a tie, only the words behind are compared, and the loser's code is
    brought up to date, so a known prefix is never compared again.  The merged sequence has the common
    prefix of neighbours, so suffixes with a common anchor come as one group, where each string's
    smallest id is found.  An entry's strings that a smaller id has too go back to its block as a mask.
4.  The blocks turn masks into removed bytes.  What entry each position belongs to travels beside the
    runs, so that texts are hashed twice and sorted once.

Anchors with many occurrences (a line that a third of all documents share) are sorted by whole strings
instead of by anchor, in the same runs, so that no group holds more than HOT entries that differ.

Cases: a null text is empty; texts under SPAN bytes lose nothing; overlapping matches count; strings are
judged on the input; rows with equal ids never remove one another's bytes; a null id counts as smaller
than any other; an empty table gives an empty result.  Only id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import settle
from .blocks import pack, unpack

SPAN, K = 50, 24
REACH = SPAN - K  # bytes before an anchor that its strings can reach
HOT = 4096
PIECE = 1 << 17  # bytes hashed at once: they stay in the cache
SAMPLE = 20  # sampled suffixes for each key range, at least
RANGE_BYTES = 16 << 20  # input bytes for each bucket and key range
WORD = 7  # bytes of a word: with its place it fits 64 bits
LEAD = -(-(1 + K) // WORD)  # words of kind and anchor
WORDS = LEAD + -(-(SPAN - K + REACH + 2) // WORD)
AHEAD, BACK = LEAD * WORD, LEAD * WORD + SPAN - K  # where a key's bytes after the anchor begin, and those before it
SIZES = BACK + REACH  # where it has the numbers of bytes from the anchor on and before it
KEY = WORDS * WORD
ANCHORED, WHOLE = 1, 2
NULL_ID = -(1 << 63)
ODD = 0x9E3779B97F4A7C15


def _rolling(data: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of the ``width`` bytes (a sum of powers of two) from each position."""
    out, done, level, size = None, 0, (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93), 1
    while True:
        if width & size:
            if out is None:
                out, done = level, size
            else:
                n = len(data) - done - size + 1
                out = out[:n] + np.uint64(pow(ODD, done, 1 << 64)) * level[done : done + n]
                done += size
        if size * 2 > width:
            break
        level = level[:-size] + np.uint64(pow(ODD, size, 1 << 64)) * level[size:]
        size *= 2
    out = out ^ (out >> np.uint64(29))
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def _slide(x: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Minimum or maximum of ``width`` neighbours from each position on."""
    pick = np.minimum if least else np.maximum
    size = 1
    while size * 2 <= width:
        x = pick(x[:-size], x[size:])
        size *= 2
    rest = width - size
    return pick(x[: len(x) - rest], x[rest:]) if rest else x


class Text:
    """The bytes of a block, the documents' bounds and the anchors."""

    def __init__(self, data: np.ndarray, ids: list[int | None], lengths: list[int]):
        self.data = data
        self.ids = np.array([NULL_ID if i is None else i for i in ids], np.int64)
        self.lengths = np.array(lengths, np.int64)
        self.ends = np.cumsum(self.lengths)
        self.starts = self.ends - self.lengths
        self.anchors, self.hashes = self._sample()
        self.docs = np.searchsorted(self.ends, self.anchors, side="right")

    def _sample(self) -> tuple[np.ndarray, np.ndarray]:
        """Positions and hashes of the anchors, found PIECE bytes at a time.  The least hashes are small
        numbers: they are mixed again, so that buckets of them are even."""
        n = len(self.data)
        whole = np.zeros(n + 1, np.int8)  # where SPAN bytes lie within a document
        long = self.lengths >= SPAN
        np.add.at(whole, self.starts[long], 1)
        np.add.at(whole, self.ends[long] - SPAN + 1, -1)
        whole = np.cumsum(whole, dtype=np.int8) > 0
        ats, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for low in range(0, n, PIECE):
            first = max(0, low - REACH)
            seg = self.data[first : low + PIECE + SPAN]
            if len(seg) < SPAN:
                continue
            hashed = _rolling(seg, K)
            least = _slide(hashed, REACH + 1, True)
            least = np.where(whole[first : first + len(least)], least, np.uint64(0))
            padded = np.concatenate([np.zeros(REACH, np.uint64), least, np.zeros(REACH, np.uint64)])
            at = np.flatnonzero((_slide(padded, REACH + 1, False) == hashed) & (hashed > 0))
            at = at[(at + first >= low) & (at + first < low + PIECE)]
            ats.append(at + first)
            hashes.append(hashed[at])
        mixed = np.concatenate(hashes) * np.uint64(ODD)
        return np.concatenate(ats), (mixed ^ (mixed >> np.uint64(32))) * np.uint64(ODD)

    def suffixes(self, chosen: np.ndarray) -> np.ndarray:
        """(len(chosen), KEY): key of each chosen anchor (indices into ``anchors``)."""
        at, doc = self.anchors[chosen], self.docs[chosen]
        out = np.zeros((len(at), KEY), np.uint8)
        out[:, 0] = ANCHORED
        ahead = np.minimum(self.ends[doc] - at, SPAN)
        back = np.minimum(at - self.starts[doc], REACH)
        padded = np.concatenate([np.zeros(REACH, np.uint8), self.data, np.zeros(SPAN, np.uint8)])
        near = np.lib.stride_tricks.sliding_window_view(padded, REACH + SPAN)[at]
        out[:, 1 : 1 + K] = near[:, REACH : REACH + K]
        out[:, AHEAD:BACK] = np.where(np.arange(K, SPAN) < ahead[:, None], near[:, REACH + K :], 0)
        out[:, BACK:SIZES] = np.where(np.arange(REACH) < back[:, None], near[:, REACH - 1 :: -1], 0)
        out[:, SIZES] = ahead
        out[:, SIZES + 1] = back + 1
        return out

    def strings(self, at: np.ndarray) -> np.ndarray:
        """(len(at), KEY): key of the SPAN-byte string at each position."""
        out = np.zeros((len(at), KEY), np.uint8)
        out[:, 0] = WHOLE
        if len(at):
            here = np.lib.stride_tricks.sliding_window_view(self.data, SPAN)[at]
            out[:, 1 : 1 + K] = here[:, :K]
            out[:, AHEAD:BACK] = here[:, K:]
        out[:, SIZES] = SPAN
        out[:, SIZES + 1] = 1
        return out


def _words(keys: np.ndarray) -> np.ndarray:
    """(n, WORDS): the keys as big-endian numbers of WORD bytes, which sort like the bytes."""
    out = np.zeros((len(keys), WORDS, 8), np.uint8)
    out[:, :, 1:] = keys.reshape(-1, WORDS, WORD)
    return out.view(">u8")[:, :, 0].astype(np.uint64)


def _bytes(words: np.ndarray) -> np.ndarray:
    """(n, KEY): the bytes of the words."""
    return np.ascontiguousarray(words.astype(">u8").view(np.uint8).reshape(-1, WORDS, 8)[:, :, 1:]).reshape(-1, KEY)


def _pack(data: np.ndarray | bytes) -> bytes:
    return pa.compress(data if isinstance(data, bytes) else data.tobytes(), codec="zstd", asbytes=True)


def _unpack(data: bytes, count: int, kind: type) -> np.ndarray:
    size = count * np.dtype(kind).itemsize
    return np.frombuffer(pa.decompress(data, decompressed_size=size, codec="zstd", asbytes=True), kind) if count else np.zeros(0, kind)


def _planes(numbers: np.ndarray) -> bytes:
    """Numbers compressed with their byte planes apart."""
    return _pack(np.ascontiguousarray(numbers.view(np.uint8).reshape(len(numbers), -1).T))


def _unplanes(data: bytes, count: int, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(_unpack(data, count * width, np.uint8).reshape(width, count).T).view(kind).ravel()


class Run:
    """A block's sorted, distinct entries (``words``, ``least`` id), and the members of each: ``position``, in
    the order of entries, ``new`` where an entry begins, ``over`` where the id is not the entry's least."""

    def __init__(self, text: Text, shared: np.ndarray, hot: np.ndarray):
        short = text.hashes >> np.uint64(8)
        is_hot = _among(short, hot)
        plain = np.flatnonzero(_among(short, shared))
        at, doc = text.anchors[is_hot], text.docs[is_hot]
        low = np.maximum(at - REACH, text.starts[doc])
        count = np.maximum(np.minimum(at, text.ends[doc] - SPAN) - low + 1, 0)
        first = np.cumsum(count) - count
        whole = np.unique(np.repeat(low - first, count) + np.arange(int(count.sum())))
        words = _words(np.concatenate([text.suffixes(plain), text.strings(whole)]))
        position = np.concatenate([text.anchors[plain], whole])
        doc = np.concatenate([text.docs[plain], np.searchsorted(text.ends, whole, side="right")]).astype(np.int64)
        order = np.lexsort(words.T[::-1])
        words = words[order]
        self.new = np.ones(len(words), bool)
        self.new[1:] = (words[1:] != words[:-1]).any(axis=1)
        self.position = position[order]
        self.words = words[self.new]
        ids = text.ids[doc[order]]
        self.least = np.minimum.reduceat(ids, np.flatnonzero(self.new)) if len(ids) else ids
        self.over = ids > self.least[np.cumsum(self.new) - 1]
        self.anchored = int(np.count_nonzero(self.words[:, 0] >> np.uint64(8 * (WORD - 1)) == ANCHORED))

    def encode(self, low: int, high: int) -> tuple[bytes, bytes, bytes]:
        """Entries low to high, front-coded: numbers of shared words, the other words, and the smallest ids."""
        words = self.words[low:high]
        shared = np.zeros(len(words), np.uint8)
        shared[1:] = (words[1:] != words[:-1]).argmax(axis=1)
        rest = words[np.arange(WORDS)[None, :] >= shared[:, None]]
        return shared.tobytes(), _pack(np.ascontiguousarray(rest.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 1:])), _planes(self.least[low:high])


def _among(hashes: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Whether each hash is among ``known``, which is sorted."""
    if not len(known):
        return np.zeros(len(hashes), bool)
    return known[np.minimum(np.searchsorted(known, hashes), len(known) - 1)] == hashes


def _decode(shared: bytes, rest: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(words, codes) of a front-coded run."""
    prefix = np.frombuffer(shared, np.uint8).astype(np.int64)
    n = len(prefix)
    raw = np.zeros((int((WORDS - prefix).sum()), 8), np.uint8)
    raw[:, 1:] = _unpack(rest, len(raw) * WORD, np.uint8).reshape(-1, WORD)
    raw = raw.view(">u8").ravel().astype(np.uint64)
    own = np.arange(WORDS)[None, :] >= prefix[:, None]
    words = np.zeros((n, WORDS), np.uint64)
    words[own] = raw
    for j in range(WORDS):
        words[:, j] = words[np.maximum.accumulate(np.where(own[:, j], np.arange(n), 0)), j]
    first = np.cumsum(WORDS - prefix) - (WORDS - prefix)
    return words, (np.uint64(WORDS) - prefix.astype(np.uint64) << np.uint64(8 * WORD)) | raw[first]


def _routes(words: np.ndarray) -> np.ndarray:
    """What an entry is dealt out by: the anchor, or the whole string; a group never straddles a splitter."""
    keys = _bytes(words)
    out = np.concatenate([keys[:, 1 : 1 + K], keys[:, AHEAD:BACK]], axis=1)
    out[keys[:, 0] == ANCHORED, K:] = 0
    return np.ascontiguousarray(out).view(f"S{SPAN}").ravel()


def merged(codes: list[list[int]], keys: list[bytes]) -> tuple[list[int], list[int], list[int]]:
    """(run, entry, code) of all entries in order of keys.  ``codes``: of each run, relative to the entry
    before; ``keys``: the run's keys, one after the other.

    A loser tree: each inner node keeps the loser of its match.  A code is the number of words from the
    first one that differs from the last key put out (0: none does), then that word; the smaller code is
    the smaller key, and the larger one stays right relative to the winner.  Equal codes: the words behind
    decide, and the loser's code tells where they differ.
    """
    n, high = len(codes), 8 * WORD
    size = 1
    while size < n:
        size *= 2
    done = (WORDS + 1) << high
    code = [c[0] if c else done for c in codes] + [done] * (size - n)
    entry = [0] * size

    def tie(a: int, b: int) -> bool:
        """Whether player b wins against a, whose code is equal."""
        c = code[a]
        if not c or c == done:
            return False
        at = (WORDS + 1 - (c >> high)) * WORD
        e, f = entry[a] * KEY, entry[b] * KEY
        x, y = keys[a][e + at : e + KEY], keys[b][f + at : f + KEY]
        if x == y:
            code[b] = 0
            return False
        wins = y < x
        k = 0
        while x[k : k + WORD] == y[k : k + WORD]:
            k += WORD
        lost = x if wins else y
        code[a if wins else b] = (KEY - at - k) // WORD << high | int.from_bytes(lost[k : k + WORD], "big")
        return wins

    loser, winners, node = [0] * size, list(range(size)), size
    while len(winners) > 1:
        node //= 2
        after = []
        for i in range(0, len(winners), 2):
            a, b = winners[i], winners[i + 1]
            if code[b] < code[a] or (code[a] == code[b] and tie(a, b)):
                a, b = b, a
            loser[node + i // 2] = b
            after.append(a)
        winners = after
    runs, entries, out = [], [], []
    win = winners[0]
    c = code[win]
    while c < done:
        e = entry[win]
        runs.append(win)
        entries.append(e)
        out.append(c)
        e += 1
        entry[win] = e
        own = codes[win]
        c = code[win] = own[e] if e < len(own) else done
        node = (size + win) >> 1
        while node:
            other = loser[node]
            d = code[other]
            if d < c:
                loser[node], win, c = win, other, d
            elif d == c and tie(win, other):
                loser[node], win = win, other
                c = code[win]
            node >>= 1
    return runs, entries, out


def _neighbours(x: np.ndarray) -> np.ndarray:
    """How many leading bytes each row shares with the row before (none: the first)."""
    differ = np.ones((len(x), x.shape[1] + 1), bool)
    differ[1:, :-1] = x[1:] != x[:-1]
    out = differ.argmax(axis=1)
    out[:1] = -1
    return out


def masks(words: np.ndarray, prefix: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """A mask for each of the sorted, merged entries; ``prefix``: words shared with the entry before.  Bit o
    is set if the string that starts o bytes before the anchor occurs at a smaller id."""
    bits = np.zeros(len(words), np.int32)
    if not len(words):
        return bits
    whole = words[:, 0] >> np.uint64(8 * (WORD - 1)) == WHOLE
    group = np.cumsum(prefix < np.where(whole, WORDS, LEAD))
    many = np.bincount(group)[group] > 1
    at = np.flatnonzero(many & whole)
    if len(at):
        first = np.flatnonzero(np.concatenate([[True], np.diff(group[at]) > 0]))
        least = np.minimum.reduceat(ids[at], first)
        bits[at] = ids[at] > np.repeat(least, np.diff(np.append(first, len(at))))
    at = np.flatnonzero(many & ~whole)
    if not len(at):
        return bits
    keys, ids, group = _bytes(words[at]), ids[at], group[at]
    ahead, back = keys[:, SIZES].astype(np.int64), keys[:, SIZES + 1].astype(np.int64) - 1
    forwards = _neighbours(keys[:, AHEAD:BACK])
    forwards[np.concatenate([[True], np.diff(group) > 0])] = -1
    behind = np.zeros((len(at), -(-REACH // 8) * 8), np.uint8)
    behind[:, :REACH] = keys[:, BACK:SIZES]
    order = np.lexsort(behind.view(">u8").astype(np.uint64).T[::-1])
    backwards = _neighbours(behind[order, :REACH])
    mine, behind_class = np.zeros(len(at), np.int32), np.zeros(len(at), np.int64)
    for o in range(REACH + 1):
        # equal numbers: equal bytes from the anchor on, or before it, as far as the string reaches
        behind_class[order] = np.cumsum(backwards < o)
        string = np.cumsum(forwards < REACH - o) * (len(at) + 1) + behind_class
        has = np.flatnonzero((back >= o) & (ahead >= SPAN - o))
        if not len(has):
            continue
        string = string[has]
        sorted_ = np.argsort(string, kind="stable")
        string = string[sorted_]
        first = np.flatnonzero(np.concatenate([[True], string[1:] != string[:-1]]))
        least = np.repeat(np.minimum.reduceat(ids[has[sorted_]], first), np.diff(np.append(first, len(has))))
        sorted_ = has[sorted_]
        mine[sorted_[ids[sorted_] > least]] |= 1 << o
    bits[at] = mine
    return bits


def _deltas(sorted_: np.ndarray) -> bytes:
    """Sorted 56-bit numbers as compressed differences, byte planes apart."""
    return _planes(np.diff(sorted_, prepend=np.uint64(0)))


def _undelta(data: bytes, n: int) -> np.ndarray:
    return np.cumsum(_unplanes(data, n, np.uint64), dtype=np.uint64)


def _shared_anchors(blocks: DataFrame, buckets: int, rate: int) -> tuple[DataFrame, list[bytes]]:
    """(block, n, shared, n_hot, hot): the shared anchors of each block, and a sample of them as bytes."""
    schema = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("n", pa.int32()), ("hashes", pa.binary()), ("counts", pa.binary()), ("picked", pa.binary()), ("anchors", pa.binary())])

    def emit(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for block, ids, lengths, blob in zip(*[c.to_pylist() for c in batch.columns]):
                text = Text(unpack(blob, lengths), ids, lengths)
                if not len(text.anchors):
                    continue
                short = text.hashes >> np.uint64(8)
                order = np.argsort(short, kind="stable")  # anchors are in order of documents
                short, docs, anchors = short[order], text.docs[order], text.anchors[order]
                fresh = np.concatenate([[True], (short[1:] != short[:-1])])
                apart = fresh | np.concatenate([[True], docs[1:] != docs[:-1]])
                at = np.flatnonzero(fresh)
                counts = np.minimum(np.add.reduceat(apart.astype(np.int64), at), 65535).astype(np.uint16)
                short, anchors = short[at], anchors[at]
                bucket = (short.astype(np.float64) / 2.0**56 * buckets).astype(np.int64)
                picked = (short ^ np.uint64(block & (1 << 64) - 1)) * np.uint64(ODD) >> np.uint64(33) < np.uint64((1 << 31) // rate)
                cuts = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]])
                rows = {k: [] for k in schema.names}
                for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                    few = np.flatnonzero(picked[a:b])
                    bytes_ = text.data[anchors[a:b][few, None] + np.arange(K)] if len(few) else few
                    for k, v in zip(rows, (int(bucket[a]), block, b - a, _deltas(short[a:b]), _pack(counts[a:b]), few.astype(np.int32).tobytes(), bytes_.tobytes())):
                        rows[k].append(v)
                yield pa.RecordBatch.from_pydict(rows, schema)

    sent = blocks.select("block", "ids", "lengths", "blob").mapInArrow(emit, "bucket int, block long, n int, hashes binary, counts binary, picked binary, anchors binary")

    def detect(rows: pd.DataFrame) -> pd.DataFrame:
        hashes = np.concatenate([_undelta(h, n) for h, n in zip(rows["hashes"], rows["n"])])
        counts = np.concatenate([_unpack(c, n, np.uint16) for c, n in zip(rows["counts"], rows["n"])]).astype(np.int64)
        order = np.argsort(hashes, kind="stable")
        sorted_ = hashes[order]
        at = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]]))
        total = np.empty(len(order), np.int64)
        total[order] = np.repeat(np.add.reduceat(counts[order], at), np.diff(np.append(at, len(order))))
        ends = np.cumsum(rows["n"].to_numpy(np.int64))
        out = []
        for block, n, end, picked, anchors in zip(rows["block"], rows["n"], ends.tolist(), rows["picked"], rows["anchors"]):
            h, t = hashes[end - n : end], total[end - n : end]
            shared, hot = h[(t > 1) & (t <= HOT)], h[t > HOT]
            few = np.frombuffer(picked, np.int32)
            sample = np.frombuffer(anchors, np.uint8).reshape(len(few), K)[t[few] > 1].tobytes()
            if len(shared) or len(hot):
                out.append((block, len(shared), _deltas(shared) if len(shared) else b"", len(hot), _deltas(hot) if len(hot) else b"", sample))
        return pd.DataFrame(out, columns=["block", "n", "shared", "n_hot", "hot", "sample"])

    back = settle(sent.groupBy("bucket").applyInPandas(detect, "block long, n int, shared binary, n_hot int, hot binary, sample binary"), "shared")
    sample: list[bytes] = []
    for row in back.where("length(sample) > 0").select("sample").toLocalIterator():
        sample += [bytes(row[0][k : k + K]) for k in range(0, len(row[0]), K)]
    return back.drop("sample"), sample


def _known(parts: list | None) -> tuple[np.ndarray, np.ndarray]:
    """Shared and hot hashes of a block from its buckets' answers."""
    cat = lambda xs: np.sort(np.concatenate(xs)) if xs else np.zeros(0, np.uint64)
    parts = parts or []
    return cat([_undelta(p["shared"], p["n"]) for p in parts if p["n"]]), cat([_undelta(p["hot"], p["n_hot"]) for p in parts if p["n_hot"]])


def _judge(rows: pd.DataFrame) -> list[tuple[int, int, bytes, bytes]]:
    """(block, entries, their numbers, their masks) of a key range's runs."""
    words, codes, ids, place = [], [], [], []
    for block, first, shared, rest, least in zip(rows["block"], rows["first"], rows["shared"], rows["rest"], rows["least"]):
        w, c = _decode(shared, rest)
        words.append(w)
        codes.append(c.tolist())
        ids.append(_unplanes(least, len(w), np.int64))
        place.append((block, first))
    start = np.cumsum([0, *map(len, words)])
    run, entry, code = (np.array(x, np.int64) for x in merged(codes, [_bytes(w).tobytes() for w in words]))
    at = start[run] + entry
    words, ids = np.concatenate(words)[at], np.concatenate(ids)[at]
    bits = masks(words, WORDS - (code >> 8 * WORD), ids)
    hit = np.flatnonzero(bits)
    hit = hit[np.argsort(run[hit], kind="stable")]
    cuts = np.searchsorted(run[hit], np.arange(len(place) + 1))
    out = []
    for (block, first), a, b in zip(place, cuts[:-1].tolist(), cuts[1:].tolist()):
        if b > a:
            out.append((block, b - a, _planes((entry[hit[a:b]] + first).astype(np.int32)), _planes(bits[hit[a:b]])))
    return out


def dedupe(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, version, n_bytes, n_removed, n_spans, kept_sha256, spans): ``spans`` lists [start, end) of
    the removed runs in bytes."""
    blocks = pack(docs, lambda t: t.encode("utf-8", "surrogatepass"), id_col, text_col)
    total = blocks.agg(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    # many more ranges than tasks: which task gets a range is left to a hash
    parts = max(4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // RANGE_BYTES))
    shared, sample = _shared_anchors(blocks, parts, max(1, total // 14 // (SAMPLE * 4 * parts)))
    sample.sort()
    cuts = np.array(sorted({sample[k * len(sample) // parts] for k in range(1, parts)}) if sample else [], f"S{SPAN}")
    known = shared.groupBy("block").agg(F.collect_list(F.struct("n", "shared", "n_hot", "hot")).alias("parts"))
    fed = blocks.join(known, "block").select("block", "ids", "lengths", "blob", "parts")
    sent = "part int, owner long, block long, first int, shared binary, rest binary, least binary"

    def runs(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
        schema = pa.schema(list(zip(("part", "owner", "block", "first", "shared", "rest", "least"), kinds)))
        for batch in stream:
            for block, ids, lengths, blob, parts_ in zip(*[c.to_pylist() for c in batch.columns]):
                run = Run(Text(unpack(blob, lengths), ids, lengths), *_known(parts_))
                if not len(run.words):
                    continue
                # whole strings have ranges of their own: the same splitters, one kind further
                part = np.searchsorted(cuts, _routes(run.words), side="right")
                part[run.anchored :] += len(cuts) + 1
                bounds = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(part)]]).tolist()
                rows = [(int(part[a]), 0, block, a, *run.encode(a, b)) for a, b in zip(bounds[:-1], bounds[1:])]
                flags = np.packbits(np.stack([run.new, run.over])).tobytes()
                rows.append((-1, block, block, run.anchored, np.int64(len(run.new)).tobytes(), _planes(run.position.astype(np.int32)), flags))
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], schema=schema)

    def merge(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        if key[0] < 0:  # the members of a block's entries only pass through
            out = [(b, int(np.frombuffer(n, np.int64)[0]), x, flags, first) for b, first, n, x, flags in zip(rows["block"], rows["first"], rows["shared"], rows["rest"], rows["least"])]
        else:
            out = [(*x, None) for x in _judge(rows)]
        return pd.DataFrame(out, columns=["block", "n", "entries", "masks", "anchored"]).astype({"anchored": "Int32"})

    judged = fed.mapInArrow(runs, sent).groupBy("part", "owner").applyInPandas(merge, "block long, n int, entries binary, masks binary, anchored int")
    answers = settle(judged, "masks").groupBy("block").agg(F.collect_list(F.struct("n", "entries", "masks", "anchored")).alias("answers"))
    last = blocks.join(answers, "block", "left").select("ids", "versions", "lengths", "blob", "answers")

    def cover(lengths: np.ndarray, answers_: list) -> np.ndarray:
        """How many more removed strings begin than end at each byte of a block."""
        out = np.zeros(int(lengths.sum()) + 1, np.int32)
        member = next((a for a in answers_ if a["anchored"] is not None), None)
        if member is None:
            return out
        position = _unplanes(member["entries"], member["n"], np.int32).astype(np.int64)
        new, over = np.unpackbits(np.frombuffer(member["masks"], np.uint8), count=2 * member["n"]).reshape(2, -1).astype(bool)
        entry = np.cumsum(new) - 1
        mask = np.zeros(int(new.sum()), np.int64)
        for a in answers_:
            if a["anchored"] is None:
                mask[_unplanes(a["entries"], a["n"], np.int32)] = _unplanes(a["masks"], a["n"], np.int32)
        ends = np.cumsum(lengths)
        doc = np.searchsorted(ends, position, side="right")
        ahead, back = np.minimum(ends[doc] - position, SPAN), np.minimum(position - (ends - lengths)[doc], REACH)
        whole = entry >= member["anchored"]
        ahead[whole], back[whole] = SPAN, 0
        valid = (np.int64(1) << back + 1) - (np.int64(1) << SPAN - ahead)
        bits = np.where(over, np.int64(-1), mask[entry]) & np.maximum(valid, 0)
        at = np.concatenate([position[bits >> o & 1 == 1] - o for o in range(REACH + 1)])
        np.add.at(out, at, 1)
        np.add.at(out, at + SPAN, -1)
        return out

    def apply(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [("doc_id", pa.int64()), ("version", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()),
             ("kept_sha256", pa.string()), ("spans", pa.list_(pa.list_(pa.int64())))]
        )
        for batch in stream:
            for ids, versions, lengths, blob, answers_ in zip(*[c.to_pylist() for c in batch.columns]):
                data, size = unpack(blob, lengths), np.array(lengths, np.int64)
                gone = np.cumsum(cover(size, answers_ or []), dtype=np.int32)[:-1] > 0
                ends = np.cumsum(size)
                starts = ends - size
                sums = np.concatenate([[0], np.cumsum(gone)])
                removed = (sums[ends] - sums[starts]).tolist()
                rows = []
                for doc, version, start, n, less in zip(ids, versions, starts.tolist(), lengths, removed):
                    kept, spans = data[start : start + n], []
                    if less:
                        piece = gone[start : start + n]
                        spans = np.flatnonzero(np.diff(np.concatenate([[False], piece, [False]]).view(np.int8))).reshape(-1, 2).tolist()
                        kept = kept[~piece]
                    rows.append((doc, version, n, less, len(spans), hashlib.sha256(np.ascontiguousarray(kept)).hexdigest(), spans))
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return last.mapInArrow(
        apply, "doc_id long, version long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<array<long>>"
    )
