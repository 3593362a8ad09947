"""Removal of word passages that repeat anywhere in the corpus, by recompression.

Recompression rewrites all texts at once, round by round: runs of one word become one symbol, then pairs of
neighbouring symbols do. Names are made from the names of what they stand for, and which pairs unite is decided
by the two names alone, so equal passages get equal symbols in their interior wherever they stand, and every
worker names alike without asking. A symbol keeps the range of words on which its being there depends: wherever
that range of words occurs again, the symbol does.

1. All symbols are counted across the corpus, in blocks of names. A window of words that occurs twice holds
   repeated symbols only. Which names repeat is told to all by a table of bits, sized by the corpus up to a bound
   (a full table would cost candidates, never results); a small second table tells which are very common.
2. Windows that hold no symbol of which there is but one are the candidates. They go, as text, to blocks of a key
   that neighbouring windows mostly share: the least name of the symbols near their starts, or the hash of the
   window itself where that name is very common. There those of equal hashes are compared byte by byte: those met
   twice are repeats.
3. Each text, joined with its repeated windows, loses the words that they cover.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnmill.llm.wordscan import LEADING, PLAIN_WORDS, U64, Words, mix, plain_words, rolled, scan

WINDOW = 35
#: Rounds of pairing: symbols of about 5 words, which depend on about 15.
ROUNDS = 6
#: Least and most bits of the table of repeated names, as powers of two (128 MB at most), and bits of that of common ones.
BITS, COMMON_BITS = (20, 30), 20
#: Names or windows of a block, and of a mapper's batch.
BLOCK, BATCH = 1_000_000, 500_000
#: Occurrences from which on a name is very common: its windows would fill a good part of a block.
COMMON = BLOCK // (4 * WINDOW)
_FAR = 1 << 40
_SEEDS = [U64(0x9E3779B97F4A7C15 * (2 * k + 1) % (1 << 64)) for k in range(32)]


def recompress(words: Words, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of the texts after `rounds` rounds: name, and the range [low, high) of words that it depends on.

    A range that reaches over its text's edge is put far off: such symbols lie in no window.
    """
    name, doc = words.hashes, words.docs()
    low = np.arange(len(name))
    high = low + 1
    if not len(name):
        return name, low, high

    def edges() -> tuple[np.ndarray, np.ndarray]:
        inner = doc[1:] == doc[:-1]
        return np.append(False, inner), np.append(inner, False)  # has a neighbour before, after

    # A range must follow from the words in it alone, else equal passages would count their symbols apart.
    def before(x: np.ndarray, there: np.ndarray, far: int) -> np.ndarray:
        return np.where(there, np.roll(x, 1), far)

    def after(x: np.ndarray, there: np.ndarray, far: int) -> np.ndarray:
        return np.where(there, np.roll(x, -1), far)

    # runs: a word, or several equal ones, between others; it depends on the words next to it
    left, _ = edges()
    head = np.flatnonzero(~(left & (name == np.roll(name, 1))))
    tail = np.append(head[1:], len(name)) - 1
    times = (tail - head + 1).astype(U64)
    name, doc, low, high = np.where(times > 1, mix(name[head] * _SEEDS[0] + times), name[head]), doc[head], low[head], high[tail]
    left, right = edges()
    low, high = np.where(left, low - 1, -_FAR), np.where(right, high + 1, _FAR)
    for r in range(1, rounds + 1):
        left, right = edges()
        opens = (mix(name ^ _SEEDS[r]) & U64(1)).astype(bool)
        pair = opens & right & ~np.roll(opens, -1)
        second = np.append(False, pair[:-1])
        single = ~pair & ~second
        joins_next, joins_last = pair | (single & opens), single & ~opens
        next_low, next_high = after(low, right, _FAR), after(high, right, _FAR)
        last_low, last_high = before(low, left, -_FAR), before(high, left, -_FAR)
        low, high = (
            np.where(joins_next, np.minimum(low, next_low), np.where(joins_last, np.minimum(low, last_low), low)),
            np.where(joins_next, np.maximum(high, next_high), np.where(joins_last, np.maximum(high, last_high), high)),
        )
        name = np.where(pair, mix(name * _SEEDS[r] + np.roll(name, -1)), name)
        keep = ~second
        name, doc, low, high = name[keep], doc[keep], low[keep], high[keep]
    return name, low, high


def table_bits(size: int) -> int:
    """Bits for texts of so many bytes: eight for each symbol that they may hold (one in about 30 bytes), within bounds."""
    return min(max(int(np.ceil(np.log2(max(size, 1) / 30 * 8))), BITS[0]), BITS[1])


def _bit(name: np.ndarray, bits: int) -> np.ndarray:
    return (mix(name ^ _SEEDS[31]) >> U64(64 - bits)).astype(np.int64)


def _set(table: np.ndarray, bit: np.ndarray) -> np.ndarray:
    return (table[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8)) & 1 > 0


def candidates(words: Words, repeated: np.ndarray, window: int, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """First words of the windows that hold no symbol known to be single, and a key for each.

    The key is the least name among the symbols near the window's start (all bits set if there is none): equal windows have
    equal keys, and neighbouring windows mostly share theirs. repeated: the table, packed.
    """
    bits = int(np.log2(8 * len(repeated)))
    n = len(words.hashes)
    if n < window:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    name, low, high = recompress(words, rounds)
    used = (high - low <= window) & (low >= 0)
    name, low, high = name[used], low[used], high[used]
    lone = ~_set(repeated, _bit(name, bits))
    edge = np.zeros(n + 2, np.int64)
    np.add.at(edge, np.maximum(high[lone] - window, 0), 1)
    np.add.at(edge, low[lone] + 1, -1)
    start = np.flatnonzero(np.cumsum(edge[:n]) == 0)
    ends = words.offsets[1:][words.docs()]
    start = start[start + window <= ends[start]]
    # symbols of at most half a window that begin in its first half lie in it, whatever surrounds it
    half = window // 2
    key = np.full(n + window, ~U64(0))
    short = high - low <= window - half
    key[low[short]] = mix(name[short])
    span, have, least = 1, half, None
    for bit in range(half.bit_length()):
        if half >> bit & 1:
            done = half - have
            least = key[done : done + n] if least is None else np.minimum(least, key[done : done + n])
            have -= span
        key = np.minimum(key[:-span], key[span:]) if 2 * span <= half else key
        span *= 2
    return start, least[start]


def _name_blocks(rows: DataFrame, slices: int, bits: int, window: int, rounds: int) -> DataFrame:
    """Names by block (a slice of the table of bits); each name once per batch, and how often it was met (255 at most)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            names, counts = np.unique(np.concatenate(held), return_counts=True)
            block = _bit(names, bits) // ((1 << bits) // slices)
            order = np.argsort(block, kind="stable")
            out: tuple[list, list, list] = ([], [], [])
            for own in np.split(order, np.flatnonzero(np.diff(block[order])) + 1):
                for x, v in zip(out, (int(block[own[0]]), names[own].tobytes(), np.minimum(counts[own], 255).astype("u1").tobytes())):
                    x.append(v)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.binary())], names=["block", "names", "times"])

        amount = 0
        for b in batches:
            for words in scan(b.column(0), PLAIN_WORDS):
                name, low, high = recompress(words, rounds)
                used = (high - low <= window) & (low >= 0)
                held.append(name[used])
                amount += int(used.sum())
                if amount >= BATCH:
                    yield flush()
                    amount = 0
        if amount:
            yield flush()

    return rows.select("_text").mapInArrow(run, "block int, names binary, times binary")


def repeated_names(rows: DataFrame, size: int, window: int = WINDOW, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """The tables of bits, packed: names met twice or more, by name; very common ones, by the key that they make."""
    bits, slices = table_bits(size), 16
    while slices < min(size // (30 * BLOCK), 1 << bits - 3):
        slices *= 2
    width = (1 << bits) // slices

    def count(table: pa.Table) -> pa.Table:
        names = np.concatenate([np.frombuffer(x.as_py(), U64) for x in table.column("names")])
        times = np.concatenate([np.frombuffer(x.as_py(), "u1") for x in table.column("times")])
        names, which = np.unique(names, return_inverse=True)
        times = np.bincount(which, times)
        found = np.zeros(width, np.uint8)
        found[_bit(names[times > 1], bits) % width] = 1
        common = np.unique(mix(names[times >= COMMON]) >> U64(64 - COMMON_BITS)).astype("<u4")
        return pa.table({"block": table.column("block")[:1], "bits": pa.array([zlib.compress(np.packbits(found).tobytes(), 1)], pa.binary()), "common": pa.array([common.tobytes()], pa.binary())})

    out, common = np.zeros((slices, width // 8), np.uint8), np.zeros(1 << COMMON_BITS, np.uint8)
    for block, found, many in _name_blocks(rows, slices, bits, window, rounds).groupBy("block").applyInArrow(count, "block int, bits binary, common binary").toLocalIterator():
        out[block] = np.frombuffer(zlib.decompress(found), np.uint8)
        common[np.frombuffer(many, "<u4")] = 1
    return out.ravel(), np.packbits(common)


def _ranges(owner: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """For each owner: its starts as ranges (first, number), packed. Sorted by owner, start."""
    if not len(owner):
        return owner, []
    order = np.lexsort((start, owner))
    owner, start = owner[order], start[order]
    head = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (start[1:] != start[:-1] + 1)))
    pairs = np.column_stack([start[head], np.diff(np.append(head, len(start)))]).astype("<u4")
    first = np.flatnonzero(np.append(True, owner[head][1:] != owner[head][:-1]))
    return owner[head][first], [p.tobytes() for p in np.split(pairs, first[1:])]


def differing(data: np.ndarray, a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Whether the bytes at a and at b differ, pair by pair: eight at a time, all pairs together."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    lanes = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    out = size_a != size_b
    some, at = np.flatnonzero(~out), 0
    while len(some):
        x = lanes[a[some] + at] ^ lanes[b[some] + at]
        out[some] = (x & LEADING[np.minimum(size_a[some] - at, 8)]) != 0
        at += 8
        some = some[~out[some] & (size_a[some] > at)]
    return out


def _spelled(words: Words, cover: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The covered words as bytes, a space after each; and for each word of the texts where it begins and ends there."""
    k = np.flatnonzero(cover)
    size = words.ends[k] - words.starts[k]
    first = np.cumsum(size + 1) - size - 1
    out = np.full(int((size + 1).sum()), 0x20, np.uint8)
    step = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    out[np.repeat(first, size) + step] = words.data[np.repeat(words.starts[k], size) + step]
    begin, end = np.zeros(len(cover), np.int64), np.zeros(len(cover), np.int64)
    begin[k], end[k] = first, first + size
    return out, begin, end


def _packed(text: bytes) -> bytes:
    """Compressed, behind its length."""
    return len(text).to_bytes(8, "little") + pa.compress(text, codec="zstd", asbytes=True)


def _unpacked(raw: bytes) -> bytes:
    return pa.decompress(raw[8:], decompressed_size=int.from_bytes(raw[:8], "little"), codec="zstd", asbytes=True)


_BLOCK = "block int, batch long, at binary, n binary, doc binary, runs binary, again binary, ka binary, kb binary, known_doc binary, known array<binary>"


def _window_blocks(rows: DataFrame, table, common, blocks: int, window: int, rounds: int) -> DataFrame:
    """Candidate windows by block, as runs of windows that follow one another, with their words.

    What repeats within a batch is known at once, and goes on once with a mark. One row of each batch, whichever
    comes first, carries its table of documents and what is known of them.
    """
    names = [f.split()[0] for f in _BLOCK.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = table.value
        held: list[tuple] = []
        keys: list[tuple] = []
        label = TaskContext.get().partitionId() << 33

        def flush(label: int) -> pa.RecordBatch:
            h, key, at, doc, begin, size, text = zip(*held)
            base = np.cumsum([0, *map(len, text)])
            begin = np.concatenate([x + y for x, y in zip(begin, base)])
            h, key, at, doc, size, text = (np.concatenate(x) for x in (h, key, at, doc, size, text))
            ka, kb = (np.concatenate(x) for x in zip(*keys))
            order = np.lexsort((key, h))
            h, key, at, doc, begin, size = (x[order] for x in (h, key, at, doc, begin, size))
            same = (h[1:] == h[:-1]) & (key[1:] == key[:-1])
            pair = np.flatnonzero(same)
            same[pair] = ~differing(text, begin[pair], begin[pair + 1], size[pair], size[pair + 1])
            again = np.append(same, False) | np.append(False, same)
            first = np.append(True, ~same)
            who, known = _ranges(doc[again], at[again])
            key, at, doc, begin, size, again = (x[first] for x in (key, at, doc, begin, size, again))
            block = (mix(key) % U64(blocks)).astype(np.int64)
            order = np.lexsort((at, doc, block))
            out: list[list] = [[] for _ in names]
            for k, own in enumerate(np.split(order, np.flatnonzero(np.diff(block[order])) + 1)):
                head = np.flatnonzero(np.append(True, (doc[own][1:] != doc[own][:-1]) | (at[own][1:] != at[own][:-1] + 1)))
                tail = np.append(head[1:], len(own)) - 1
                runs = b"\n".join(text[x:y].tobytes() for x, y in zip(begin[own[head]].tolist(), (begin[own[tail]] + size[own[tail]]).tolist()))
                rest = (ka.tobytes(), kb.tobytes(), who.astype("<u4").tobytes(), known) if k == 0 else (b"", b"", b"", [])
                values = (int(block[own[0]]), label, at[own[head]].astype("<u4").tobytes(), (tail - head + 1).astype("<u4").tobytes(), doc[own[head]].astype("<u4").tobytes(), _packed(runs), np.packbits(again[own]).tobytes(), *rest)
                for x, v in zip(out, values):
                    x.append(v)
            held.clear()
            keys.clear()
            return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.int64()), *[pa.array(x, pa.binary()) for x in out[2:10]], pa.array(out[10], pa.list_(pa.binary()))], names=names)

        amount = docs = done = 0
        for b in batches:
            for words in scan(b.column(0), PLAIN_WORDS):
                start, key = candidates(words, bits, window, rounds)
                if not len(start):
                    continue
                doc = words.docs()[start]
                met, local = np.unique(doc, return_inverse=True)  # texts without candidates need no place
                h = rolled(words.hashes, window)[start]
                alone = (key == ~U64(0)) | _set(common.value, (key >> U64(64 - COMMON_BITS)).astype(np.int64))
                text, begin, end = _spelled(words, covered(len(words.hashes), [_as_ranges(start)], window))
                held.append((h, np.where(alone, h, key), start - words.offsets[doc], local + docs, begin[start], end[start + window - 1] - begin[start], text))
                keys.append(tuple(b.column(c).slice(words.first, len(words.counts)).to_numpy(zero_copy_only=False)[met] for c in (1, 2)))
                docs += len(met)
                amount += len(start)
                if amount >= BATCH:
                    yield flush(label + done)
                    amount = docs = 0
                    done += 1
        if amount:
            yield flush(label + done)

    return rows.select("_text", "ka", "kb").mapInArrow(run, _BLOCK)


def _as_ranges(start: np.ndarray) -> bytes:
    """Ascending starts as packed ranges (first, number)."""
    return _ranges(np.zeros(len(start), np.int64), start)[1][0]


def _equal_windows(runs: list[bytes], n: np.ndarray, window: int) -> np.ndarray:
    """The class of each window of the runs (n[k] windows in run k): equal classes are equal words, byte by byte."""
    h, begin, end = [], [], []
    column = pa.array(runs, pa.large_binary())
    base = 0
    for words in scan(column, PLAIN_WORDS):
        docs = len(words.counts)
        own = n[words.first : words.first + docs]
        at = np.repeat(words.offsets[:-1], own) + np.arange(int(own.sum())) - np.repeat(np.cumsum(own) - own, own)
        h.append(rolled(words.hashes, window)[at])
        begin.append(words.starts[at] + base)
        end.append(words.ends[at + window - 1] + base)
        base += len(words.data)
    h, begin, end = (np.concatenate(x) for x in (h, begin, end))
    data = np.frombuffer(b"".join(runs), np.uint8)
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    pair = np.flatnonzero(same)
    a, b = order[pair], order[pair + 1]
    wrong = pair[differing(data, begin[a], begin[b], (end - begin)[a], (end - begin)[b])]
    group = np.cumsum(np.append(True, ~same)) - 1
    total = int(group[-1]) + 1 if len(group) else 0
    out = np.empty(len(h), np.int64)
    by_hash = group.copy()
    for g in np.unique(by_hash[wrong]).tolist():  # unequal words under one hash: classes by the words themselves
        named: dict[bytes, int] = {}
        for k in range(*np.searchsorted(by_hash, [g, g + 1]).tolist()):
            group[k] = named.setdefault(data[begin[order[k]] : end[order[k]]].tobytes(), g if not named else total + len(named))
        total += len(named) + 1
    out[order] = group
    return out


_FOUND = "batch long, doc binary, sizes binary, ranges binary, ka binary, kb binary"


def _repeated_windows(blocks: DataFrame, window: int) -> DataFrame:
    """ka, kb, starts (packed ranges) of the windows that are met twice: block by block, then batch by batch."""

    def packed(who: np.ndarray, ranges: list[bytes]) -> tuple[bytes, bytes, bytes]:
        return who.astype("<u4").tobytes(), np.array([len(r) for r in ranges], "<u4").tobytes(), b"".join(ranges)

    def count(table: pa.Table) -> pa.Table:
        head, each, owner = ([np.frombuffer(x.as_py(), "<u4").astype(np.int64) for x in table.column(c)] for c in ("at", "n", "doc"))
        n = [int(x.sum()) for x in each]
        runs = [r for x in table.column("runs") for r in _unpacked(x.as_py()).split(b"\n")]
        each, head, owner = (np.concatenate(x) for x in (each, head, owner))
        doc = np.repeat(owner, each)
        at = np.repeat(head, each) + np.arange(len(doc)) - np.repeat(np.cumsum(each) - each, each)
        again = np.concatenate([np.unpackbits(np.frombuffer(x.as_py(), np.uint8))[:k] for x, k in zip(table.column("again"), n)]) > 0
        row = np.repeat(np.arange(len(n)), n)
        group = _equal_windows(runs, each, window)
        # a mark stands for a window that its own batch has already reported: only news for others
        own = np.flatnonzero((np.bincount(group)[group] > 1) & ~again)
        out: list[tuple] = []
        for k, mine in enumerate(np.split(own, np.searchsorted(row[own], np.arange(1, len(n))))):
            who, ranges = _ranges(doc[mine].astype(np.int64), at[mine].astype(np.int64))
            early = np.frombuffer(table.column("known_doc")[k].as_py(), "<u4")
            out.append(packed(np.concatenate([who, early]), [*ranges, *table.column("known")[k].as_py()]))
        columns = [pa.array(x, pa.binary()) for x in zip(*out)]
        return pa.table(dict(zip(("batch", "doc", "sizes", "ranges", "ka", "kb"), (table.column("batch"), *columns, table.column("ka"), table.column("kb")))))

    def gather(table: pa.Table) -> pa.Table:
        doc, sizes, ka, kb = (np.concatenate([np.frombuffer(x.as_py(), kind) for x in table.column(c)]) for c, kind in (("doc", "<u4"), ("sizes", "<u4"), ("ka", np.int64), ("kb", np.int32)))
        raw = b"".join(x.as_py() for x in table.column("ranges"))
        ends = np.cumsum(sizes.astype(np.int64))
        starts: dict[int, list[bytes]] = {}
        for d, a, b in zip(doc.tolist(), (ends - sizes).tolist(), ends.tolist()):
            starts.setdefault(d, []).append(raw[a:b])
        who = np.array(sorted(starts), np.int64)
        return pa.table({"ka": pa.array(ka[who], pa.int64()), "kb": pa.array(kb[who], pa.int32()), "starts": pa.array([b"".join(starts[d]) for d in who.tolist()], pa.binary())})

    found = blocks.groupBy("block").applyInArrow(count, _FOUND)
    return found.groupBy("batch").applyInArrow(gather, "ka long, kb int, starts binary")


def covered(n: int, starts: list[bytes], window: int) -> np.ndarray:
    """Which of n words lie in a window of the packed ranges."""
    pairs = np.frombuffer(b"".join(starts), "<u4").astype(np.int64).reshape(-1, 2)
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, pairs[:, 0], 1)
    np.add.at(edge, np.minimum(pairs[:, 0] + pairs[:, 1] - 1 + window, n), -1)
    return np.cumsum(edge[:n]) > 0


def _with_repeats(df: DataFrame, id_col: str, text_col: str, window: int, rounds: int) -> DataFrame:
    rows = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.xxhash64(id_col, text_col).alias("ka"), F.hash(id_col, text_col).alias("kb"))
    size = rows.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    blocks = max(16, int(size) // (6 * BLOCK) + 1)  # about 6 bytes a word
    table, common = (rows.sparkSession.sparkContext.broadcast(x) for x in repeated_names(rows, int(size), window, rounds))
    met = _repeated_windows(_window_blocks(rows, table, common, blocks, window, rounds), window)
    starts = met.groupBy("ka", "kb").agg(F.collect_set("starts").alias("_starts"))  # equal for repeated rows, so they stay few
    return rows.join(starts, ["ka", "kb"], "left")


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, rounds: int = ROUNDS, sink: str = "text") -> DataFrame:
    """Per row: id, n_words, n_removed, and the kept words joined by one space (sink "text") or their sha256 ("digest").

    A word goes if one of the windows (runs of `window` words of one text) that cover it also starts elsewhere
    in the corpus, in the same text or another; windows may overlap, and all are judged on the input. Words are
    split at ASCII white space and compared byte by byte. Null and empty texts have no words; texts shorter
    than a window lose none. Repeated rows are repeated texts: they lose every word if they have a window. Ids
    may be null or repeat. An empty table gives no rows; other columns are ignored.
    """
    joined = _with_repeats(df, id_col, text_col, window, rounds).select("_id", "_text", "_starts")
    last = "kept" if sink == "text" else "kept_sha256"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            total, gone, out = [], [], []
            for text, starts in zip(b.column(1), b.column(2)):
                words = (text.as_py() or "").encode().split()  # bytes split at ASCII white space alone
                n, lost = len(words), 0
                if starts.is_valid:
                    hit = covered(n, starts.as_py(), window)
                    lost = int(hit.sum())
                    words = list(compress(words, ~hit))
                kept = b" ".join(words)
                total.append(n)
                gone.append(lost)
                out.append(kept.decode() if sink == "text" else hashlib.sha256(kept).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(out, pa.string())], names=[id_col, "n_words", "n_removed", last])

    schema = T.StructType([T.StructField(id_col, joined.schema["_id"].dataType), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField(last, T.StringType())])
    return joined.mapInArrow(run, schema)


def plain_repeats(docs: list[tuple], window: int = WINDOW) -> list[tuple]:
    """Brute force over a small list, for tests: (id, n_words, n_removed, kept_sha256)."""
    texts = [plain_words(t, PLAIN_WORDS) for _, t in docs]
    seen: dict[tuple, int] = {}
    for w in texts:
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            seen[key] = seen.get(key, 0) + 1
    out = []
    for (doc_id, _), w in zip(docs, texts):
        lost = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                lost.update(range(i, i + window))
        kept = b" ".join(x for i, x in enumerate(w) if i not in lost)
        out.append((doc_id, len(w), len(lost), hashlib.sha256(kept).hexdigest()))
    return out
