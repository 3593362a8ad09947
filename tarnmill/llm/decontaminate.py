"""Benchmark decontamination with suffix arrays over shards of the training texts.

Each worker builds a suffix array over the words of the texts it holds (a shard) and binary-searches every
suffix of the benchmark in it. The array is sparse: only suffixes whose first words begin some benchmark
suffix are sorted, as no other can match. What is found is compared word by word, then extended along its
diagonal to the longest verbatim match, with its place in the document and in the item; the matches decide
which words are hit and which documents go. Nothing is shuffled; the benchmark, a stated query set, goes to the
workers in blocks of bounded size, one at a time.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnmill.llm.names import fresh
from tarnmill.llm.wordscan import FOLDED_ALNUM, Words, plain_words, scan
from tarnmill.runtime import materialise, release

WINDOW = 10
#: Benchmark words that go to the workers at once.
BLOCK_WORDS = 2_000_000


@dataclass
class Queries:
    """A block of the benchmark. Words have ids from 1; windows are the distinct suffix heads to be found."""

    seed: int  # of the word hashes: one under which no two words of the block collide
    vocabulary: np.ndarray  # word hashes, sorted; a word's id is its index plus 1
    letters: np.ndarray  # the words' bytes, one after the other
    letters_at: np.ndarray
    width: int
    low: np.ndarray  # windows as fixed-width bytes: ids, big-endian, filled up with 0
    high: np.ndarray  # and with the largest id
    lengths: np.ndarray
    places: np.ndarray  # (window, item, position of the window's first word), by window
    first_place: np.ndarray
    items: list[str]
    pairs: np.ndarray  # codes of the first two words of windows
    singles: np.ndarray  # ids of windows of one word


def _packed(ids: np.ndarray) -> np.ndarray:
    """Rows of ids as byte strings that compare as the rows do."""
    return np.ascontiguousarray(ids.astype(">u4")).view(f"S{4 * ids.shape[1]}").ravel()


def build_queries(items: list[tuple[str, str | None]], window: int = WINDOW) -> Queries | None:
    """Suffixes of the items' words, cut to windows; an item shorter than a window is one. None without words."""
    chunks = list(scan(pa.array([t or "" for _, t in items], pa.string()), FOLDED_ALNUM))
    count = np.concatenate([w.counts for w in chunks]) if chunks else np.zeros(0, np.int64)
    if not count.sum():
        return None
    for seed in range(64):
        h = np.concatenate([w.named(seed) for w in chunks])
        spelling: dict[int, bytes] = {}
        words = zip(h.tolist(), (w.bytes_of(k) for w in chunks for k in range(len(w.hashes))))
        if all(spelling.setdefault(name, word) == word for name, word in words):
            break
    vocabulary = np.array(sorted(spelling), np.uint64)
    letters = [spelling[name] for name in vocabulary.tolist()]
    ids = np.searchsorted(vocabulary, h) + 1
    item = np.repeat(np.arange(len(count)), count)
    first = np.cumsum(count) - count
    position = np.arange(len(ids)) - first[item]
    size = np.minimum(window, count)[item]
    at = np.flatnonzero(position + size <= count[item])
    reach = at[:, None] + np.arange(window)
    table = np.where(np.arange(window) < size[at][:, None], ids[np.minimum(reach, len(ids) - 1)], 0)
    keys = _packed(table)
    _, one, which = np.unique(keys, return_index=True, return_inverse=True)
    table, lengths = table[one], size[at][one]
    order = np.argsort(which, kind="stable")
    filled = np.where(np.arange(window) < lengths[:, None], table, np.iinfo(np.uint32).max)
    several = table[lengths > 1]
    base = len(vocabulary) + 1
    return Queries(
        seed, vocabulary, np.frombuffer(b"".join(letters), np.uint8), np.cumsum([0, *map(len, letters)]), window, _packed(table), _packed(filled), lengths,
        np.column_stack([which, item[at], position[at]])[order], np.searchsorted(which[order], np.arange(len(one) + 1)),
        [i for i, _ in items], np.unique(several[:, 0] * base + several[:, 1]) if window > 1 else np.zeros(0, np.int64), np.unique(table[lengths == 1][:, 0]),
    )


def _among(values: np.ndarray, sorted_set: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.searchsorted(sorted_set, values)
    at[at == len(sorted_set)] = 0
    return at, (sorted_set[at] == values) if len(sorted_set) else np.zeros(len(values), bool)


def _spelled_alike(words: Words, k: np.ndarray, q: Queries, ids: np.ndarray) -> np.ndarray:
    """Whether words k are, byte by byte, those of the ids."""
    data = words.alphabet.folded(words.data)
    starts, size, other = words.starts[k], (words.ends - words.starts)[k], q.letters_at[ids - 1]
    alike = size == q.letters_at[ids] - other
    some = np.flatnonzero(alike)
    for part in np.array_split(some, int(size[some].sum()) // (4 << 20) + 1):
        n = size[part]
        step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        differ = data[np.repeat(starts[part], n) + step] != q.letters[np.repeat(other[part], n) + step]
        alike[part] = np.bincount(np.repeat(np.arange(len(part)), n), differ, len(part)) == 0
    return alike


def find_windows(words: Words, q: Queries) -> tuple[np.ndarray, np.ndarray]:
    """Occurrences of windows: index of the first word, and the window. Their words are equal byte by byte."""
    none = np.zeros(0, np.int64)
    at, known = _among(words.named(q.seed) if q.seed else words.hashes, q.vocabulary)
    ids = np.where(known, at + 1, 0)
    n = len(ids)
    if not n or not known.any():
        return none, none
    ends = np.repeat(words.offsets[1:], words.counts)
    following = np.append(ids[1:], 0)
    following[np.arange(n) + 1 >= ends] = 0
    begin = known & (following > 0)
    begin[begin] = _among(ids[begin] * (len(q.vocabulary) + 1) + following[begin], q.pairs)[1]
    if len(q.singles):
        begin |= _among(ids, q.singles)[1]
    suffixes = np.flatnonzero(begin)
    if not len(suffixes):
        return none, none
    reach = suffixes[:, None] + np.arange(q.width)
    heads = np.where(reach < ends[suffixes][:, None], ids[np.minimum(reach, n - 1)], 0)
    keys = _packed(heads)
    order = np.argsort(keys, kind="stable")  # the suffix array, by its first `width` words
    keys = keys[order]
    first, last = np.searchsorted(keys, q.low, "left"), np.searchsorted(keys, q.high, "right")
    found = np.flatnonzero(last > first)
    sizes = (last - first)[found]
    which = np.repeat(found, sizes)
    rank = np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(first[found], sizes)
    at = suffixes[order[rank]]
    if not len(at):
        return none, none
    # hashes brought us here; the words themselves decide
    met = np.flatnonzero(_covered(n, at, q.lengths[which]))
    wrong = np.zeros(n + 1, np.int64)
    wrong[met + 1] = ~_spelled_alike(words, met, q, ids[met])
    wrong = np.cumsum(wrong)
    right = wrong[at + q.lengths[which]] == wrong[at]
    return at[right], which[right]


def _covered(n: int, at: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + lengths, -1)
    return np.cumsum(edge[:-1]) > 0


#: Pairs of an occurrence and a place in the benchmark that are held at once (more, if one text has more).
PAIRS = 2_000_000


def find_matches(words: Words, q: Queries) -> np.ndarray:
    """Longest verbatim matches of at least a window, as rows (text, item, item's first word, text's first word, words).

    Windows that follow one another both in the text and in the item are one match: none can be extended.
    """
    at, which = find_windows(words, q)
    if not len(at):
        return np.zeros((0, 5), np.int64)
    order = np.argsort(at, kind="stable")
    at, which = at[order], which[order]
    doc = np.searchsorted(words.offsets, at, "right") - 1
    pairs = np.diff(q.first_place)[which]
    group = np.cumsum(pairs) // PAIRS
    group = group[np.searchsorted(doc, doc)]  # a text is not split
    out = []
    for own in np.split(np.arange(len(at)), np.flatnonzero(np.diff(group)) + 1):
        n = pairs[own]
        row = np.repeat(own, n)
        place = q.places[np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(q.first_place[which[own]], n)]
        where, length, text = at[row], q.lengths[which[row]], doc[row]
        item, start = place[:, 1], place[:, 2]
        order = np.lexsort((where, where - start, item, text))
        where, length, text, item, start = (x[order] for x in (where, length, text, item, start))
        new = np.ones(len(where), bool)
        new[1:] = (text[1:] != text[:-1]) | (item[1:] != item[:-1]) | (where[1:] != where[:-1] + 1) | (start[1:] != start[:-1] + 1)
        head = np.flatnonzero(new)
        tail = np.append(head[1:], len(where)) - 1
        out.append(np.column_stack([text[head], item[head], start[head], where[head] - words.offsets[text[head]], where[tail] - where[head] + length[tail]]))
    return np.concatenate(out)


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, window: int, block_words: int) -> Iterator[Queries]:
    """The benchmark, read piece by piece, in blocks of about block_words words."""
    items: list[tuple[str, str | None]] = []
    held = 0
    for item, text in benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")), F.col(text_col)).toLocalIterator():
        items.append((item, text))
        held += len(text or "") // 4 + 1
        if held >= block_words:
            if q := build_queries(items, window):
                yield q
            items, held = [], 0
    if items and (q := build_queries(items, window)):
        yield q


_MARKS = T.StructType([T.StructField("_n", T.LongType()), T.StructField("_hit", T.BinaryType()), T.StructField("_items", T.ArrayType(T.StringType())), T.StructField("_longest", T.LongType()), T.StructField("_at", T.LongType())])


def _mark(text: pa.Array, marks: pa.StructArray | None, q: Queries | None) -> pa.StructArray:
    """For each text: number of words, bits of the words that are hit, items found, longest match and its first word; added to earlier marks."""
    n_words: list[int] = []
    bits: list[bytes | None] = []
    items: list[set[str]] = []
    longest: list[tuple[int, int]] = []  # length, and minus the place: the first of the longest
    for words in scan(text, FOLDED_ALNUM):
        docs = len(words.counts)
        n_words += words.counts.tolist()
        own_bits: list[bytes | None] = [None] * docs
        own_items: list[set[str]] = [set() for _ in range(docs)]
        own_longest = [(0, 0)] * docs
        found = find_matches(words, q) if q else np.zeros((0, 5), np.int64)
        if len(found):
            doc, _, _, start, length = found.T
            hit = _covered(len(words.hashes), words.offsets[doc] + start, length)
            for d in np.unique(doc).tolist():
                own_bits[d] = np.packbits(hit[words.offsets[d] : words.offsets[d + 1]]).tobytes()
            for d, k in np.unique(found[:, :2], axis=0).tolist():
                own_items[d].add(q.items[k])
            for k in np.lexsort((-start, length)).tolist():  # the last word on a text is its longest match
                own_longest[doc[k]] = (int(length[k]), -int(start[k]))
        bits += own_bits
        items += own_items
        longest += own_longest
    if marks is not None:
        for k, m in enumerate(marks.to_pylist()):
            if m["_hit"]:
                bits[k] = m["_hit"] if not bits[k] else (np.frombuffer(m["_hit"], np.uint8) | np.frombuffer(bits[k], np.uint8)).tobytes()
                items[k] |= set(m["_items"])
                longest[k] = max(longest[k], (m["_longest"], -m["_at"]))
    columns = [pa.array(n_words, pa.int64()), pa.array(bits, pa.binary()), pa.array([sorted(x) for x in items], pa.list_(pa.string())), pa.array([n for n, _ in longest], pa.int64()), pa.array([-at if n else None for n, at in longest], pa.int64())]
    return pa.StructArray.from_arrays(columns, _MARKS.names)


def _marked(df: DataFrame, benchmark: DataFrame, text_col: str, item_col: str, item_text: str, window: int, block_words: int, name: str = "_marks") -> DataFrame:
    """df with a column of marks; one pass over the texts for each block of the benchmark (one, as a rule).

    With several blocks each pass but the last is written, so that workers hold one block at a time.
    """
    sc = df.sparkSession.sparkContext
    k, width = df.columns.index(text_col), len(df.columns)
    schema = T.StructType([*df.schema.fields, T.StructField(name, _MARKS)])
    out, held = df, None
    for q in itertools.chain(_blocks(benchmark, item_col, item_text, window, block_words), [None]):
        if q is None and held is not None:
            break
        if held is not None:
            before, out = out, materialise(out)
            release(before)
            held.destroy()
        held = sc.broadcast(q)

        def run(batches: Iterator[pa.RecordBatch], block=held) -> Iterator[pa.RecordBatch]:
            for b in batches:
                old = b.column(width) if b.num_columns > width else None
                yield pa.RecordBatch.from_arrays([*b.columns[:width], _mark(b.column(k), old, block.value)], names=schema.names)

        out = out.mapInArrow(run, schema)
    return out


def contamination(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Per row: id, n_words, n_hit, items (sorted), contaminated, longest_match (words), longest_at (its first word; null without one).

    Words are runs of ASCII letters and digits and of all bytes from 0x80, with A-Z lower-cased. A word is hit
    if an occurrence of a window (10 words in a row of an item, or a whole shorter item) covers it. Null and
    empty texts have no words and hit nothing; items without words have no window. Items with one id count
    once; a null item id is named by the empty string. Rows are told apart by nothing: repeated rows give
    repeated results. Of longest matches the first counts. An empty benchmark finds nothing; other columns are
    ignored.
    """
    rows = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    marked = _marked(rows, benchmark, "_text", item_col, item_text, window, block_words)
    return marked.select(
        F.col("_id").alias(id_col), F.col("_marks._n").alias("n_words"), ones("_marks._hit").alias("n_hit"), F.col("_marks._items").alias("items"), F.col("_marks._hit").isNotNull().alias("contaminated"),
        F.col("_marks._longest").alias("longest_match"), F.col("_marks._at").alias("longest_at"),
    )


def ones(column: str):
    """Set bits of a binary column (null: 0)."""
    digits = F.coalesce(F.hex(F.col(column)), F.lit(""))
    weights = {1: "1248", 2: "3569AC", 3: "7BDE", 4: "F"}
    total = F.lit(0)
    for weight, of in weights.items():
        total = total + weight * F.length(F.regexp_replace(digits, f"[^{of}]", ""))
    return total.cast("long")


def drop_contaminated(df: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """df's rows, all columns, in which no window of the benchmark occurs.

    Null and empty texts stay, as do rows with null ids that match nothing; repeated rows share one fate. An
    empty table, or an empty benchmark, changes nothing. Column names may clash with none of the helpers'.
    """
    marks = fresh(df, "_marks")
    return _marked(df, benchmark, text_col, item_col, item_text, window, block_words, marks).where(F.col(f"{marks}._hit").isNull()).drop(marks)


def longest_matches(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Maximal verbatim matches of at least a window: id, item, item_start, doc_start, n_words (in words).

    Matches of neighbouring suffixes on one diagonal are one longer match. A match never spans two blocks of
    the benchmark, as an item lies in one block.
    """
    sc = df.sparkSession.sparkContext
    rows = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    parts = []
    for q in _blocks(benchmark, item_col, item_text, window, block_words):
        def run(batches: Iterator[pa.RecordBatch], block=sc.broadcast(q)) -> Iterator[pa.RecordBatch]:
            q = block.value
            for b in batches:
                for words in scan(b.column(1), FOLDED_ALNUM):
                    doc, item, start, at, n = find_matches(words, q).T
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).take(pa.array(doc + words.first)), pa.array([q.items[k] for k in item], pa.string()), pa.array(start), pa.array(at), pa.array(n)],
                        names=[id_col, item_col, "item_start", "doc_start", "n_words"],
                    )

        schema = T.StructType([T.StructField(id_col, rows.schema["_id"].dataType), T.StructField(item_col, T.StringType()), *[T.StructField(c, T.LongType()) for c in ("item_start", "doc_start", "n_words")]])
        parts.append(rows.mapInArrow(run, schema))
    if not parts:
        return rows.sparkSession.createDataFrame([], T.StructType([T.StructField(id_col, rows.schema["_id"].dataType), T.StructField(item_col, T.StringType()), *[T.StructField(c, T.LongType()) for c in ("item_start", "doc_start", "n_words")]]))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def plain_contamination(docs: list[tuple], items: list[tuple], window: int = WINDOW) -> list[tuple]:
    """Brute force over small lists, for tests: (id, n_words, n_hit, n_items, items_sha256, contaminated)."""
    out = []
    for doc_id, text in docs:
        words = plain_words(text, FOLDED_ALNUM)
        hit, found = set(), set()
        for item_id, item in items:
            own = plain_words(item, FOLDED_ALNUM)
            size = min(window, len(own))
            for a in range(len(own) - size + 1 if size else 0):
                for p in range(len(words) - size + 1):
                    if words[p : p + size] == own[a : a + size]:
                        hit.update(range(p, p + size))
                        found.add(str(item_id))
        out.append((doc_id, len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out
