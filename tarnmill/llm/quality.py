"""Quality scores by histogram gradient-boosted trees over statistics of whole documents."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnmill.llm.names import fresh
from tarnmill.llm.wordscan import FOLDED_WORDS, Words, mix, scan

#: Labelled rows to learn from, at most (those with the smallest hashes of their ids).
TRAINING_ROWS = 20_000
THRESHOLD = 0.3

# ---- document statistics -----------------------------------------------------------------------------

_CLASSES = {
    "lower": [(97, 122)], "upper": [(65, 90)], "digit": [(48, 57)], "space": [(32, 32), (9, 9)], "line": [(10, 10)], "stop": [(46, 46)], "comma": [(44, 44)],
    "bang": [(33, 33), (63, 63)], "symbol": [(35, 38), (42, 43), (60, 62), (64, 64), (91, 96), (123, 126)], "other": [(34, 34), (39, 41), (45, 45), (47, 47), (58, 59)], "high": [(128, 255)],
}
FEATURES = ["log_words", "log_bytes", "word_mean", "word_std", "word_max", "distinct_words", "top_word", "distinct_lines", "top_line", "line_words", "short_words", "long_words", "repeated_pairs", *_CLASSES, "marked_words"]


def _class_table() -> np.ndarray:
    table = np.full(256, len(_CLASSES), np.uint8)
    for k, ranges in enumerate(_CLASSES.values()):
        for a, b in ranges:
            table[a : b + 1] = k
    return table


_CLASS = _class_table()


def _distinct(docs: np.ndarray, values: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each document: distinct values, and how often its commonest occurs."""
    if not len(values):
        return np.zeros(n), np.zeros(n)
    order = np.lexsort((values, docs))
    d, v = docs[order], values[order]
    head = np.flatnonzero(np.append(True, (d[1:] != d[:-1]) | (v[1:] != v[:-1])))
    sizes = np.diff(np.append(head, len(d)))
    most = np.zeros(n)
    np.maximum.at(most, d[head], sizes)
    return np.bincount(d[head], minlength=n).astype(float), most


def document_statistics(column: pa.Array) -> np.ndarray:
    """A row of FEATURES for each text, over the whole text; a null or empty text has zeros."""
    out = []
    for words in scan(column, FOLDED_WORDS):
        n, data = len(words.counts), words.data
        docs, count = words.docs(), words.counts.astype(float)
        length = (words.ends - words.starts).astype(float)
        some = np.maximum(count, 1)
        total = np.bincount(docs, length, minlength=n)
        mean = total / some
        std = np.sqrt(np.maximum(np.bincount(docs, length * length, minlength=n) / some - mean * mean, 0))
        most = np.zeros(n)
        np.maximum.at(most, docs, length)
        distinct, top = _distinct(docs, words.hashes, n)
        pair = np.flatnonzero(docs[1:] == docs[:-1])
        pairs, _ = _distinct(docs[pair], mix(words.hashes[pair]) + words.hashes[pair + 1], n)
        size = np.diff(words_bytes(column, words))
        owner = np.repeat(np.arange(n), size)
        kinds = np.bincount(owner * 16 + _CLASS[data], minlength=16 * n).reshape(n, 16)[:, : len(_CLASSES)]
        share = kinds / np.maximum(size, 1)[:, None]
        # a line is named by the sum of its words' hashes, mixed with their places in it
        breaks = np.concatenate([[0], np.cumsum(data == 10)])
        line_of = breaks[words.starts] if len(words.starts) else np.zeros(0, np.int64)
        fresh = np.flatnonzero(np.append(True, (line_of[1:] != line_of[:-1]) | (docs[1:] != docs[:-1]))) if len(docs) else np.zeros(0, np.int64)
        within = np.arange(len(docs)) - np.repeat(fresh, np.diff(np.append(fresh, len(docs))))
        names = np.add.reduceat(mix(words.hashes + within.astype(np.uint64)), fresh) if len(fresh) else np.zeros(0, np.uint64)
        lines = np.bincount(docs[fresh], minlength=n).astype(float)
        line_distinct, line_top = _distinct(docs[fresh], names, n)
        last = data[words.ends - 1] if len(docs) else data[:0]
        marked = np.bincount(docs, np.isin(_CLASS[last], [7, 8]), minlength=n)
        out.append(
            np.column_stack(
                [np.log1p(count), np.log1p(size), mean, std, np.log1p(most), distinct / some, top / some, line_distinct / np.maximum(lines, 1), line_top / np.maximum(lines, 1), np.log1p(count / np.maximum(lines, 1)),
                 np.bincount(docs, length <= 2, minlength=n) / some, np.bincount(docs, length >= 12, minlength=n) / some, 1 - pairs / np.maximum(count - 1, 1), share, marked / some]
            )
        )
    return np.concatenate(out) if out else np.zeros((0, len(FEATURES)))


def words_bytes(column: pa.Array, words: Words) -> np.ndarray:
    """Where the texts of a chunk begin in its bytes (and where the last ends)."""
    lengths = pc.binary_length(column.slice(words.first, len(words.counts))).fill_null(0).to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.cumsum(lengths.astype(np.int64))])


# ---- the trees -----------------------------------------------------------------------------------------


@dataclass
class Trees:
    """Trees of one depth as flat arrays: node k of a tree has children 2k + 1 and 2k + 2; a row goes right above the cut."""

    feature: np.ndarray  # (trees, inner nodes)
    cut: np.ndarray
    leaf: np.ndarray  # (trees, leaves)
    start: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1, for all rows at once."""
        total = np.full(len(x), self.start)
        rows = np.arange(len(x))
        inner = self.feature.shape[1]
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
            node = np.zeros(len(x), np.int64)
            while inner and node[:1].size and node[0] < inner:  # all rows are at one depth
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            total += leaf[node - inner]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, least: float = 1.0, penalty: float = 1.0) -> Trees:
    """Boosted trees for the log loss. Each split is chosen from histograms of gradients over quantile bins."""
    n, m = x.shape
    inner, leaves = 2**depth - 1, 2**depth
    rate_of_ones = float(np.clip(y.mean() if n else 0.5, 1e-3, 1 - 1e-3))
    start = float(np.log(rate_of_ones / (1 - rate_of_ones)))
    if not n or y.min() == y.max():
        return Trees(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)), start)
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1])) for k in range(m)]
    binned = np.column_stack([np.searchsorted(e, x[:, k], "left") for k, e in enumerate(edges)])  # bin > b means value > edges[b]
    total, out = np.full(n, start), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        gradient, weight = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)
        feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            local = node - first
            best = np.full(width, 1e-9)
            for k in range(m):
                if not len(edges[k]):
                    continue
                code = local * (bins + 1) + binned[:, k]
                g = np.bincount(code, gradient, width * (bins + 1)).reshape(width, -1)
                h = np.bincount(code, weight, width * (bins + 1)).reshape(width, -1)
                gl, hl = np.cumsum(g, 1)[:, : len(edges[k])], np.cumsum(h, 1)[:, : len(edges[k])]
                gt, ht = g.sum(1, keepdims=True), h.sum(1, keepdims=True)
                gain = gl**2 / (hl + penalty) + (gt - gl) ** 2 / (ht - hl + penalty) - gt**2 / (ht + penalty)
                gain[(hl < least) | (ht - hl < least)] = 0
                at = gain.argmax(1)
                value = gain[np.arange(width), at]
                for j in np.flatnonzero(value > best):
                    best[j], feature[first + j], cut[first + j] = value[j], k, edges[k][at[j]]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > cut[node])
        leaf = -rate * np.bincount(node - inner, gradient, leaves) / (np.bincount(node - inner, weight, leaves) + penalty)
        total += leaf[node - inner]
        out.append((feature, cut, leaf))
    return Trees(*(np.array(v) for v in zip(*out)), start)


# ---- over tables ---------------------------------------------------------------------------------------


def held_out(id_col: str):
    """Whether a row's label is never learned from: crc32 of the id as text is divisible by 5."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = TRAINING_ROWS) -> Trees:
    """Fit on the statistics of at most `rows` labelled documents that are not held out.

    The bound is on labels alone: scoring covers every text. A document counts once: of several labels of an id the
    smallest, of several texts under it one. Null labels and labels without a document teach nothing; without two
    kinds of labels every score is the share of ones (one half without labels).
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).alias("_id")).agg(F.min(F.col(label_col).cast("double")).alias("_y"))
    chosen = known.orderBy(F.xxhash64("_id"), "_id").limit(rows)
    joined = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(chosen), "_id").select("_id", "_y", "_text")  # at most `rows` rows of 16 bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = document_statistics(b.column(2)).astype(np.float32)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(list(x), pa.list_(pa.float32()))], names=["_id", "_y", "_x"])

    schema = T.StructType([T.StructField("_id", joined.schema["_id"].dataType), T.StructField("_y", T.DoubleType()), T.StructField("_x", T.ArrayType(T.FloatType()))])
    # one row for each chosen label, however often documents repeat its id
    got = joined.mapInArrow(run, schema).groupBy("_id", "_y").agg(F.min("_x").alias("_x")).orderBy("_id").toArrow()
    if not got.num_rows:
        return fit(np.zeros((0, len(FEATURES))), np.zeros(0))
    x = got.column("_x").combine_chunks().flatten().to_numpy().reshape(got.num_rows, -1).astype(float)
    return fit(x, (got.column("_y").to_numpy() > 0).astype(float))


def with_score(df: DataFrame, model: Trees, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """df and a score in [0, 1] for each row's whole text (null: empty)."""
    k = df.columns.index(text_col)
    names = [*df.columns, score_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = document_statistics(b.column(k)).astype(np.float32).astype(float)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(model.score(x), pa.float64())], names=names)

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(score_col, T.DoubleType())]))


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """id, held_out, score, predicted for every row: nulls, empty texts and repeated rows too.

    The score depends on the text alone. An empty table of documents gives no rows.
    """
    model = train(docs, labels, id_col, text_col, label_col)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    scored = with_score(rows, model, "_text", "_score")
    return scored.select(F.col("_id").alias(id_col), held_out("_id").alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """docs' rows, all columns, whose score reaches the threshold.

    Texts alone decide: null and empty texts are scored like others, null ids and repeated rows too. An empty
    table gives no rows; columns may have any names.
    """
    score = fresh(docs, "_score")
    return with_score(docs, train(docs, labels, id_col, text_col, label_col), text_col, score).where(F.col(score) >= threshold).drop(score)
