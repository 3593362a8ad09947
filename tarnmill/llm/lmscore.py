"""Cross-entropy difference (Moore and Lewis, 2010) of documents under two bigram models of one vocabulary.

Target model: the documents labelled as wanted. Background model: all documents. Both share the vocabulary of all
lower-cased words, each told by a 64-bit hash, and are smoothed alike:

    p(w | v) = (count(v, w) + MU * p(w)) / (count(v) + MU)        p(w) = (count(w) + 1) / (tokens + vocabulary)

counted over all documents of the model but the one that is scored (else a model would know its own documents
by heart), with v the word before (a sign of its own at a text's start). The loss of a token is -log p(w | v); a
document's score is its mean loss under the target model less that under the background model, so lower means
more like the target.

Counts cover every token of every document, and tables of them are never gathered. Documents go in batches; a
batch tells each of its words and bigrams once, with its own counts, to the block of the name. Blocks add up what
the batches told and answer each with the sums, in the order in which it asked. With the answers a batch, whose
tokens travel beside as numbers of its own words, scores its documents. So a word or bigram that every document
holds costs a block one entry for each batch, however many documents there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnmill.llm.wordscan import FOLDED_WORDS, U64, mix, plain_words, scan
from tarnmill.runtime import materialise, release

MU = 4.0
#: Tokens of a batch (more only where one text has more), and names that a block is meant to hold.
BATCH, BLOCK = 1 << 20, 1_000_000
#: Labels (rows of 16 bytes) that may be broadcast; beyond, documents and labels are shuffled together.
BROADCAST_ROWS = 500_000


def _packed(x: np.ndarray) -> bytes:
    """Non-negative integers in as few bytes each as the largest needs, byte by byte of all, compressed."""
    most = int(x.max()) if len(x) else 0
    size = next(k for k in range(1, 9) if most < 1 << 8 * k)
    planes = np.ascontiguousarray(x.astype("<u8").view("u1").reshape(-1, 8)[:, :size].T)
    return bytes([size]) + len(x).to_bytes(8, "little") + (pa.compress(planes, codec="zstd", asbytes=True) if len(x) else b"")


def _unpacked(raw: bytes) -> np.ndarray:
    size, n = raw[0], int.from_bytes(raw[1:9], "little")
    out = np.zeros((n, 8), "u1")
    if n:
        out[:, :size] = np.frombuffer(pa.decompress(raw[9:], decompressed_size=n * size, codec="zstd", asbytes=True), "u1").reshape(size, n).T
    return out.view("<u8").ravel()


def _by_block(names: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """The order in which a batch tells its names: by block, then by name; and the blocks in that order."""
    block = names % U64(blocks)
    order = np.lexsort((names, block))
    return order, block[order].astype(np.int64)


class Batch:
    """Tokens of some texts as numbers of the batch's own words, from 1; 0 is the start of a text."""

    def __init__(self, words: np.ndarray, tokens: np.ndarray, counts: np.ndarray, target: np.ndarray):
        self.words, self.tokens, self.counts, self.target = words, tokens, counts, target
        self.doc = np.repeat(np.arange(len(counts)), counts)
        before = np.roll(tokens, 1)
        before[(np.cumsum(counts) - counts)[counts > 0]] = 0
        self.before = before
        self.pairs, self.pair = np.unique(before * (len(words) + 1) + tokens, return_inverse=True)

    @classmethod
    def of(cls, hashes: np.ndarray, counts: np.ndarray, target: np.ndarray) -> Batch:
        words, tokens = np.unique(hashes, return_inverse=True)
        return cls(words, tokens + 1, counts, target)

    def names(self) -> np.ndarray:
        """One 64-bit name for each word, then for each bigram."""
        hashes = np.concatenate([[U64(0)], self.words])
        first, second = hashes[self.pairs // (len(self.words) + 1)], hashes[self.pairs % (len(self.words) + 1)]
        return np.concatenate([mix(self.words ^ U64(0x6A09E667F3BCC909)), mix(mix(first + U64(0xBB67AE8584CAA73B)) * U64(0x9E3779B97F4A7C15) + second)])

    def told(self) -> tuple[np.ndarray, np.ndarray]:
        """How often each name occurs: in all texts, in the target's."""
        wanted = self.target[self.doc]
        return tuple(np.concatenate([np.bincount(self.tokens - 1, w, len(self.words)), np.bincount(self.pair, w, len(self.pairs))]).astype(np.int64) for w in (None, wanted))

    def losses(self, sums: list[np.ndarray], totals: Totals) -> list[np.ndarray]:
        """Summed losses by text under the background and the target model, given the sums of the names."""
        n, docs = len(self.words), len(self.counts)
        if not len(self.tokens):
            return [np.zeros(docs), np.zeros(docs)]
        times, own_before, own_word = (self._own(x) for x in (self.pair, self.before, self.tokens))
        out = []
        for count, tokens, begun, member in zip(sums, totals.tokens, totals.begun, (np.ones(docs), self.target)):
            mine = member[self.doc]
            unigram = np.concatenate([[begun], count[:n]])
            low = (unigram[self.tokens] - own_word * mine + 1) / (tokens + totals.vocabulary)
            loss = -np.log((count[n:][self.pair] - times * mine + MU * low) / (unigram[self.before] - own_before * mine + MU))
            out.append(np.bincount(self.doc, loss, docs))
        return out

    def _own(self, x: np.ndarray) -> np.ndarray:
        """For each token, how often its text has the same x."""
        _, which, n = np.unique(x * np.int64(len(self.counts)) + self.doc, return_inverse=True, return_counts=True)
        return n[which]


class Totals:
    """Of both models: tokens, texts that have words; and the words of the shared vocabulary."""

    def __init__(self, tokens: tuple[int, int], begun: tuple[int, int], vocabulary: int):
        self.tokens, self.begun, self.vocabulary = tokens, begun, vocabulary


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Batch, np.ndarray, np.ndarray]]:
    """Batches of about BATCH tokens, with the keys of their texts. Columns: _text, ka, kb, _target."""
    held: list[tuple] = []

    def flush() -> tuple[Batch, np.ndarray, np.ndarray]:
        hashes, counts, ka, kb, target = (np.concatenate(x) for x in zip(*held))
        held.clear()
        return Batch.of(hashes, counts, target.astype(bool)), ka, kb

    amount = 0
    for b in batches:
        for words in scan(b.column(0), FOLDED_WORDS):
            n = len(words.counts)
            if held and amount + len(words.hashes) > BATCH:
                yield flush()
                amount = 0
            held.append((words.hashes, words.counts, *(b.column(c).slice(words.first, n).to_numpy(zero_copy_only=False) for c in (1, 2, 3))))
            amount += len(words.hashes)
    if held:
        yield flush()


def _totals(rows: DataFrame) -> Totals:
    """Sums over all documents; the vocabulary is counted by Spark from the batches' distinct words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, _ in _batches(batches):
            some = batch.counts > 0
            values = [batch.counts.sum(), batch.counts[batch.target].sum(), some.sum(), some[batch.target].sum()]
            yield pa.RecordBatch.from_arrays([*(pa.array([int(v)], pa.int64()) for v in values), pa.array([batch.words.view(np.int64)], pa.list_(pa.int64()))], names=["n", "t", "begun", "begun_t", "words"])

    told = materialise(rows.select("_text", "ka", "kb", "_target").mapInArrow(run, "n long, t long, begun long, begun_t long, words array<long>"))
    n, t, begun, begun_t = told.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("n", "t", "begun", "begun_t")]).first()
    vocabulary = told.select(F.explode("words").alias("w")).distinct().count()
    release(told)
    return Totals((n, t), (begun, begun_t), vocabulary)


_ROW = "place long, batch long, names binary, every binary, wanted binary, words binary, tokens binary, counts binary, target binary, ka binary, kb binary"
_FIELDS = [f.split()[0] for f in _ROW.split(", ")]


def _table(rows: list[dict]) -> list[pa.Array]:
    return [pa.array([r.get(c) for r in rows], pa.int64() if c in ("place", "batch") else pa.binary()) for c in _FIELDS]


def _asked(rows: DataFrame, blocks: int) -> DataFrame:
    """For each batch: its names and counts, in a row for each block that has any, and its tokens, in a row of its own place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        label = TaskContext.get().partitionId() << 33
        for k, (batch, ka, kb) in enumerate(_batches(batches)):
            names, (every, wanted) = batch.names(), batch.told()
            order, block = _by_block(names, blocks)
            often = every[: len(batch.words)]  # tokens travel as ranks of their words, so that common words are small numbers
            rank = np.empty(len(often), np.int64)
            rank[np.argsort(-often, kind="stable")] = np.arange(len(often))
            out = [{"place": -1 - (label + k), "batch": label + k, "every": _packed(often), "words": _packed(np.diff(batch.words, prepend=U64(0))), "tokens": _packed(rank[batch.tokens - 1]), "counts": _packed(batch.counts), "target": np.packbits(batch.target).tobytes(), "ka": ka.tobytes(), "kb": kb.tobytes()}]
            for first, own in zip(np.flatnonzero(np.diff(block, prepend=-1)), np.split(order, np.flatnonzero(np.diff(block)) + 1)):
                # of names in order, alike modulo the blocks, the steps say all
                steps = np.diff(names[own] // U64(blocks), prepend=U64(0))
                out.append({"place": int(block[first]), "batch": label + k, "names": _packed(steps), "every": _packed(every[own]), "wanted": _packed(wanted[own])})
            yield pa.RecordBatch.from_arrays(_table(out), names=_FIELDS)

    return rows.select("_text", "ka", "kb", "_target").mapInArrow(run, _ROW)


def _answered(asked: DataFrame) -> DataFrame:
    """Rows of blocks with the sums in place of the counts; tokens pass through."""

    def add(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        if rows[0]["place"] < 0:
            return table
        told = [np.cumsum(_unpacked(r["names"]), dtype=U64) for r in rows]
        _, which = np.unique(np.concatenate(told), return_inverse=True)
        ends = np.cumsum([len(x) for x in told])[:-1]
        sums = [np.split(np.bincount(which, np.concatenate([_unpacked(r[c]) for r in rows])).astype(np.int64)[which], ends) for c in ("every", "wanted")]
        out = [{"place": r["place"], "batch": r["batch"], "every": _packed(a), "wanted": _packed(b)} for r, a, b in zip(rows, *sums)]
        return pa.Table.from_arrays(_table(out), names=_FIELDS)

    return asked.groupBy("place").applyInArrow(add, _ROW)


def _scored(answered: DataFrame, totals: Totals, blocks: int) -> DataFrame:
    """Losses of each text, where a batch's tokens meet the answers to its names."""

    def run(table: pa.Table) -> pa.Table:
        rows = {r["place"]: r for r in table.to_pylist()}
        own = rows.pop(min(rows))
        counts = _unpacked(own["counts"]).astype(np.int64)
        target = np.unpackbits(np.frombuffer(own["target"], "u1"))[: len(counts)].astype(bool)
        by_rank = np.argsort(-_unpacked(own["every"]).astype(np.int64), kind="stable")
        batch = Batch(np.cumsum(_unpacked(own["words"]), dtype=U64), by_rank[_unpacked(own["tokens"]).astype(np.int64)] + 1, counts, target)
        order, _ = _by_block(batch.names(), blocks)
        sums = []
        for c in ("every", "wanted"):
            total = np.zeros(len(order), np.int64)
            if len(order):
                total[order] = np.concatenate([_unpacked(rows[k][c]) for k in sorted(rows)])
            sums.append(total)
        background, target = batch.losses(sums, totals)
        return pa.table({"ka": pa.array(np.frombuffer(own["ka"], np.int64)), "kb": pa.array(np.frombuffer(own["kb"], np.int32)), "n": pa.array(counts, pa.int64()), "target": pa.array(target, pa.float64()), "background": pa.array(background, pa.float64())})

    return answered.groupBy("batch").applyInArrow(run, "ka long, kb int, n long, target double, background double")


def score(df: DataFrame, wanted: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_tokens, target_loss, background_loss, score (means per token; score is their difference).

    wanted: the ids of the target's documents (a column named as id_col; repeats and nulls are harmless). Without
    any, the target model knows nothing but the smoothing. Null and empty texts have no tokens: their losses and
    score are null. Repeated rows count as often as they come and score alike. An empty table gives no rows; other
    columns are ignored.
    """
    ids = wanted.select(F.col(id_col).alias("_id")).where("_id is not null").distinct().withColumn("_target", F.lit(True))
    ids = materialise(ids)
    few = ids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    rows = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.xxhash64(id_col, text_col).alias("ka"), F.hash(id_col, text_col).alias("kb"))
    keyed = rows.select("_id", "ka", "kb")
    rows = rows.join(F.broadcast(ids) if few else ids, "_id", "left").withColumn("_target", F.coalesce("_target", F.lit(False)))
    if not few:
        rows = materialise(rows)  # else both readings would shuffle the texts
    totals = _totals(rows)
    blocks = max(16, totals.tokens[0] // BLOCK + 1)
    sums = _scored(_answered(_asked(rows, blocks)), totals, blocks)
    scored = sums.groupBy("ka", "kb").agg(F.max("n").alias("n"), F.max("target").alias("t"), F.max("background").alias("b"))
    mean = {"target_loss": F.col("t") / F.col("n"), "background_loss": F.col("b") / F.col("n")}
    out = keyed.join(scored, ["ka", "kb"], "left").select(F.col("_id").alias(id_col), F.coalesce("n", F.lit(0)).cast("long").alias("n_tokens"), *[F.when(F.col("n") > 0, v).alias(k) for k, v in mean.items()])
    return out.withColumn("score", F.col("target_loss") - F.col("background_loss"))


def plain_scores(docs: list[tuple], wanted: set) -> dict:
    """The same scores from plain counts of words, for tests: id -> (n, target_loss, background_loss)."""
    texts = {key: plain_words(text, FOLDED_WORDS) for key, text in docs}
    vocabulary = len({w for own in texts.values() for w in own})
    models = []
    for members in (wanted & set(texts), set(texts)):
        uni: dict = {}
        two: dict = {}
        for key in members:
            before = None
            for w in texts[key]:
                uni[w] = uni.get(w, 0) + 1
                two[before, w] = two.get((before, w), 0) + 1
                before = w
        models.append((uni, two, sum(uni.values()), sum(1 for k in members if texts[k])))
    out = {}
    for key, own in texts.items():
        losses = []
        pairs = list(zip([None, *own[:-1]], own))
        times: dict = {}
        for p in pairs:
            times[p] = times.get(p, 0) + 1
        words = {w: own.count(w) for w in set(own)}
        for (uni, two, total, starts), member in zip(models, (key in wanted, True)):
            loss = 0.0
            for before, w in pairs:
                low = (uni.get(w, 0) - words[w] * member + 1) / (total + vocabulary)
                context = uni.get(before, 0) - (words[before] - (before == own[-1])) * member if before is not None else starts - member
                loss -= np.log((two.get((before, w), 0) - times[before, w] * member + MU * low) / (context + MU))
            losses.append(loss / len(own) if own else None)
        out[key] = (len(own), *losses)
    return out
