"""Near-duplicate join: Jaccard similarity of 5-word shingle sets, by a blocked sparse product.

The documents x shingles incidence is multiplied by its transpose in blocks of shingles. Sizes bound what is
multiplied (with similarity at least t = NUM / DEN):

* Prefixes. Under any fixed order of all shingles, two linked documents share one among the first
  n - ceil(t * n) + 1 of each. Rare shingles go first: the order is by counts over all documents in a hashed
  table of fixed size, then by hash, so what many documents share rarely counts as evidence.
* Overlaps. If c is the number of prefix shingles that two documents share, they share c + ceil(t * n) - 1
  shingles at most (n: of the larger one), and need t / (1 + t) * (n1 + n2). Pairs below are discarded; and a
  document leaves a bucket in which its own shared shingles could not suffice with any size present there.
* Parities. Each shingle flips one of 1024 bits of its document; the bits in which two documents differ are no
  more than the shingles in which they do, of which links allow (1 - t) / (1 + t) * (n1 + n2).

The incidence is kept as postings (shingle, class) in blocks of shingles; multiplying is joining postings on the
shingle, and each task and then Spark sums what meets into overlap counts by pair. Documents with equal sets are
one class. No group is expanded into all its pairs: first the incidence is multiplied by the columns of pivots
alone, a bucket's pivot being the mate whose prefix is shared most, and each class is compared with the pivot of
the largest overlap. Then, where a bucket still joins classes that are not connected, the rows of the smaller
component's classes are multiplied by the others', in their rarest buckets: as two linked classes share at least
so many, all but so many less one are enough, and the overlap counted there has a bound too. Large buckets are
split by ranges of documents. What the bounds leave is compared exactly, set by set.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnmill.llm.names import fresh
from tarnmill.llm.wordscan import FOLDED_WORDS, U64, Words, mix, plain_words, rolled, scan
from tarnmill.operators.components import connected_components
from tarnmill.runtime import materialise, release

NUM, DEN = 75, 100
SHINGLE = 5
#: Counters of the table that orders shingles, in parts that are summed apart.
COUNTERS, PART = 1 << 22, 1 << 12
#: Postings of a block, a mapper's batch, and a bucket before it is dealt to several blocks.
BLOCK, BATCH, BUCKET = 1_000_000, 500_000, 50_000
#: Members of a bucket that one part of the product across components holds.
DEAL = 5_000
PARITY = 1024
#: Members that are compared with one copy of a pivot.
FAN = 200
#: Rows of a lookup table that may be broadcast (of 48 bytes each); beyond, the texts are shuffled to it.
BROADCAST_ROWS = 500_000


def needed(n: Column, m: Column, num: int = NUM, den: int = DEN) -> Column:
    """Prefix shingles that documents of n and m shingles must share, at least (see the bounds above)."""
    return F.ceil(num * (n + m) / F.lit(num + den) - 1e-9) - F.ceil(num * F.greatest(n, m) / F.lit(den) - 1e-9) + 1


def needed_within(n: Column, low: Column, high: Column, num: int = NUM, den: int = DEN) -> Column:
    """The least of needed(n, m) over sizes m from low to high: it falls from m = n on either side."""
    below = num * (n + low) / F.lit(num + den) - F.ceil(num * n / F.lit(den) - 1e-9) + 1
    above = num * (n + high) / F.lit(num + den) - num * high / F.lit(den)
    return F.least(below, above) - 1e-6


def shingle_sets(words: Words, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, sorted within each text, and the texts' offsets among them."""
    docs, counts = words.docs(), words.counts
    n = len(words.hashes)
    at = np.zeros(0, np.int64)
    parts, owners = [], []
    if n >= size:
        ends = words.offsets[1:][docs[: n - size + 1]]
        at = np.flatnonzero(np.arange(n - size + 1) + size <= ends)
        parts.append(rolled(words.hashes, size)[at])
        owners.append(docs[at])
    for k in range(1, size):  # fewer words: the whole sequence
        short = np.flatnonzero(counts == k)
        if len(short):
            whole = np.full(len(short), k, U64)
            for i in range(k):
                whole = mix(whole * U64(0x9E3779B97F4A7C15) + words.hashes[words.offsets[short] + i])
            parts.append(whole)
            owners.append(short)
    if not parts:
        return np.zeros(0, U64), np.zeros(len(counts) + 1, np.int64)
    h, d = np.concatenate(parts), np.concatenate(owners)
    order = np.argsort(h)
    order = order[np.argsort(d[order], kind="stable")]
    h, d = h[order], d[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    h, d = h[new], d[new]
    return h, np.searchsorted(d, np.arange(len(counts) + 1))


def parities(h: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Of each set the parity of its shingles at each of PARITY bits, as 64-bit integers."""
    n = len(offsets) - 1
    bit = (mix(h ^ U64(0x5A5A5A5A5A5A5A5A)) & U64(PARITY - 1)).astype(np.int64)
    counts = np.bincount(np.repeat(np.arange(n), np.diff(offsets)) * PARITY + bit, minlength=n * PARITY)
    return np.packbits((counts & 1).astype(np.uint8).reshape(n, PARITY), axis=1).view(np.int64)


def set_keys(h: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two numbers that name each set: 64 bits, and its size with 32 more bits."""
    n = np.diff(offsets)
    some = np.flatnonzero(n)
    first, second = np.zeros(len(n), U64), np.zeros(len(n), U64)
    if len(some):
        first[some] = np.add.reduceat(mix(h ^ U64(0xA5A5A5A5A5A5A5A5)), offsets[some])
        second[some] = np.add.reduceat(mix(h ^ U64(0x3C3C3C3C3C3C3C3C)), offsets[some])
    return first.view(np.int64), (n.astype(np.int64) << 32) | (mix(second) & U64(0xFFFFFFFF)).astype(np.int64)


def _survey(rows: DataFrame, size: int) -> DataFrame:
    """Each document's set keys; and, from each task, its part of the shingle counts."""
    kind = rows.schema["_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, counts = TaskContext.get().partitionId(), np.zeros(COUNTERS, np.int64)
        held: list[np.ndarray] = []
        amount, some = 0, False
        for b in batches:
            for words in scan(b.column(1), FOLDED_WORDS):
                h, offsets = shingle_sets(words, size)
                held.append((h & U64(COUNTERS - 1)).astype(np.int64))
                amount += len(h)
                some |= len(h) > 0
                if amount >= BATCH:
                    counts += np.bincount(np.concatenate(held), minlength=COUNTERS)
                    held, amount = [], 0
                k1, nk = set_keys(h, offsets)
                n = len(k1)
                none = pa.nulls(n, pa.int32())
                bits = pa.FixedSizeListArray.from_arrays(pa.array(parities(h, offsets).ravel()), PARITY // 64).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(words.first, n), b.column(2).slice(words.first, n), pa.array(k1), pa.array(nk), bits, none, none, pa.nulls(n, pa.binary())], names=names)
        if some:
            counts += np.bincount(np.concatenate([*held, np.zeros(0, np.int64)]), minlength=COUNTERS)
            parts = COUNTERS // PART
            packed = [zlib.compress(c.astype("<u4").tobytes(), 1) for c in np.minimum(counts, 0xFFFFFFFF).reshape(parts, PART)]
            yield pa.RecordBatch.from_arrays([pa.nulls(parts, arrow_id), pa.nulls(parts, pa.int64()), pa.nulls(parts, pa.int64()), pa.nulls(parts, pa.int64()), pa.nulls(parts, pa.list_(pa.int64())), pa.array([task] * parts, pa.int32()), pa.array(range(parts), pa.int32()), pa.array(packed, pa.binary())], names=names)

    from pyspark.sql.pandas.types import to_arrow_type

    arrow_id = to_arrow_type(kind)
    schema = T.StructType([T.StructField("_id", kind), T.StructField("_rid", T.LongType()), T.StructField("k1", T.LongType()), T.StructField("nk", T.LongType()), T.StructField("bits", T.ArrayType(T.LongType())), T.StructField("task", T.IntegerType()), T.StructField("part", T.IntegerType()), T.StructField("counts", T.BinaryType())])
    names = schema.names
    return rows.mapInArrow(run, schema)


def _sum_counts(survey: DataFrame) -> np.ndarray:
    """The counts of all tasks: summed in groups of tasks, then over groups. The driver gets COUNTERS numbers."""

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(zlib.decompress(x.as_py()), "<u4").astype(np.int64) for x in table.column("counts"))
        packed = zlib.compress(np.minimum(total, 0xFFFFFFFF).astype("<u4").tobytes(), 1)
        return pa.table({"part": table.column("part")[:1], "group": table.column("group")[:1], "counts": pa.array([packed], pa.binary())})

    schema = "part int, group int, counts binary"
    rows = survey.where("part is not null").selectExpr("part", "task div 512 as group", "counts").selectExpr("part", "cast(group as int) group", "counts")
    summed = rows.groupBy("part", "group").applyInArrow(add, schema).withColumn("group", F.lit(0)).groupBy("part").applyInArrow(add, schema)
    out = np.zeros((COUNTERS // PART, PART), np.int64)
    for part, _, packed in summed.collect():
        out[part] = np.frombuffer(zlib.decompress(packed), "<u4")
    return out.ravel()


def _postings(rows: DataFrame, counts, blocks: int, size: int, num: int, den: int) -> DataFrame:
    """Prefix shingles by block: a row holds those of one block from one batch of documents, as packed arrays.

    A class is told by its first number alone: should two classes share it, both count as holders, which costs
    candidates and loses none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = counts.value
        held: list[tuple] = []

        def flush() -> pa.RecordBatch:
            h, k1, nk, often = (np.concatenate(x) for x in zip(*held))
            # each class once: copies within a batch say nothing new
            order = np.lexsort((h, nk, k1))
            h, k1, nk, often = h[order], k1[order], nk[order], often[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (k1[1:] != k1[:-1]) | (nk[1:] != nk[:-1])
            h, k1, nk, often = h[new], k1[new], nk[new], often[new]
            # a bucket that may be large is dealt to several blocks by its members' keys
            deal = mix(k1.view(U64)) % (often // BUCKET + 1).astype(U64)
            block = (mix(h + mix(deal) * (deal > 0)) % U64(blocks)).astype(np.int64)
            order = np.argsort(block, kind="stable")
            out: list[list] = [[], [], [], [], []]
            for own in np.split(order, np.flatnonzero(np.diff(block[order])) + 1):
                first = np.flatnonzero(np.append(True, (k1[own][1:] != k1[own][:-1]) | (nk[own][1:] != nk[own][:-1])))
                each = np.diff(np.append(first, len(own)))
                often_dealt = often[own] >= BUCKET
                for x, v in zip(out, (int(block[own[0]]), h[own].tobytes(), each.astype("<u1" if each.max() < 256 else "<u4").tobytes(), k1[own][first].tobytes(), np.packbits(often_dealt).tobytes() if often_dealt.any() else b"")):
                    x.append(v)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), *[pa.array(x, pa.binary()) for x in out[1:]]], names=["block", "h", "each", "k1", "dealt"])

        amount = 0
        for b in batches:
            for words in scan(b.column(1), FOLDED_WORDS):
                h, offsets = shingle_sets(words, size)
                if not len(h):
                    continue
                n = np.diff(offsets)
                k1, nk = set_keys(h, offsets)
                doc = np.repeat(np.arange(len(n)), n)
                often = table[(h & U64(COUNTERS - 1)).astype(np.int64)]
                order = np.lexsort((mix(h), often, doc))
                keep = order[np.arange(len(h)) - offsets[doc] < (n - -(-num * n // den) + 1)[doc]]
                held.append((h[keep], k1[doc[keep]], nk[doc[keep]], often[keep]))
                amount += len(keep)
                if amount >= BATCH:
                    yield flush()
                    amount = 0
        if held:
            yield flush()

    return rows.select("_id", "_text").mapInArrow(run, "block int, h binary, each binary, k1 binary, dealt binary")


def _shared(postings: DataFrame) -> DataFrame:
    """Block by block: the postings of shingles that several classes hold; the others add nothing to any overlap."""

    def run(table: pa.Table) -> pa.Table:
        h, k1, dealt = [], [], []
        for r in zip(*(table.column(c) for c in ("h", "each", "k1", "dealt"))):
            a, each, own, bits = (x.as_py() for x in r)
            h.append(np.frombuffer(a, np.int64))
            own = np.frombuffer(own, np.int64)
            k1.append(np.repeat(own, np.frombuffer(each, "<u1" if len(each) == len(own) else "<u4")))
            dealt.append(np.unpackbits(np.frombuffer(bits, np.uint8))[: len(h[-1])] if bits else np.zeros(len(h[-1]), np.uint8))
        h, k1, dealt = (np.concatenate(x) for x in (h, k1, dealt))
        order = np.lexsort((k1, h))
        h, k1, dealt = h[order], k1[order], dealt[order]
        new = np.append(True, (h[1:] != h[:-1]) | (k1[1:] != k1[:-1]))
        h, k1, dealt = h[new], k1[new], dealt[new]
        same = h[1:] == h[:-1]
        keep = np.append(same, False) | np.append(False, same) | (dealt > 0)
        return pa.table({"h": h[keep], "k1": k1[keep]})

    return postings.groupBy("block").applyInArrow(run, "h long, k1 long")


def _verify(rows: DataFrame, pairs: DataFrame, classes: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) of classes that link, by their whole sets. b is the pivot; its set is copied per FAN members."""
    fans = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / F.lit(FAN)).cast("long").alias("fans"))
    members = pairs.join(fans, "b").selectExpr("a as cid", "b as pivot", "pmod(xxhash64(a), fans) as fan")
    pivots = fans.selectExpr("b as cid", "b as pivot", "explode(sequence(0L, fans - 1)) as fan")
    need = materialise(members.unionByName(pivots).join(classes.select("cid", "k1", "nk", F.col("rid").alias("_rid")), "cid"))
    small = need.count() <= BROADCAST_ROWS
    texts = rows.join(F.broadcast(need) if small else need, "_rid").select("_text", "cid", "pivot", "fan", "k1", "nk")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for words in scan(b.column(0), FOLDED_WORDS):
                h, offsets = shingle_sets(words, size)
                k1, nk = set_keys(h, offsets)
                part = b.slice(words.first, len(k1))
                right = np.flatnonzero((k1 == part.column(4).to_numpy()) & (nk == part.column(5).to_numpy()))  # of rows with one number
                packed = [h[offsets[k] : offsets[k + 1]].tobytes() for k in right]
                yield pa.RecordBatch.from_arrays([*[part.column(c).take(pa.array(right)) for c in (1, 2, 3)], pa.array(packed, pa.binary())], names=["cid", "pivot", "fan", "shingles"])

    spread = texts.mapInArrow(sets, "cid long, pivot long, fan long, shingles binary").repartition("pivot", "fan")
    dealt = spread.withColumn("first", F.col("cid") == F.col("pivot")).sortWithinPartitions("pivot", "fan", F.desc("first")).select("cid", "pivot", "shingles")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivot, own = None, np.zeros(0, U64)
        for b in batches:
            linked: tuple[list, list] = ([], [])
            for cid, to, packed in zip(*(c for c in b.columns)):
                cid, to, other = cid.as_py(), to.as_py(), np.frombuffer(packed.as_py(), U64)
                if cid == to:
                    pivot, own = to, other
                elif pivot == to:
                    at = np.searchsorted(own, other)
                    at[at == len(own)] = 0
                    both = int((own[at] == other).sum())
                    if den * both >= num * (len(own) + len(other) - both):
                        linked[0].append(cid)
                        linked[1].append(to)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in linked], names=["a", "b"])

    return dealt.mapInArrow(compare, "a long, b long")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, num: int = NUM, den: int = DEN) -> DataFrame:
    """Per row: id, n_shingles, component_id (the smallest id that links reach, its own included).

    Words are split at ASCII white space and A-Z lower-cased. A text with fewer words than a shingle has its
    whole sequence as its one shingle; a null or empty text has none and stays alone. Texts link when
    den * |intersection| >= num * |union|; texts with equal sets always do. Repeated rows are equal texts; one id
    may stand on several texts, each of which is judged by itself. Rows with null ids are compared like all
    others; null ids are ignored where a smallest id is sought, so component_id is null where there is no other.
    An empty table gives no rows. Other columns are ignored.
    """
    rows = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    own, named = _classified(rows, size, num, den)
    found = own.where("nk >= 1L << 32").join(named, ["k1", "nk"]).select("_id", "nk", "component_id")
    alone = own.where("nk < 1L << 32").select("_id", "nk", F.col("_id").alias("component_id"))
    return found.unionByName(alone).select(F.col("_id").alias(id_col), F.shiftright("nk", 32).alias("n_shingles"), "component_id")


def _classified(rows: DataFrame, size: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """Each row's _id and set keys; and each class with its component's smallest id and whether it is the class that has it."""
    rows = rows.withColumn("_rid", F.xxhash64("_id", "_text"))  # finds a text again, whatever its id
    survey = materialise(_survey(rows, size))
    own = survey.where("part is null").select("_id", "_rid", "k1", "nk", "bits")
    first = F.min(F.struct(F.col("_id").isNull().alias("null"), "_id", "_rid")).alias("f")
    classes = own.where("nk >= 1L << 32").groupBy("k1", "nk").agg(first, F.max("bits").alias("bits"))
    classes = materialise(classes.select("k1", "nk", F.col("f._id").alias("rep"), F.col("f._rid").alias("rid"), "bits", F.monotonically_increasing_id().alias("cid")))
    prefix = F.shiftright("nk", 32) - F.ceil(num * F.shiftright("nk", 32) / F.lit(den)) + 1
    total = classes.agg(F.sum(prefix)).first()[0] or 0
    labels = None
    if total:
        counts = rows.sparkSession.sparkContext.broadcast(_sum_counts(survey).astype(np.uint32))
        labels = _components(rows, classes, counts, max(16, -(-int(total) // BLOCK)), size, num, den)
    if labels is None:
        return own, classes.select("k1", "nk", F.col("rep").alias("component_id"), F.lit(True).alias("chosen"))
    known = classes.join(labels, classes["cid"] == labels["node"], "left").select("k1", "nk", "rep", "component")
    alone = known.where("component is null").select("k1", "nk", F.col("rep").alias("component_id"), F.lit(True).alias("chosen"))
    linked = known.where("component is not null")
    least = linked.groupBy("component").agg(F.min(F.struct(F.col("rep").isNull().alias("null"), "rep", "k1", "nk")).alias("m"))
    mine = (F.col("k1") == F.col("m.k1")) & (F.col("nk") == F.col("m.nk"))
    return own, alone.unionByName(linked.join(least, "component").select("k1", "nk", F.col("m.rep").alias("component_id"), mine.alias("chosen")))


def _components(rows: DataFrame, classes: DataFrame, counts, blocks: int, size: int, num: int, den: int) -> DataFrame | None:
    shared = _shared(_postings(rows, counts, blocks, size, num, den))
    per_class = shared.join(classes.select("k1", "cid", F.shiftright("nk", 32).cast("int").alias("n")), "k1")
    held = F.count(F.lit(1)).over(Window.partitionBy("k1", "cid"))
    mates = materialise(per_class.withColumn("c", held.cast("int")).select("h", "cid", "n", "c"))

    # what a bucket's sizes leave possible; its pivot is the class whose prefix is shared most
    n, share = F.col("n"), F.col("c") / (F.col("n") - F.ceil(num * F.col("n") / F.lit(den)) + 1)
    buckets = mates.groupBy("h").agg(
        F.min("n").alias("low"), F.max("n").alias("high"), F.count(F.lit(1)).alias("mates"),
        F.max(F.struct(share.alias("s"), "n", "cid", "c")).alias("p"),
    ).where("mates > 1")
    low, high = F.greatest("low", F.ceil(num * n / F.lit(den))), F.least("high", F.floor(den * n / F.lit(num)))
    need = needed_within(n, low, high, num, den)
    joined = mates.join(buckets, "h").withColumn("need", need).where("c >= need").select("h", "cid", "n", "c", F.ceil("need").alias("need"), "mates", F.col("p.cid").alias("b"), F.col("p.n").alias("m"), F.col("p.c").alias("cb"))
    near = materialise(joined)
    release(mates)

    def fits(n1: Column, n2: Column, c: Column) -> Column:
        return (den * F.least(n1, n2) >= num * F.greatest(n1, n2)) & (c >= needed(n1, n2, num, den))

    stars = near.where((F.col("cid") != F.col("b")) & fits(F.col("n"), F.col("m"), F.least("c", "cb"))).groupBy("cid", "b").agg(F.count(F.lit(1)).alias("times"))
    best = stars.groupBy("cid").agg(F.max(F.struct("times", "b")).alias("x")).select(F.col("cid").alias("a"), F.col("x.b").alias("b"))
    links = materialise(_verify(rows, best, classes, size, num, den))
    first = materialise(connected_components(links, "a", "b"))

    # what the pivots left apart: buckets that join several components
    sizes = first.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    member = first.join(sizes, "component")
    placed = near.join(member, near["cid"] == member["node"], "left")
    placed = placed.select("h", "cid", "n", "c", "need", "mates", F.struct(F.coalesce("size", F.lit(1)).alias("size"), F.coalesce("component", "cid").alias("component")).alias("k"))
    placed = materialise(placed)
    release(near)
    mixed = placed.groupBy("h").agg(F.min("k").alias("k1"), F.max("k").alias("k2")).where("k1 <> k2")
    own, rarest = Window.partitionBy("cid"), Window.partitionBy("cid").orderBy("mates", "h")
    ranks = {"rank": F.row_number().over(rarest), "held": F.count(F.lit(1)).over(own), "least": F.greatest(F.min("need").over(own), F.lit(1))}
    parts = F.ceil(F.col("mates") / F.lit(DEAL)).cast("int").alias("parts")
    told = placed.join(mixed, "h").withColumns(ranks).select("h", "cid", "n", "c", "k", "least", parts, (F.col("k") > F.col("k1")).alias("sought"), ((F.col("k") < F.col("k2")) & (F.col("rank") <= F.col("held") - F.col("least") + 1)).alias("probing"))
    told = materialise(told)
    release(placed)
    # only buckets in which someone looks matter; parities are joined to what is left of them
    looked = told.join(told.where("probing").select("h").distinct(), "h").join(classes.select("cid", "bits"), "cid")
    x = looked.where("probing").drop("sought", "probing").withColumn("part", F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int")).alias("x")
    y = looked.where("sought").drop("sought", "probing").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).alias("y")
    differing = F.aggregate(F.zip_with("x.bits", "y.bits", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda a, b: a + b)
    alike = differing * (num + den) <= (F.col("x.n") + F.col("y.n")) * (den - num)
    across = (F.col("x.h") == F.col("y.h")) & (F.col("x.part") == F.col("y.part")) & (F.col("x.k") < F.col("y.k"))
    met = x.join(y, across & fits(F.col("x.n"), F.col("y.n"), F.least("x.c", "y.c")) & alike)
    # overlaps counted where x looks; it leaves out fewer buckets than it shares at least
    overlap = met.groupBy(F.col("y.cid").alias("a"), F.col("x.cid").alias("b"), F.col("x.n").alias("n"), F.col("y.n").alias("m"), F.col("x.least").alias("least")).agg(F.count(F.lit(1)).alias("c"))
    rest = materialise(overlap.where(F.col("c") >= needed(F.col("n"), F.col("m"), num, den) - (F.col("least") - 1)).select("a", "b"))
    release(told)
    if rest.isEmpty():
        return first
    more = materialise(_verify(rows, rest, classes, size, num, den))
    if more.isEmpty():
        return first
    hung = first.select(F.col("node").alias("a"), F.col("component").alias("b"))
    return materialise(connected_components(hung.unionByName(more), "a", "b"))


def _with_set_keys(df: DataFrame, text_col: str, names: list[str], size: int) -> DataFrame:
    """df and the two numbers that name each row's shingle set."""
    k, all_names = df.columns.index(text_col), [*df.columns, *names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = [set_keys(*shingle_sets(words, size)) for words in scan(b.column(k), FOLDED_WORDS)] or [(np.zeros(0, np.int64),) * 2]
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(np.concatenate(x)) for x in zip(*parts))], names=all_names)

    return df.mapInArrow(run, T.StructType([*df.schema.fields, *[T.StructField(n, T.LongType()) for n in names]]))


def keep_one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, num: int = NUM, den: int = DEN) -> DataFrame:
    """df's rows, all columns, without near copies: of each component one row, with the smallest id.

    Rows are judged by id and text together: one id on texts that are no near copies of each other loses none of
    them. If several rows of a component have its smallest id (repeated rows, or one id on near copies), one of
    them stays. A row with a null id stays only in a component of null ids. Texts without words are linked
    with nothing, so all of their rows stay. An empty table gives no rows; columns may have any names.
    """
    _, named = _classified(df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), size, num, den)
    k1, nk, key, null = names = [fresh(df, n) for n in ("_k1", "_nk", "_key", "_null")]

    def told(x: Column) -> dict[str, Column]:
        return {key: F.coalesce(x.cast("string"), F.lit("")), null: x.isNull()}

    stay = named.where("chosen").withColumns({k1: F.col("k1"), nk: F.col("nk"), **told(F.col("component_id"))}).select(*names)
    keyed = _with_set_keys(df, text_col, [k1, nk], size)
    full = keyed.where(F.col(nk) >= 1 << 32).withColumns(told(F.col(id_col))).join(stay, names, "left_semi").dropDuplicates(names)
    empty = keyed.where(F.col(nk) < 1 << 32)
    columns = [F.col(f"`{c}`") for c in df.columns]
    return full.select(*columns).unionByName(empty.select(*columns))


def plain_components(docs: list[tuple], size: int = SHINGLE, num: int = NUM, den: int = DEN) -> list[tuple]:
    """Brute force over all pairs of a small list, for tests: (id, n_shingles, component_id)."""
    sets = []
    for _, text in docs:
        w = plain_words(text, FOLDED_WORDS)
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    root = list(range(len(docs)))

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and den * len(a & b) >= num * len(a | b):
                root[find(i)] = find(j)
    least: dict[int, int] = {}
    for i, (key, _) in enumerate(docs):
        least[find(i)] = min(least.get(find(i), key), key)
    return [(key, len(sets[i]), least[find(i)]) for i, (key, _) in enumerate(docs)]
