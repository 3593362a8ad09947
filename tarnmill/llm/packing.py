"""Token sequences of fixed length by shortest-pack-first histogram packing (Krell et al., 2021)."""

from __future__ import annotations

import functools
import json
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnmill.runtime import materialise

CAPACITY = 2048
END_ID = 1


def _byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable ones stand for themselves."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = (b for b in range(256) if b not in plain)
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


@functools.lru_cache(maxsize=4)
def encoder(path: str) -> Callable[[str], bytes]:
    """Text to ids (little-endian unsigned 32-bit): those of `tokenizers` for the file, without special tokens added.

    A plain byte-level BPE whose merges are numbered in the order of its ids runs on the faster `tiktoken`,
    which then gives the same ids by definition; any other file runs on `tokenizers` itself. So does a text that
    holds the string of an added token (which is that token), or on which the fast way gives up (white space
    of about a million characters).
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    special = {x["content"] for x in spec.get("added_tokens", [])}
    letters = _byte_letters()
    vocab = {t: i for t, i in model.get("vocab", {}).items() if t not in special} if model.get("type") == "BPE" else {}
    merges = [m.split(" ") if isinstance(m, str) else m for m in model.get("merges", [])]
    plain = (
        bool(vocab)
        and pre.get("type") == "ByteLevel"
        and not pre.get("add_prefix_space")
        and pre.get("use_regex", True)
        and not spec.get("normalizer")
        and not (model.get("dropout") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix") or model.get("ignore_merges"))
        and all(letter in vocab for letter in letters)
        and len(vocab) == 256 + len(merges)
        and all(vocab.get(a + b) == vocab[a + b] and vocab[a + b] - len(letters) == k for k, (a, b) in enumerate(merges) if a + b in vocab)
        and all(a + b in vocab for a, b in merges)
    )
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)

    def exact(text: str) -> bytes:
        return np.array(whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    if not plain:
        return exact
    import public_tokenizers
    import tiktoken

    ranks = {bytes(letters[c] for c in t): i for t, i in vocab.items()}
    core = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def fast(text: str) -> bytes:
        if any(x in text for x in special):
            return exact(text)
        try:
            return core.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()
        except ValueError:  # its pattern ran out of room
            return exact(text)

    return fast


def shortest_pack_first(counts: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Patterns for a histogram of lengths: (packs, [(length, times), ...]).

    Lengths go longest first, each into the emptiest packs that still hold it, whole groups of equal packs at
    once; a group is split only where a length runs out, so patterns stay few however many items there are.
    """
    open_: dict[int, list[tuple[int, tuple]]] = {}
    for length in sorted(counts, reverse=True):
        left = counts[length]
        for room in range(capacity, length - 1, -1):
            while left and open_.get(room):
                packs, pattern = open_[room].pop()
                used = min(packs, left)
                if used < packs:
                    open_[room].append((packs - used, pattern))
                head, last = (pattern[:-1], pattern[-1]) if pattern and pattern[-1][0] == length else (pattern, (length, 0))
                open_.setdefault(room - length, []).append((used, (*head, (length, last[1] + 1))))
                left -= used
            if not left:
                break
        if left:
            fit = capacity // length
            full, rest = divmod(left, fit)
            if full:
                open_.setdefault(capacity - fit * length, []).append((full, ((length, fit),)))
            if rest:
                open_.setdefault(capacity - rest * length, []).append((1, ((length, rest),)))
    return [(n, list(p)) for room in sorted(open_) for n, p in open_[room]]


def _placement(counts: dict[int, int], capacity: int) -> dict[str, np.ndarray]:
    """Where each item goes, by its place in the order of (length, rank): runs of items of one length in equal packs."""
    first: dict[int, int] = {}
    total = 0
    for length in sorted(counts):
        first[length] = total
        total += counts[length]
    runs, base = [], 0
    for packs, pattern in shortest_pack_first(counts, capacity):
        offset = 0
        for length, times in pattern:
            runs.append((first[length], base, times, offset, length))
            first[length] += packs * times
            offset += length * times
        base += packs
    table = np.array(sorted(runs), np.int64).reshape(-1, 5)
    return {k: table[:, c] for c, k in enumerate(("at", "sequence", "times", "offset", "length"))}


_PIECES = "_id {id}, start long, length long, {payload}, doc_tokens long, _part int, _rank long"


def _pieces(df: DataFrame, id_col: str, text_col: str, tokenizer: str, capacity: int, end_id: int, payload: str) -> DataFrame:
    """Each document's ids, cut at multiples of capacity, with the piece's rank among those of its length and task."""
    rows = df.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()
    with_ids = payload == "ids"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(tokenizer), TaskContext.get().partitionId()
        end = np.array([end_id], "<u4").tobytes()
        seen = np.zeros(capacity + 1, np.int64)
        for b in batches:
            for at in range(0, b.num_rows, 512):
                texts = b.column(1).slice(at, 512)
                doc, start, length, digest, tokens, rank = [], [], [], [], [], []
                for k, text in enumerate(texts):
                    ids = encode(text.as_py()) + end
                    n = len(ids) // 4
                    for s in range(0, n, capacity):
                        size = min(capacity, n - s)
                        own = ids[4 * s : 4 * (s + size)]
                        doc.append(at + k)
                        start.append(s)
                        length.append(size)
                        digest.append(np.frombuffer(own, "<u4").astype(np.int32) if with_ids else zlib.crc32(own))
                        tokens.append(n)
                        rank.append(seen[size])
                        seen[size] += 1
                values = [b.column(0).take(pa.array(doc, pa.int64())), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(digest, pa.list_(pa.int32()) if with_ids else pa.int64()), pa.array(tokens, pa.int64()), pa.array([part] * len(doc), pa.int32()), pa.array(rank, pa.int64())]
                yield pa.RecordBatch.from_arrays(values, names=["_id", "start", "length", payload, "doc_tokens", "_part", "_rank"])

    return rows.mapInArrow(run, _PIECES.format(id=kind, payload="ids array<int>" if with_ids else "ids_crc32 long"))


def pack(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, payload: str = "ids") -> DataFrame:
    """Pieces of documents with their places: id, start, length, ids (or ids_crc32), doc_tokens, sequence_id, offset.

    A document is its ids and end_id; null text is empty (end_id alone). Only documents longer than a sequence
    are cut. Pieces of a sequence lie side by side from offset 0. Repeated rows and repeated or null ids are
    packed row by row. An empty table gives no pieces; other columns are ignored. payload: "ids" for the ids
    themselves, "ids_crc32" for their checksum.

    The histogram (at most `capacity` rows) alone goes to the driver. A piece's rank among all of its length is
    its rank in its task plus the number in earlier tasks; the patterns turn the rank into a place.
    """
    pieces = materialise(_pieces(df, id_col, text_col, tokenizer, capacity, end_id, payload))
    counts = pieces.groupBy("length", "_part").agg(F.count(F.lit(1)).alias("_n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    first = {length: at for length, at in zip(sorted(histogram), np.cumsum([0, *[histogram[k] for k in sorted(histogram)]]).tolist())}
    base = F.create_map(*[F.lit(x) for pair in first.items() for x in pair]) if first else None
    starts = counts.select("length", "_part", (F.coalesce(F.sum("_n").over(before), F.lit(0))).alias("_first"))
    if base is not None:
        starts = starts.withColumn("_first", F.col("_first") + F.element_at(base, F.col("length")))
    where = _placement(histogram, capacity)

    @F.pandas_udf("sequence_id long, offset long")
    def place(at: pd.Series) -> pd.DataFrame:
        values = at.to_numpy(np.int64)
        run = np.searchsorted(where["at"], values, "right") - 1
        within = values - where["at"][run]
        times = where["times"][run]
        return pd.DataFrame({"sequence_id": where["sequence"][run] + within // times, "offset": where["offset"][run] + within % times * where["length"][run]})

    placed = pieces.join(starts, ["length", "_part"]).withColumn("_place", place(F.col("_first") + F.col("_rank")))
    return placed.select(F.col("_id").alias(id_col), "start", "length", payload, "doc_tokens", "_place.sequence_id", "_place.offset")


def sequences(pieces: DataFrame) -> DataFrame:
    """Whole sequences from pack(payload="ids"): sequence_id, ids. A sequence has at most capacity ids."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return pieces.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
