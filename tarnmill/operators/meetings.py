"""Sets of words that meet in buckets of bands: counts, sums and links of all pairs, with no pair written or sent.

Rows are classes: documents whose sets (or bands) are equal travel once, with their number. How many documents a
document meets follows from group sizes (inclusion and exclusion over bands), so that is linear. What needs each
pair's similarity is worked out where a bucket is read: tiles of a sparse product give the overlaps of all its
pairs, a pair counts in the first band in which it meets, and only sums by class, sums by similarity or a bucket's
spanning edges leave the task. Its time grows with the pairs, its memory, shuffles and results with the classes.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnmill.operators.dedup import SEED, coefficients, signature
#: Words whose hashes a worker remembers; texts that are looked at together.
CACHE, SLICE = 200_000, 500
#: Most frequent tokens, which travel as 16-bit ranks.
RANKS = 1 << 16
#: Rows of a tile, of a bucket that one task takes as it is (and where only a bound is held of most pairs), and that are counted together.
TILE, DEAL, WHOLE, COUNTED = 768, 8_000, 32_000, 100_000
#: Rows of a bucket whose pairs are listed, rows that such buckets are read in, columns that bound their overlaps, and those of single tokens; bytes of bounds that are kept.
LISTED, LOT, FOLD, HEAD, FOLDS = 48, 4_000, 1024, 512, 96_000_000
#: Share of a tile's rows from which a token is a column of a dense product.
DENSE = 0.04


def word_sets(df: DataFrame, text_col: str, bands: int, rows: int, seed: int = SEED, sets: bool = True) -> DataFrame:
    """df without its text, but with n (distinct tokens), keys (of bands, 32 bits each), and, with sets, tokens (sorted, 32 bits each), signature, told (names the set).

    Words are runs of two ASCII letters and digits or more of the lower-cased text, as word_tokens(ascii_text()) has
    them. Tokens are the first 32 bits of their md5; a band's key is that of its hashes,
    joined by commas. Both are the same in any SQL engine.
    """
    m = bands * rows
    kept = [c for c in df.columns if c != text_col]
    words = re.compile("[a-z0-9]{2,}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = coefficients(m, seed)
        known: dict[str, int] = {}
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                out: list[list] = [[], [], [], [], []]
                for text in batch.column(len(kept)).to_pylist():
                    found = set()
                    for w in set(words.findall((text or "").lower())):
                        t = known.get(w)
                        if t is None:
                            if len(known) >= CACHE:
                                known.clear()
                            t = known[w] = int.from_bytes(hashlib.md5(w.encode()).digest()[:4], "big")
                        found.add(t)
                    x = np.fromiter(found, np.int64, len(found))
                    x.sort()
                    s = signature(x, a, b)
                    keys = [int.from_bytes(hashlib.md5(",".join(map(str, s[k : k + rows].tolist())).encode()).digest()[:4], "big") for k in range(0, m, rows)] if len(x) else []
                    packed = x.astype("<u4").tobytes()
                    for o, v in zip(out, (len(x), np.array(keys, ">u4").tobytes(), packed, s.astype("<u4").tobytes(), hashlib.md5(packed).digest())):
                        o.append(v)
                arrays = [*batch.columns[:-1], pa.array(out[0], pa.int32()), *[pa.array(x, pa.binary()) for x in out[1:]]]
                yield pa.RecordBatch.from_arrays(arrays[: len(names)], names=names)

    fields = [*[df.schema[c] for c in kept], T.StructField("n", T.IntegerType()), *[T.StructField(c, T.BinaryType()) for c in (("keys", "tokens", "signature", "told") if sets else ("keys",))]]
    names = [f.name for f in fields]
    return df.select(*kept, text_col).mapInArrow(run, T.StructType(fields))


def _packed(column: pa.Array, width: int) -> np.ndarray:
    """A column of equally long binaries as rows of 32-bit numbers."""
    return np.frombuffer(b"".join(column.to_pylist()), "<u4").reshape(-1, width)


def _in_buckets(batches: Iterator[pa.RecordBatch], columns: int, least: int) -> Iterator[pa.Table]:
    """Whole buckets of rows sorted by their first columns, in tables of `least` rows or one bucket at least."""
    held: list[pa.RecordBatch] = []
    amount = 0

    def cut(b: pa.RecordBatch) -> np.ndarray:
        new = np.zeros(b.num_rows - 1, bool)
        for c in range(columns):
            x = b.column(c).to_numpy()
            new |= x[1:] != x[:-1]
        return np.flatnonzero(new) + 1

    def same(x: pa.RecordBatch, y: pa.RecordBatch) -> bool:
        return all(x.column(c)[x.num_rows - 1] == y.column(c)[0] for c in range(columns))

    for b in batches:
        if not b.num_rows:
            continue
        if held and amount >= least and not same(held[-1], b):
            yield pa.Table.from_batches(held)
            held, amount = [], 0
        cuts = cut(b)
        begin = 0
        while len(cuts):
            after = cuts[cuts + amount - begin >= least]
            if not len(after):
                break
            end = int(after[0])
            yield pa.Table.from_batches([*held, b.slice(begin, end - begin)])
            held, amount, begin = [], 0, end
            cuts = after[1:]
        held.append(b.slice(begin))
        amount += b.num_rows - begin
    if held:
        yield pa.Table.from_batches(held)


def in_bands(df: DataFrame, bands: int) -> DataFrame:
    """df and, a row for each band, its number and key."""
    at = F.posexplode(F.array(*[F.conv(F.hex(F.substring("keys", 4 * k + 1, 4)), 16, 10).cast("long") for k in range(bands)]))
    return df.select("*", at.alias("band", "key"))


def partner_counts(classes: DataFrame, bands: int) -> DataFrame:
    """keys, partners: for each class of equal keys (keys, w: its number of documents) how many documents, its own
    among them, meet its documents in a bucket of any band.

    Those that meet first in a band are those of its bucket, less those that agree in an earlier band too, by the
    sizes of the groups that agree in each subset of the earlier bands. No pair is formed.
    """
    dealt = in_bands(classes.select("keys", "w"), bands).select("band", "key", "keys", "w").repartition("band", "key").sortWithinPartitions("band", "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _in_buckets(batches, 2, COUNTED):
            t = table.combine_chunks().to_batches()[0]
            keys, w, band = _packed(t.column(2), bands), t.column(3).to_numpy(), t.column(0).to_numpy()
            for k in np.unique(band):
                own = np.flatnonzero(band == k)
                yield pa.RecordBatch.from_arrays([t.column(2).take(pa.array(own)), pa.array(first_meetings(keys[own], w[own], int(k)))], names=["keys", "partners"])

    return dealt.mapInArrow(run, "keys binary, partners long").groupBy("keys").agg(F.sum("partners").alias("partners"))


def first_meetings(keys: np.ndarray, w: np.ndarray, band: int) -> np.ndarray:
    """Of each row the weight of the rows (itself too in band 0) that agree with it in band and in none before."""
    ranks = [np.unique(keys[:, k], return_inverse=True)[1].astype(np.int64) for k in range(band + 1)]
    total = np.zeros(len(keys), np.int64)
    n = len(keys)

    def add(group: np.ndarray, sign: int, rest: int) -> None:
        size = np.bincount(group, weights=w).astype(np.int64)
        alone = len(size) == n  # then so are all finer groups, whose signs cancel out
        if alone and rest:
            return
        total[:] += sign * size[group]
        for k in range(rest):
            add(np.unique(group * n + ranks[k], return_inverse=True)[1], -sign, k)

    add(ranks[band], 1, band)
    return total


def frequent(classes: DataFrame) -> np.ndarray:
    """The most frequent tokens, sorted by frequency. They only shorten what travels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t, n = np.unique(np.frombuffer(b"".join(b.column(0).to_pylist()), "<u4"), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(t.astype(np.int64)), pa.array(n)], names=["t", "n"])

    counted = classes.select("tokens").mapInArrow(run, "t long, n long").groupBy("t").agg(F.sum("n").alias("n")).where("n > 1")
    return np.array([r[0] for r in counted.orderBy(F.desc("n"), "t").limit(RANKS).collect()], np.int64)


def _split(tokens: np.ndarray, common: np.ndarray, ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Ranks of the common tokens, compressed, and the others."""
    at = np.searchsorted(common, tokens)
    at[at == len(common)] = 0
    here = common[at] == tokens if len(common) else np.zeros(len(tokens), bool)
    near = np.sort(ranks[at[here]])
    steps = np.diff(near, prepend=0).astype("<u2")
    return zlib.compress(steps.view(np.uint8).reshape(-1, 2).T.tobytes(), 1), tokens[~here].astype("<u4").tobytes()


def shortened(sets: DataFrame, common: np.ndarray | None = None) -> DataFrame:
    """sets with near and rest in place of tokens: ranks of the most frequent ones (common, else found here), and the others."""
    common = frequent(sets) if common is None else common
    order = np.argsort(common)
    table = sets.sparkSession.sparkContext.broadcast((common[order], order.astype(np.int64)))
    kept = [c for c in sets.columns if c != "tokens"]
    names = [*kept, "near", "rest"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = [_split(np.frombuffer(x, "<u4").astype(np.int64), *table.value) for x in b.column(len(kept)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], *[pa.array([x[k] for x in parts], pa.binary()) for k in (0, 1)]], names=names)

    return sets.select(*kept, "tokens").mapInArrow(run, T.StructType([*[sets.schema[c] for c in kept], T.StructField("near", T.BinaryType()), T.StructField("rest", T.BinaryType())]))


def _joined(near: bytes, rest: bytes) -> np.ndarray:
    steps = np.frombuffer(zlib.decompress(near), np.uint8).reshape(2, -1)
    ranks = np.cumsum(steps[0].astype(np.int64) + (steps[1].astype(np.int64) << 8))
    return np.concatenate([ranks, np.frombuffer(rest, "<u4").astype(np.int64) + RANKS])


def _overlaps(a: tuple, b: tuple, high: int) -> np.ndarray:
    """Common tokens of every row of a with every row of b. Each: tokens and rows of its postings, sorted by token, and its number of rows."""
    (ta, ra, na), (tb, rb, nb) = a, b
    fa, fb = np.bincount(ta, minlength=high), np.bincount(tb, minlength=high)
    dense = (fa * fb > DENSE * DENSE * na * nb) & (na * nb > 4096)
    columns = np.flatnonzero(dense)
    out = np.zeros((na, nb), np.float32)
    place = np.full(high, -1)
    for at in range(0, len(columns), 4096):
        some = columns[at : at + 4096]
        place[some] = np.arange(len(some))
        x, y = np.zeros((na, len(some)), np.float32), np.zeros((nb, len(some)), np.float32)
        for m, t, r in ((x, ta, ra), (y, tb, rb)):
            p = place[t]
            m[r[p >= 0], p[p >= 0]] = 1
        out += x @ y.T
        place[some] = -1
    times = np.where(dense, 0, fb)[ta]
    starts = (np.cumsum(fb) - fb)[ta]
    for low, top in _pieces(times, 1_000_000):
        n = times[low:top]
        total = int(n.sum())
        if total:
            ends = np.cumsum(n)
            other = rb[np.arange(total) + np.repeat(starts[low:top] - ends + n, n)]
            out += np.bincount(np.repeat(ra[low:top], n) * nb + other, minlength=na * nb).reshape(na, nb)
    return out


def _pieces(times: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    done = np.cumsum(times)
    low = 0
    while low < len(times):
        top = max(low + 1, int(np.searchsorted(done, (done[low - 1] if low else 0) + most, "right")))
        yield low, top
        low = top


class Bucket:
    """The rows of one bucket (or of two parts of it), and its tiles of pairs."""

    def __init__(self, t: pa.RecordBatch, bands: int, m: int):
        at = {c: k for k, c in enumerate(t.schema.names)}
        self.band, self.id = t.column(at["band"])[0].as_py(), t.column(at["id"]).to_numpy()
        self.w, self.n, self.part = (t.column(at[c]).to_numpy() for c in ("w", "n", "part"))
        self.apart = t.column(at["i"])[0].as_py() != t.column(at["j"])[0].as_py()
        self.keys, self.signature = _packed(t.column(at["keys"]), bands), _packed(t.column(at["signature"]), m)
        sets = [_joined(x, y) for x, y in zip(t.column(at["near"]).to_pylist(), t.column(at["rest"]).to_pylist())]
        tokens, rows = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        order = np.argsort(tokens, kind="stable")
        tokens, rows = tokens[order], rows[order]
        new = np.append(True, tokens[1:] != tokens[:-1])
        shared = ~(new & np.append(new[1:], True))
        tokens, self.rows = np.cumsum(new & shared)[shared] - 1, rows[shared]
        self.tokens, self.high = tokens, int(tokens[-1]) + 1 if len(tokens) else 0

    def tiles(self) -> Iterator[tuple]:
        """Slices of rows x and y, which pairs count here (x before y), equal hashes, similarities."""
        n = len(self.id)
        cuts = [(k, min(k + TILE, n)) for k in range(0, n, TILE)]
        posts = []
        for low, top in cuts:
            own = (self.rows >= low) & (self.rows < top)
            posts.append((self.tokens[own], self.rows[own] - low, top - low))
        for i, x in enumerate(cuts):
            for j in range(i, len(cuts)):
                a, b = slice(*x), slice(*cuts[j])
                here = np.ones((x[1] - x[0], cuts[j][1] - cuts[j][0]), bool)
                if i == j:
                    here = np.triu(here, 1)
                if self.apart:
                    here &= self.part[a][:, None] != self.part[b][None]
                for k in range(self.band):
                    here &= self.keys[a, k][:, None] != self.keys[b, k][None]
                if not here.any():
                    continue
                both = _overlaps(posts[i], posts[j], self.high).astype(np.float64) if self.high else np.zeros(here.shape)
                exact = both / (self.n[a][:, None] + self.n[b][None] - both)
                yield a, b, here, exact

    def equal(self, a: slice, b: slice) -> np.ndarray:
        """Equal hashes of signatures."""
        out = np.zeros((a.stop - a.start, b.stop - b.start), np.int64)
        for k in range(self.signature.shape[1]):
            out += self.signature[a, k][:, None] == self.signature[b, k][None]
        return out


MILLION = 1e6


def millionths(exact: np.ndarray) -> np.ndarray:
    return np.floor(exact * MILLION + 0.5).astype(np.int64)


def _by_row(x: Bucket, least: float, m: int) -> dict[str, np.ndarray]:
    """Sums over the documents that each row's documents meet: number, equal hashes, similarities, and those of `least`."""
    out = np.zeros((4, len(x.id)), np.int64)
    for a, b, here, exact in x.tiles():
        for k, v in enumerate((here, here * x.equal(a, b), here * millionths(exact), here & (exact >= least))):
            v = v.astype(np.float64)  # sums stay below 2**53
            out[k, a] += (v @ x.w[b].astype(np.float64)).astype(np.int64)
            out[k, b] += (x.w[a].astype(np.float64) @ v).astype(np.int64)
    return {"id": x.id, **dict(zip(("met", "same", "exact", "similar"), out))}


def _by_similarity(x: Bucket, least: float, m: int) -> dict[str, np.ndarray]:
    """By equal hashes, tenth of the similarity and whether it is `least`: pairs of documents, and sums of the errors."""
    sums = np.zeros((5, (m + 1) * 20))
    for a, b, here, exact in x.tiles():
        p, q = np.nonzero(here)
        e, k, w = exact[p, q], x.equal(a, b)[p, q], (x.w[a][p] * x.w[b][q]).astype(np.float64)
        cell = (k * 10 + np.minimum(millionths(e) // 100_000, 9)) * 2 + (e >= least)
        off, told = np.abs(k / m - e), np.abs(k / m - millionths(e) / MILLION)
        for s, v in zip(sums, (w, w * off, w * off * off, w * told, w * (off <= 0.05))):
            s += np.bincount(cell, weights=v, minlength=len(s))
        top = np.full(sums.shape[1], -1.0)
        np.maximum.at(top, cell, off)
        x.top = np.maximum(getattr(x, "top", top), top)
    some = np.flatnonzero(sums[0])
    return {"same": some // 20, "tenth": some // 2 % 10, "similar": some % 2, "pairs": sums[0, some].astype(np.int64), "off": sums[1, some], "squares": sums[2, some], "told": sums[3, some], "near": sums[4, some].astype(np.int64), "most": x.top[some] if len(some) else np.zeros(0)}


class Lot:
    """Whole buckets read together, for what only asks whether a similarity is `least`: sets are read and compared where a bound lets them reach it."""

    def __init__(self, t: pa.RecordBatch, bands: int, m: int, least: float):
        at = {c: k for k, c in enumerate(t.schema.names)}
        self.id, self.w, self.n, self.part, self.band, key, i, j = (t.column(at[c]).to_numpy() for c in ("id", "w", "n", "part", "band", "key", "i", "j"))
        self.keys, self.signature = _packed(t.column(at["keys"]), bands), _packed(t.column(at["signature"]), m)
        self.near, self.rest, self.least, self.known = t.column(at["near"]), t.column(at["rest"]), least, {}
        self.apart = i != j
        cuts = np.flatnonzero(np.any([x[1:] != x[:-1] for x in (self.band, key, i, j)], axis=0)) + 1
        starts, ends = np.append(0, cuts), np.append(cuts, len(self.id))
        large = (ends - starts > LISTED) | self.apart[starts]
        self.large = list(zip(starts[large].tolist(), ends[large].tolist()))
        #: of each row of a small bucket, how many rows follow in it
        self.later = np.where(np.repeat(large, ends - starts), 0, np.repeat(ends, ends - starts) - np.arange(len(self.id)) - 1)

    def set(self, k: int) -> np.ndarray:
        if k not in self.known:
            self.known[k] = _joined(self.near[k].as_py(), self.rest[k].as_py())
        return self.known[k]

    def folded(self, rows: np.ndarray, wide: int) -> np.ndarray:
        """Tokens of each set by column: the most frequent ones have their own, the others share `wide`."""
        at, t = np.repeat(np.arange(len(rows)) * (HEAD + wide), self.n[rows]), np.concatenate([self.set(k) for k in rows.tolist()])
        out = np.bincount(at + np.where(t < HEAD, t, HEAD + t % wide), minlength=len(rows) * (HEAD + wide)).reshape(len(rows), -1)
        return out.astype(np.min_scalar_type(out.max(initial=0)))

    def reach(self, common: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Whether so many common tokens make rows p and q similar."""
        return common / (self.n[p] + self.n[q] - common) >= self.least

    def listed(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The pairs of small buckets that count here."""
        for low, top in _pieces(self.later, 100_000):
            n = self.later[low:top]
            p = np.repeat(np.arange(low, top), n)
            q = p + 1 + np.arange(len(p)) - np.repeat(np.cumsum(n) - n, n)
            here = np.ones(len(p), bool)
            for k in range(self.keys.shape[1]):
                here &= (self.keys[p, k] != self.keys[q, k]) | (self.band[p] <= k)
            yield p[here], q[here]

    def similar(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Places in p and q of those that are similar. The lesser of both counts, summed over columns, bounds the common tokens."""
        left = np.flatnonzero(self.reach(np.minimum(self.n[p], self.n[q]), p, q))
        if not len(left):
            return left
        rows, at = np.unique(np.concatenate([p[left], q[left]]), return_inverse=True)
        x, y, sure = at[: len(left)], at[len(left) :], []
        folded = self.folded(rows, FOLD)
        for low in range(0, len(left), 4096):
            some = slice(low, low + 4096)
            bound = np.minimum(folded[x[some]], folded[y[some]]).sum(axis=1, dtype=np.int64)
            sure.append(np.flatnonzero(self.reach(np.minimum(bound, np.minimum(self.n[p[left[some]]], self.n[q[left[some]]])), p[left[some]], q[left[some]])) + low)
        left = left[np.concatenate(sure)]
        return left[self.reach(self.common(p[left], q[left]), p[left], q[left])]

    def common(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Common tokens of rows p and q, by sorting those of some pairs."""
        out = np.zeros(len(p), np.int64)
        for low, top in _pieces(self.n[p] + self.n[q], 2_000_000):
            own = np.concatenate([self.set(k) for k in (*p[low:top].tolist(), *q[low:top].tolist())])
            own += np.concatenate([np.repeat(np.arange(top - low), self.n[x[low:top]]) for x in (p, q)]) << 33
            own.sort()
            out[low:top] = np.bincount(own[1:][own[1:] == own[:-1]] >> 33, minlength=top - low)
        return out

    def tiles(self, low: int, top: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Rows a and b of a large bucket, in the order of their sizes, and which of their pairs count here."""
        rows, cuts, at = low + np.argsort(self.n[low:top], kind="stable"), [], 0
        while at < len(rows):
            first = int(self.n[rows[at]])
            end = min(at + max(32, min(1024, (1 << 21) // (HEAD + _wide(first)))), int(np.searchsorted(self.n[rows], 2 * first, "right")))
            cuts.append(rows[at:end])
            at = end
        for k, a in enumerate(cuts):
            for b in cuts[k:]:
                here = np.ones((len(a), len(b)), bool)
                if a is b:
                    here = np.triu(here, 1)
                if self.apart[low]:
                    here &= self.part[a][:, None] != self.part[b][None]
                for c in range(self.band[low]):
                    here &= self.keys[a, c][:, None] != self.keys[b, c][None]
                if here.any():
                    yield a, b, here

    def bounded(self, a: np.ndarray, b: np.ndarray, here: np.ndarray, folds: dict) -> tuple[np.ndarray, np.ndarray]:
        """Places of the pairs that may be similar: the product of two rows of folded() is no less than their common tokens."""
        if self.least * self.n[b[0]] > self.n[a[-1]]:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        wide = max(_wide(int(self.n[x[-1]])) for x in (a, b))
        if sum(x.nbytes for x in folds.values()) > FOLDS:
            folds.clear()
        for x in (a, b):
            if (x[0], wide) not in folds:
                folds[x[0], wide] = self.folded(x, wide)
        bound = folds[a[0], wide].astype(np.float32) @ folds[b[0], wide].astype(np.float32).T
        need = self.least / (1 + self.least)
        return np.nonzero(here & (bound >= (need * self.n[a] - 0.5).astype(np.float32)[:, None] + (need * self.n[b]).astype(np.float32)[None]))

    def sure(self, a: np.ndarray, b: np.ndarray, p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those of the places that are similar."""
        if 20 * len(p) > len(np.unique(p)) * len(np.unique(q)):
            (x, at), (y, bt) = np.unique(p, return_inverse=True), np.unique(q, return_inverse=True)
            posts, sets = [], [np.concatenate([self.set(k) for k in s.tolist()]) for s in (a[x], b[y])]
            known, named = np.unique(np.concatenate(sets), return_inverse=True)
            for s, own in ((a[x], named[: len(sets[0])]), (b[y], named[len(sets[0]) :])):
                order = np.argsort(own, kind="stable")
                posts.append((own[order], np.repeat(np.arange(len(s)), self.n[s])[order], len(s)))
            common = _overlaps(*posts, len(known))[at, bt].astype(np.int64)
        else:
            common = self.common(a[p], b[q])
        yes = self.reach(common, a[p], b[q])
        return p[yes], q[yes]


def _wide(n: int) -> int:
    """Columns for the less frequent of n tokens, so that few share one."""
    return 1 << min(16, max(8, (n - 1).bit_length()))


def _alike(x: Lot, m: int) -> dict[str, np.ndarray]:
    """By equal hashes and whether the similarity is `least`: pairs of documents."""
    sums = np.zeros((m + 1, 2))
    for p, q in x.listed():
        k, similar = np.zeros(len(p), np.int64), np.zeros(len(p), np.int64)
        for c in range(m):
            k += x.signature[p, c] == x.signature[q, c]
        similar[x.similar(p, q)] = 1
        sums += np.bincount(2 * k + similar, weights=x.w[p] * x.w[q], minlength=sums.size).reshape(sums.shape)
    for low, top in x.large:
        folds: dict = {}
        for a, b, here in x.tiles(low, top):
            k = np.zeros(here.shape, np.min_scalar_type(m))
            for c in range(m):
                k += x.signature[a, c][:, None] == x.signature[b, c][None]
            w = x.w[a][:, None] * x.w[b][None]
            every = np.bincount(k[here], weights=w[here], minlength=m + 1)
            p, q = x.bounded(a, b, here, folds)
            if len(p):
                p, q = x.sure(a, b, p, q)
            similar = np.bincount(k[p, q], weights=w[p, q], minlength=m + 1)
            sums += np.stack([every - similar, similar], axis=1)
    same, similar = np.nonzero(sums)
    return {"same": same, "similar": similar, "pairs": sums[same, similar].astype(np.int64)}


def _joins(label: np.ndarray, p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Labels of rows once pairs p, q are joined, and those of the pairs that join them."""
    ends: tuple[list, list] = ([], [])
    while True:
        apart = label[p] != label[q]
        p, q = p[apart], q[apart]
        if not len(p):
            return label, *ends
        high, low = np.maximum(label[p], label[q]), np.minimum(label[p], label[q])
        which, first = np.unique(high, return_index=True)
        ends[0].append(p[first])
        ends[1].append(q[first])
        to = np.arange(len(label))
        to[which] = low[first]
        while (to[to] != to).any():
            to = to[to]
        label = to[label]


def _spanning(x: Lot, m: int) -> dict[str, np.ndarray]:
    """Edges that connect what pairs of `least` connect: fewer than there are rows. What is connected already is not compared."""
    label, ends = np.arange(len(x.id)), ([], [])

    def join(p: np.ndarray, q: np.ndarray) -> None:
        nonlocal label
        label, *more = _joins(label, p, q)
        for e, one in zip(ends, more):
            e.extend(one)

    for p, q in x.listed():
        found = x.similar(p, q)
        join(p[found], q[found])
    for low, top in x.large:
        folds: dict = {}
        for a, b, here in x.tiles(low, top):
            if (label[a] == label[a[0]]).all() and (label[b] == label[a[0]]).all():
                continue
            p, q = x.bounded(a, b, here, folds)
            new = label[a[p]] != label[b[q]]
            if new.any():
                p, q = x.sure(a, b, p[new], q[new])
                join(a[p], b[q])
    p, q = (np.concatenate([np.zeros(0, np.int64), *e]) for e in ends)
    return {"id_a": x.id[p], "id_b": x.id[q]}


#: What leaves the tasks, by purpose.
PURPOSES = {
    "rows": (_by_row, "id long, met long, same long, exact long, similar long"),
    "similarity": (_by_similarity, "same long, tenth long, similar long, pairs long, off double, squares double, told double, near long, most double"),
    "alike": (_alike, "same long, similar long, pairs long"),
    "spanning": (_spanning, "id_a long, id_b long"),
}
#: Of these, the ones that only ask whether a similarity is `least`.
TOGETHER = ("alike", "spanning")


def meetings(classes: DataFrame, bands: int, rows: int, purpose: str, least: float = 0.5, deal: int | None = None) -> DataFrame:
    """One of PURPOSES over all pairs of classes (id, w, n, keys, signature, near, rest: see shortened(); written before) that meet in a bucket.

    Large buckets are cut into parts of `deal` rows; each two parts meet in a task, so a row travels once for each part.
    """
    m, together = bands * rows, purpose in TOGETHER
    deal = deal or (WHOLE if together else DEAL)
    # a row's buckets, without those it has for itself, are told before its set travels to each of them
    placed = in_bands(classes.select("id", "keys"), bands)
    crowded = placed.groupBy("band", "key").agg(F.count(F.lit(1)).alias("size")).where("size > 1").select("band", "key", F.ceil(F.col("size") / F.lit(deal)).cast("int").alias("parts"))
    stops = placed.select("id", "band", "key").join(crowded, ["band", "key"]).groupBy("id").agg(F.collect_list(F.struct("band", "key", "parts")).alias("stops"))
    each = classes.join(stops, "id").withColumn("stop", F.explode("stops")).select("*", "stop.*").drop("stop", "stops")
    each = each.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).withColumn("q", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    each = each.select("band", "key", F.least("part", "q").alias("i"), F.greatest("part", "q").alias("j"), "part", "id", F.col("w").cast("long").alias("w"), "n", "keys", F.lit(b"").alias("signature") if purpose == "spanning" else "signature", "near", "rest")
    dealt = each.repartition("band", "key", "i", "j").sortWithinPartitions("band", "key", "i", "j")
    work, schema = PURPOSES[purpose]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _in_buckets(batches, 4, LOT if together else 1):
            t = table.combine_chunks().to_batches()[0]
            if t.num_rows > 1:
                got = work(Lot(t, bands, m, least), m) if together else work(Bucket(t, bands, m), least, m)
                if len(next(iter(got.values()))):
                    yield pa.RecordBatch.from_arrays([pa.array(v) for v in got.values()], names=list(got))

    return dealt.mapInArrow(run, schema)


#: Rows of a part of all sets; parts that there are at least, as soon as there are some rows for each.
PART, PARTS = 48_000, 5


class Agreement:
    """Signatures of token sets as they travel, and in which configurations (bands, rows) two of them share a band."""

    def __init__(self, common: np.ndarray, configs: list[tuple[int, int]], m: int, seed: int = SEED):
        self.common, self.configs = np.append(common, np.zeros(RANKS - len(common), np.int64)), configs
        self.a, self.b = coefficients(m, seed)

    def signed(self, tokens: np.ndarray) -> np.ndarray:
        near = tokens < RANKS
        return signature(np.where(near, self.common[np.where(near, tokens, 0)], tokens - RANKS), self.a, self.b)

    def found(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Of rows x and y of signatures, by configuration, how many share a band."""
        same = x == y
        return np.array([same[:, : b * r].reshape(-1, b, r).all(axis=2).any(axis=1).sum() for b, r in self.configs], np.int64)


class _Sized:
    """Sets in the order of their sizes, cut into tiles of alike sizes."""

    def __init__(self, n: np.ndarray, near: list[bytes], rest: list[bytes]):
        self.n, self.ends = n.astype(np.int64), np.append(0, np.cumsum(n.astype(np.int64)))
        self.flat = np.empty(self.ends[-1], np.int64)
        for k, (x, y) in enumerate(zip(near, rest)):
            self.flat[self.ends[k] : self.ends[k + 1]] = _joined(x, y)
        self.tiles, low, self.signatures = [], 0, {}
        while low < len(n):
            wide = self.wide(low)
            top = min(low + max(32, min(1024, (1 << 21) // wide)), int(np.searchsorted(self.n, 2 * self.n[low], "right")))
            self.tiles.append((low, top, self.wide(top - 1)))
            low = top

    def wide(self, k: int) -> int:
        """Columns for a set: four for each of its tokens, so that few share one."""
        return 1 << min(16, max(9, int(4 * self.n[k] - 1).bit_length()))

    def set(self, k: int) -> np.ndarray:
        return self.flat[self.ends[k] : self.ends[k + 1]]

    def folded(self, low: int, top: int, wide: int) -> np.ndarray:
        """Tokens of each set by column. The product of two rows is the number of their common tokens at least."""
        rows = np.repeat(np.arange(top - low), self.n[low:top])
        return np.bincount(rows * wide + self.flat[self.ends[low] : self.ends[top]] % wide, minlength=(top - low) * wide).reshape(-1, wide).astype(np.float32)

    def signed(self, rows: np.ndarray, agreement: Agreement) -> np.ndarray:
        for k in rows.tolist():
            if k not in self.signatures:
                self.signatures[k] = agreement.signed(self.set(k)).astype(np.uint32)
        return np.stack([self.signatures[k] for k in rows.tolist()])


def _common_tokens(x: _Sized, y: _Sized, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exactly, of sets p of x and q of y."""
    (a, at), (b, bt) = np.unique(p, return_inverse=True), np.unique(q, return_inverse=True)
    tokens, posts = [np.concatenate([s.set(k) for k in rows.tolist()]) for s, rows in ((x, a), (y, b))], []
    known, inverse = np.unique(np.concatenate(tokens), return_inverse=True)
    for s, rows, own in ((x, a, inverse[: len(tokens[0])]), (y, b, inverse[len(tokens[0]) :])):
        order = np.argsort(own, kind="stable")
        posts.append((own[order], np.repeat(np.arange(len(rows)), s.n[rows])[order], len(rows)))
    return _overlaps(*posts, len(known))[at, bt].astype(np.int64)


def _similar(x: _Sized, y: _Sized, agreement: Agreement) -> Iterator[np.ndarray]:
    """Pairs of sets with a similarity of 0.5 at least, one of x and one of y (if y is x: each once): how many, and how many share a band."""
    for i, (low, top, wide) in enumerate(x.tiles):
        folded: dict[int, np.ndarray] = {}
        for j, (first, last, other) in enumerate(y.tiles):
            if y is x and j < i or 2 * y.n[last - 1] < x.n[low]:
                continue
            if y.n[first] > 2 * x.n[top - 1]:
                break
            w = max(wide, other)
            if w not in folded:
                folded[w] = x.folded(low, top, w)
            bound = folded[w] @ y.folded(first, last, w).T
            p, q = np.nonzero(3 * bound >= x.n[low:top, None] + y.n[None, first:last])
            p, q = p + low, q + first
            if y is x:
                p, q = p[p < q], q[p < q]
            if not len(p):
                continue
            sure = 3 * _common_tokens(x, y, p, q) >= x.n[p] + y.n[q]
            p, q = p[sure], q[sure]
            for at in range(0, len(p), 20_000):
                some, those = p[at : at + 20_000], q[at : at + 20_000]
                yield np.append(len(some), agreement.found(x.signed(some, agreement), y.signed(those, agreement)))


def similar_found(sets: DataFrame, agreement: Agreement, part: int = PART, parts: int = PARTS) -> np.ndarray:
    """Of all pairs of sets (id, n, near, rest; written before) with a similarity of 0.5 at least: how many, and by configuration how many share a band.

    Exact: every two parts meet in a task, where products of folded sets bound the overlaps of all pairs of alike sizes,
    and what passes is counted. No pair is written; a set is sent once for each part.
    """
    n = max(min(parts, -(-sets.count() // 50)), -(-sets.count() // part), 1)
    dealt = sets.select("id", "n", "near", "rest", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias("part")).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    dealt = dealt.select(F.least("part", "q").alias("i"), F.greatest("part", "q").alias("j"), "part", "n", "near", "rest")
    block = (F.col("j") * (F.col("j") + 1) / 2 + F.col("i")).cast("int")
    dealt = dealt.repartitionById(n * (n + 1) // 2, block).sortWithinPartitions("i", "j", "n")
    names = ["pairs", *[f"found{k}" for k in range(len(agreement.configs))]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(names), np.int64)
        for t in _in_buckets(batches, 2, 1):
            i, part = t.column("i")[0].as_py(), t.column("part").to_numpy()
            halves = []
            for own in dict.fromkeys((i, t.column("j")[0].as_py())):
                some = t.filter(pa.array(part == own))
                halves.append(_Sized(some.column("n").to_numpy(), some.column("near").to_pylist(), some.column("rest").to_pylist()))
            for got in _similar(halves[0], halves[-1], agreement):
                total += got
        yield pa.RecordBatch.from_arrays([pa.array([int(v)]) for v in total], names=names)

    sums = dealt.mapInArrow(run, ", ".join(f"{c} long" for c in names)).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names]).first()
    return np.array(sums, np.int64)


def beside_found(sets: DataFrame, by: str, agreement: Agreement) -> np.ndarray:
    """Of pairs of each set (id, by, near, rest) with the next id of its group whose similarity is below 0.5: how many, and by configuration how many share a band.

    Rows are dealt by ranges; the driver gets sums and the two outer rows of each.
    """
    dealt = sets.select(by, "id", "near", "rest").repartitionByRange(by, "id").sortWithinPartitions(by, "id")
    k = len(agreement.configs)

    def compared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        common = len(np.intersect1d(x, y, assume_unique=True))
        if 3 * common >= len(x) + len(y):
            return np.zeros(k + 1, np.int64)
        return np.append(1, agreement.found(agreement.signed(x)[None], agreement.signed(y)[None]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total, outer = np.zeros(k + 1, np.int64), []
        for b in batches:
            for row in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()):
                if outer and outer[-1][0] == row[0]:
                    total += compared(_joined(*outer[-1][1:]), _joined(*row[1:]))
                outer = [*outer[:1], row]
        if outer:
            at = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), *[pa.array([x], t) for r in (outer[0], outer[-1]) for x, t in zip(r, (pa.string(), pa.binary(), pa.binary()))], pa.array([total.tolist()], pa.list_(pa.int64()))], names=["at", "g0", "n0", "r0", "g1", "n1", "r1", "sums"])

    rows = dealt.withColumn(by, F.col(by).cast("string")).mapInArrow(run, "at long, g0 string, n0 binary, r0 binary, g1 string, n1 binary, r1 binary, sums array<long>").collect()
    rows.sort(key=lambda r: r["at"])
    total = np.zeros(k + 1, np.int64)
    for before, r in zip([None, *rows], rows):
        total += np.array(r["sums"], np.int64)
        if before is not None and before["g1"] == r["g0"]:
            total += compared(_joined(bytes(before["n1"]), bytes(before["r1"])), _joined(bytes(r["n0"]), bytes(r["r0"])))
    return total
