"""Benchmark decontamination by winnowed fingerprints (operator 10).

Texts are A-Z lower-cased and cut into words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``.  From each span of W consecutive
K-word hashes the least is kept, so two texts that share W + K - 1 = 13 words share a kept hash whose place is the same
in both.  Kept hashes of documents are looked up among those of the benchmark, and each hit is extended word by word to
the longest common run; runs of 13 words or more are hits.  An item of fewer words is one window, looked up whole.

The benchmark is handled in blocks: a block is broadcast only after its bytes were counted, one at a time, and is destroyed
when all documents have met it.  A larger benchmark means more blocks, not a larger one: what the earlier blocks hit
(runs of words and items) then goes along with each document.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

U64 = np.uint64
WINDOW, K = 13, 5
W = WINDOW - K + 1


def winnow(g: np.ndarray, w: int = W) -> np.ndarray:
    """Positions of the (rightmost) least value of each w consecutive ones."""
    if len(g) < w:
        return np.zeros(0, np.int64)
    low = C.sliding_min(g, w)
    # a position is kept if some window that it lies in has its value as the least one and no later equal value
    reach = np.full(len(g), -1, np.int64)
    step = np.arange(len(low))
    for j in range(w):
        at = step + j
        reach[step] = np.where(g[at] == low, at, reach[step])
    return np.unique(reach[: len(low)])


class Index:
    """Windows of one block of the benchmark."""

    def __init__(self, ids: list, texts: list[str]):
        buf, offs = C.text_buffer(pa.array(texts, pa.large_string()))
        _, _, h, first = C.words(buf, offs, C.ALNUM_WORD)
        self.ids, self.h, self.first = ids, h, first
        n = np.diff(first)
        g = C.grams(h, K)
        prints, places, owners = [], [], []
        self.short: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        short: dict[int, list[tuple[int, int]]] = {}
        for i, k in enumerate(n.tolist()):
            a = int(first[i])
            if k >= WINDOW:
                p = winnow(g[a : a + k - K + 1]) + a
                prints.append(g[p])
                places.append(p)
                owners.append(np.full(len(p), i))
            elif k:
                short.setdefault(k, []).append((int(C.grams(h[a : a + k], k)[0]), i))
        cat = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
        self.prints, self.places, self.owners = cat(prints, U64), cat(places, np.int64), cat(owners, np.int64)
        o = np.argsort(self.prints, kind="stable")
        self.prints, self.places, self.owners = self.prints[o], self.places[o], self.owners[o]
        for k, v in short.items():
            v.sort()
            self.short[k] = np.array([x for x, _ in v], U64), np.array([i for _, i in v], np.int64)

    def hits(self, h: np.ndarray, first: np.ndarray):
        """(row, first word, end word, item) of every hit, words counted over the batch; rows may repeat."""
        out = []
        row_of = np.repeat(np.arange(len(first) - 1), np.diff(first))
        if len(self.prints):
            g = C.grams(h, K)
            ok = row_of[K - 1 :] == row_of[: len(g)] if len(g) else np.zeros(0, bool)
            # windows that reach into the next row only add positions, which the extension below rejects
            p = winnow(g)
            p = p[ok[p]]
            lo, hi = np.searchsorted(self.prints, g[p], "left"), np.searchsorted(self.prints, g[p], "right")
            n = hi - lo
            p, at = np.repeat(p, n), np.repeat(lo - np.concatenate([[0], np.cumsum(n)])[:-1], n) + np.arange(n.sum()) if len(n) else np.zeros(0, np.int64)
            q, item = self.places[at], self.owners[at]
            row = row_of[p]
            left, right = p.copy(), p + 0
            # equal runs to the left and right; pairs on one diagonal come to the same run
            act, d = np.arange(len(p)), 1
            while len(act):
                a, b = p[act] - d, q[act] - d
                good = (a >= first[row[act]]) & (b >= self.first[item[act]])
                act, a, b = act[good], a[good], b[good]
                act = act[h[a] == self.h[b]]
                left[act] -= 1
                d += 1
            act, d = np.arange(len(p)), 0
            while len(act):
                a, b = p[act] + d, q[act] + d
                good = (a < first[row[act] + 1]) & (b < self.first[item[act] + 1])
                act, a, b = act[good], a[good], b[good]
                act = act[h[a] == self.h[b]]
                right[act] += 1
                d += 1
            keep = right - left >= WINDOW
            out.append(np.stack([row[keep], left[keep], right[keep], item[keep]]))
        for k, (keys, items) in self.short.items():
            g = C.grams(h, k)
            if not len(g):
                continue
            p = np.flatnonzero((row_of[k - 1 :] == row_of[: len(g)]) & np.isin(g, keys))
            lo, hi = np.searchsorted(keys, g[p], "left"), np.searchsorted(keys, g[p], "right")
            n = hi - lo
            at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)])[:-1], n) + np.arange(n.sum()) if len(n) else np.zeros(0, np.int64)
            p = np.repeat(p, n)
            out.append(np.stack([row_of[p], p, p + k, items[at]]))
        return np.unique(np.concatenate(out, axis=1), axis=1) if out else np.zeros((4, 0), np.int64)


_INDEX: dict = {}
C.HELD["winnow"] = _INDEX.clear
MINE = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
STATE = "__runs array<long>, __items array<string>"


def _index(key: str, block) -> Index:
    """A worker keeps the index of one block, the last one that it met."""
    if key not in _INDEX:
        _INDEX.clear()
        _INDEX[key] = Index(*block.value)
    return _INDEX[key]


def _blocks(bench: DataFrame, block_bytes: int) -> list[DataFrame]:
    """Parts of the benchmark that each have at most block_bytes as they are loaded (an item beyond that is one by itself)."""
    size = bench.withColumn("__size", 2 * (F.octet_length("text") + 32))
    total, count = size.agg(F.coalesce(F.sum("__size"), F.lit(0)), F.count("*")).first()
    n = max(1, -(-total // block_bytes))
    while n > 1:
        part = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
        most = size.distinct().groupBy(part).agg(F.sum("__size").alias("b"), F.count("*").alias("k")).where("k > 1").agg(F.max("b")).first()[0]
        if not most or most <= block_bytes or n > 64 * count:
            break
        n *= 2
    bench = bench.distinct()
    return [bench if n == 1 else bench.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i) for i in range(n)]


def scan(docs: DataFrame, benchmark: DataFrame, block_bytes: int = 32 << 20) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for each row of ``docs(doc_id, text)``; other columns
    of ``docs`` are kept, then the text too, and result columns win over columns of the same name.

    A null text has no words.  Items without words, and null items, never occur; an item_id that stands for several texts
    counts once.  Rows with equal doc_id are judged apart.  An empty benchmark leaves every document clean.
    """
    from pyspark.sql.types import StructType

    spark = docs.sparkSession
    bench = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    mine = StructType.fromDDL(MINE).names
    carried = [c for c in docs.columns if c not in mine]
    docs = docs.select(*carried)
    keep = carried if set(docs.columns) - {"doc_id", "text"} else ["doc_id"]

    def meet(key, block, known: bool, last: bool):
        def judge(batches):
            for b in C.pieces(batches, operator="winnow"):
                ix = _index(key, block)
                buf, offs = C.text_buffer(b.column("text"))
                _, _, h, first = C.words(buf, offs, C.ALNUM_WORD)
                row, a, e, item = ix.hits(h, first)
                found: dict[int, set[str]] = {}
                if known:
                    for r, (runs, items) in enumerate(zip(b.column("__runs").to_pylist(), b.column("__items").to_pylist())):
                        if runs:
                            more = np.array(runs, np.int64).reshape(-1, 2) + first[r]
                            a, e = np.concatenate([a, more[:, 0]]), np.concatenate([e, more[:, 1]])
                            found[r] = set(items)
                for r, i in zip(row.tolist(), item.tolist()):
                    if ix.ids[i] is not None:
                        found.setdefault(r, set()).add(ix.ids[i])
                hit = np.bincount(a, minlength=len(h) + 1) - np.bincount(e, minlength=len(h) + 1)
                cover = np.cumsum(hit)[:-1] > 0
                yield final(b, first, cover, found) if last else state(b, first, cover, found)

        return judge

    def state(b, first, cover, found):
        """Hit words as runs, counted from the document's first word, and the items so far."""
        begin, end = cover.copy(), cover.copy()
        begin[1:] &= ~cover[:-1]
        end[:-1] &= ~cover[1:]
        own = first[:-1][np.diff(first) > 0]
        begin[own], end[own[own > 0] - 1] = cover[own], cover[own[own > 0] - 1]
        a, e = np.flatnonzero(begin), np.flatnonzero(end) + 1
        cut = np.searchsorted(a, first)
        row = np.repeat(np.arange(len(first) - 1), np.diff(cut))
        runs = np.stack([a - first[row], e - first[row]], 1).ravel()
        runs = pa.ListArray.from_arrays(pa.array(2 * cut, pa.int32()), pa.array(runs, pa.int64()))
        items = pa.array([sorted(found.get(r, ())) for r in range(b.num_rows)], pa.list_(pa.string()))
        return pa.RecordBatch.from_arrays([*(b.column(c) for c in carried), runs, items], [*carried, "__runs", "__items"])

    def final(b, first, cover, found):
        covered = np.concatenate([[0], np.cumsum(cover)])
        n_words, n_hit = np.diff(first), covered[first[1:]] - covered[first[:-1]]
        sha = [hashlib.sha256(",".join(sorted(found.get(r, ()))).encode()).hexdigest() for r in range(b.num_rows)]
        cols = [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array([len(found.get(r, ())) for r in range(b.num_rows)], pa.int64()), pa.array(sha), pa.array((n_hit > 0) & (20 * n_hit >= n_words))]
        return pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *cols], [*keep, *mine])

    blocks, at, was = _blocks(bench, block_bytes), docs, None
    for i, part in enumerate(blocks):
        last = i == len(blocks) - 1
        rows = part.collect()  # at most block_bytes, by the count above
        block = spark.sparkContext.broadcast(([r["item_id"] for r in rows], [r["text"] for r in rows]))
        schema = StructType([*docs.select(*(keep if last else carried)).schema, *StructType.fromDDL(MINE if last else STATE)])
        at = at.mapInArrow(meet(uuid.uuid4().hex, block, i > 0, last), schema)
        if len(blocks) > 1:
            at = C.save(at, "op10-met")
            block.destroy()
            if was is not None:
                C.drop(was)
            was = at
    return at
