"""Exact substring dedup over sharded suffix arrays (operator 1).

A byte goes if it lies in a SPAN-byte string that also starts in a document with a smaller doc_id.  Every string of SPAN
bytes has one minimizer: the gram of GRAM bytes or more in it whose hash is least.  Equal strings have equal minimizers, so the strings
of one minimizer are a shard of their own, and a maximal run of strings with the same minimizer occurrence is carried as
one segment of at most SPAN + STRINGS - 1 bytes.

1. Blocks of documents are written once.  Each sends the minimizer hashes of its documents, by hash range; the receivers
   answer with a bit for each hash that more than one document has.
2. Each block sends its segments around those minimizers, equal ones once with their smallest doc_id.  A receiver merges
   equal segments of all blocks, sorts the suffixes of the others in memory by induced sorting with common-prefix values
   (:mod:`induce`; a minimizer is not split, however many segments it has), takes the smallest doc_id of each group of SPAN-byte prefixes, and answers with a bit for each string.
3. Each block removes the bytes.  Nothing but bits comes back, so hot passages cost a block one segment.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .induce import suffix_array

U64 = np.uint64
GRAM = 20
STRINGS = 32  # strings of a segment, a bit each
SHARD = 1 << 18  # bytes of segments that are sorted together; a minimizer with more has a shard of its own
BLOCK = 1 << 20  # bytes of text in a block (one longer document is a block of its own)
NEVER = np.iinfo(np.int64).min


def gram(span: int) -> int:
    """Bytes of a minimizer's gram: so many that at most STRINGS strings of a document can share one."""
    if span < 1:
        raise ValueError("a span has a byte at least")
    return max(min(GRAM, span), span - STRINGS + 1)


def _gram_hash(buf: np.ndarray, k: int) -> np.ndarray:
    pw, inv = C.powers(len(buf) + 1)
    c = np.zeros(len(buf) + 1, U64)
    np.cumsum(C._BYTE[buf] * pw[: len(buf)], out=c[1:])
    return C.mix((c[k:] - c[:-k]) * inv[: len(buf) - k + 1])


class Segments:
    """Minimizers of a block's documents and the runs of strings that each of them holds."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray, span: int):
        self.buf, self.offs, self.span = buf, offs, span
        n = np.diff(offs)
        z = np.zeros(0, np.int64)
        self.doc = self.first = self.last = self.hash = z
        if len(buf) < span:
            self.hash = z.view(U64)
            return
        k = gram(span)
        g = _gram_hash(buf, k)
        low = np.uint64((1 << 28) - 1)
        if len(buf) > int(low):
            raise ValueError("a block holds at most 256 MB of text")
        place = low - np.arange(len(g), dtype=U64)  # of equal hashes the rightmost wins
        least = C.sliding_min((g & ~low) | place, span - k + 1)
        at = (low - (least & low)).astype(np.int64)  # minimizer of the string from each position
        doc = np.repeat(np.arange(len(n)), n)[: len(at)]
        inside = np.arange(len(at)) + span <= offs[1:][doc]
        p = np.flatnonzero(inside)
        if not len(p):
            self.hash = z.view(U64)
            return
        m = at[p]
        new = np.ones(len(p), bool)
        new[1:] = (m[1:] != m[:-1]) | (p[1:] != p[:-1] + 1)
        i = np.flatnonzero(new)
        self.first = p[i]
        self.last = p[np.append(i[1:], len(p)) - 1]  # the last string's start
        self.hash = C.mix(g[m[i]] ^ U64(0x5851F42D4C957F2D))  # least hashes lie low; mixed anew they fill all parts alike
        self.doc = doc[self.first]

    def keep(self, which: np.ndarray) -> None:
        self.doc, self.first, self.last, self.hash = (x[which] for x in (self.doc, self.first, self.last, self.hash))

    def distinct(self):
        """(order, start of each distinct segment in it): segments sorted by minimizer and content."""
        pw, inv = C.powers(len(self.buf) + 1)
        c = np.zeros(len(self.buf) + 1, U64)
        np.cumsum(C._BYTE[self.buf] * pw[: len(self.buf)], out=c[1:])
        e = self.last + self.span
        h = C.mix((c[e] - c[self.first]) * inv[self.first] + (e - self.first).astype(U64))
        o = np.lexsort((h, self.hash))
        a, b = self.hash[o], h[o]
        return o, np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(o) else o


def _by_part(hashes: np.ndarray, parts: int) -> list[tuple[int, int, int]]:
    """Runs of sorted hashes by part."""
    p = ((hashes >> U64(32)) * U64(parts) >> U64(32)).astype(np.int64)
    i = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]])) if len(p) else p
    return list(zip(p[i].tolist(), i.tolist(), [*i[1:].tolist(), len(p)]))


def _gather(buf: np.ndarray, a: np.ndarray, e: np.ndarray) -> np.ndarray:
    size = e - a
    ends = np.cumsum(size)
    return buf[np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - size, size) + np.repeat(a, size)]


def _unblock(row: dict):
    import zstandard

    text = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["text"], max_output_size=1 << 31), np.uint8) if row["text"] else np.zeros(0, np.uint8)
    return text, np.frombuffer(row["offs"], np.int64), np.frombuffer(row["docs"], np.int64)


def strings_seen_before(text: np.ndarray, sizes: np.ndarray, owner: np.ndarray, span: int):
    """For each string of each segment the smallest owner of an equal string, from the suffix array of all segments."""
    ends = np.cumsum(sizes + 1)
    starts = ends - sizes - 1
    t = np.ones(int(ends[-1]) + 1, np.int64)  # 1 between segments, 0 at the end
    t[-1] = 0
    where = np.arange(len(text)) + np.repeat(np.arange(len(sizes)), sizes)
    t[where] = text.astype(np.int64) + 2
    used = np.flatnonzero(np.bincount(t, minlength=258))
    small = np.zeros(258, np.int64)
    small[used] = np.arange(len(used))
    sa, lcp = suffix_array(small[t], span)
    seg = np.repeat(np.arange(len(sizes)), sizes + 1)
    seg = np.append(seg, -1)
    full = np.zeros(len(t), bool)
    full[:-1] = np.arange(len(t) - 1) + span <= (starts + sizes)[seg[:-1]]
    group = np.cumsum(lcp < span) - 1
    ok = full[sa]
    pos, group = sa[ok], group[ok]
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    least = np.minimum.reduceat(owner[seg[pos]], first)
    out = np.zeros(len(t), np.int64)
    out[pos] = np.repeat(least, np.diff(np.append(first, len(pos))))
    return out[full]


def remove_repeats(docs: DataFrame, span: int = 50, text_out: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row of ``docs(doc_id, text)``; with ``text_out`` also the
    text that is left (an UTF-8 character that lost some of its bytes goes whole) and the other columns of ``docs``.

    A null text is empty.  Rows with equal doc_id don't remove from each other.  A row with a null doc_id removes nothing
    and loses nothing.
    """
    spark = docs.sparkSession
    other = [c for c in docs.columns if c not in ("doc_id", "text")] if text_out else []
    packed = docs.select("doc_id", "text", F.to_json(F.struct(*other)).alias("rest") if other else F.lit(None).cast("string").alias("rest"))

    def block(batches):
        import zstandard
        from pyspark import TaskContext

        z, part, seq = zstandard.ZstdCompressor(level=3), TaskContext.get().partitionId(), 0
        for b in C.pieces(batches, size=BLOCK):
            buf, offs = C.text_buffer(b.column(1))
            ids = b.column(0).cast(pa.int64()).fill_null(NEVER)
            rest = b.column(2).to_pylist() if other else []
            yield pa.RecordBatch.from_arrays([pa.array([part << 32 | seq]), pa.array([ids.to_numpy().tobytes()], pa.binary()), pa.array([offs.tobytes()], pa.binary()), pa.array([z.compress(buf.tobytes())], pa.binary()), pa.array([rest], pa.list_(pa.string()))], ["gid", "docs", "offs", "text", "rest"])
            seq += 1

    blocks = C.save(packed.mapInArrow(block, "gid long, docs binary, offs binary, text binary, rest array<string>"), "op1-blocks")
    total = blocks.agg(F.coalesce(F.sum(F.expr("length(docs) + length(offs) + length(text)")), F.lit(0))).first()[0]
    parts = C.parts_for(3 * total, spark, 3 << 20)

    def ask(batches):
        for row in C.rows_of(batches):
            buf, offs, docs_ = _unblock(row)
            s = Segments(buf, offs, span)
            s.keep(docs_[s.doc] != NEVER)
            # a hash counts as several if two doc_ids of the block have it
            o = np.lexsort((docs_[s.doc], s.hash))
            h, d = s.hash[o], docs_[s.doc][o]
            if not len(h):
                continue
            i = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            j = np.append(i[1:], len(h)) - 1
            several, h = d[i] != d[j], h[i]
            runs = _by_part(h, parts)
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in runs], pa.int32()), pa.array([row["gid"]] * len(runs)), pa.array([h[x:y].tobytes() for _, x, y in runs], pa.binary()), pa.array([np.packbits(several[x:y]).tobytes() for _, x, y in runs], pa.binary())], ["part", "gid", "hashes", "several"])

    def answer(t: pa.Table) -> pa.Table:
        h = [np.frombuffer(x, U64) for x in t.column("hashes").to_pylist()]
        n = [len(x) for x in h]
        several = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=k) for x, k in zip(t.column("several").to_pylist(), n)])
        every = np.concatenate(h)
        o = np.argsort(every, kind="stable")
        e = every[o]
        i = np.flatnonzero(np.concatenate([[True], e[1:] != e[:-1]]))
        size = np.diff(np.append(i, len(e)))
        shared = np.maximum.reduceat(several[o], i) | (size > 1)
        bits = np.empty(len(e), np.uint8)
        bits[o] = np.repeat(shared, size)
        cut = np.concatenate([[0], np.cumsum(n)])
        return pa.table({"gid": t.column("gid"), "part": t.column("part"), "kind": pa.array([0] * len(n), pa.int32()), "bits": pa.array([np.packbits(bits[x:y]).tobytes() for x, y in zip(cut, cut[1:])], pa.binary())})

    note = "gid long, part int, kind int, bits binary"
    with C.batches_of(spark, 4):
        masks = C.save(blocks.select("gid", "docs", "offs", "text").mapInArrow(ask, "part int, gid long, hashes binary, several binary").groupBy("part").applyInArrow(answer, note), "op1-masks")
    C.release(spark)

    def marked(row: dict, notes: dict) -> tuple[Segments, np.ndarray]:
        """The block's segments around shared minimizers."""
        buf, offs, docs_ = _unblock(row)
        s = Segments(buf, offs, span)
        s.keep(docs_[s.doc] != NEVER)
        h, which = np.unique(s.hash, return_inverse=True)
        shared = np.zeros(len(h), bool)
        for part, x, y in _by_part(h, parts):
            shared[x:y] = np.unpackbits(np.frombuffer(notes[part], np.uint8), count=y - x)
        s.keep(shared[which])
        return s, docs_

    def send(batches):
        import zstandard

        z = zstandard.ZstdCompressor(level=3)
        for row in C.rows_of(batches):
            s, docs_ = marked(row, {x["part"]: x["bits"] for x in row["notes"] or ()})
            o, i = s.distinct()
            if not len(i):
                continue
            least = np.minimum.reduceat(docs_[s.doc][o], i)
            one = o[i]
            h, a, e = s.hash[one], s.first[one], s.last[one] + span
            runs = _by_part(h, parts)
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in runs], pa.int32()), pa.array([row["gid"]] * len(runs)), pa.array([h[x:y].tobytes() for _, x, y in runs], pa.binary()), pa.array([(e - a)[x:y].astype(np.uint32).tobytes() for _, x, y in runs], pa.binary()), pa.array([least[x:y].tobytes() for _, x, y in runs], pa.binary()), pa.array([z.compress(_gather(s.buf, a[x:y], e[x:y]).tobytes()) for _, x, y in runs], pa.binary())], ["part", "gid", "hashes", "sizes", "least", "text"])

    def sort_shards(t: pa.Table) -> pa.Table:
        import zstandard

        z = zstandard.ZstdDecompressor()
        h = [np.frombuffer(x, U64) for x in t.column("hashes").to_pylist()]
        n = [len(x) for x in h]
        every = np.concatenate(h)
        size = np.concatenate([np.frombuffer(x, np.uint32) for x in t.column("sizes").to_pylist()]).astype(np.int64)
        mine = np.concatenate([np.frombuffer(x, np.int64) for x in t.column("least").to_pylist()])
        texts = [np.frombuffer(z.decompress(x.as_py(), max_output_size=1 << 31), np.uint8) for x in t.column("text")]
        cut, same = np.concatenate([[0], np.cumsum(n)]), []
        for x, i, j in zip(texts, cut, cut[1:]):
            e = np.cumsum(size[i:j])
            same.append(C.span_hash(x, e - size[i:j], e, lower=False))
        text, same = np.concatenate(texts), np.concatenate(same)
        end = np.cumsum(size)
        start = end - size
        o = np.lexsort((same, every))
        a, b = every[o], same[o]
        i = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
        kind = np.repeat(np.arange(len(i)), np.diff(np.append(i, len(o))))
        which = np.empty(len(o), np.int64)
        which[o] = kind
        one, owner = o[i], np.minimum.reduceat(mine[o], i)
        # a minimizer with one segment has no string in any other: only those with several are sorted, in shards of whole ones
        string = np.concatenate([[0], np.cumsum(size[one] - span + 1)])
        seen = np.repeat(owner, size[one] - span + 1)
        key = every[one]
        again = np.zeros(len(key), bool)
        again[1:] = key[1:] == key[:-1]
        again[:-1] |= again[1:]
        rows = np.flatnonzero(again)
        total, key = np.cumsum(size[one][rows] + 1), key[rows]
        lo = 0
        while lo < len(rows):
            hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + SHARD)))
            back = int(np.searchsorted(key, key[hi - 1], "left"))
            hi = int(np.searchsorted(key, key[hi - 1], "right")) if back <= lo else back if hi < len(rows) else hi
            part = rows[lo:hi]
            w = one[part]
            m = size[w] - span + 1
            at = np.repeat(string[part] - np.cumsum(m) + m, m) + np.arange(int(m.sum()))
            seen[at] = strings_seen_before(_gather(text, start[w], end[w]), size[w], owner[part], span)
            lo = hi
        # one word of bits for each segment that came: which of its strings a smaller doc_id has
        m = size - span + 1
        at = np.repeat(string[which], m) + np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m)
        before = (seen[at] < np.repeat(mine, m)).astype(U64) << (np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m)).astype(U64)
        word = np.add.reduceat(before, np.cumsum(m) - m)
        return pa.table({"gid": t.column("gid"), "part": t.column("part"), "kind": pa.array([1] * len(n), pa.int32()), "bits": pa.array([word[x:y].astype("<u4").tobytes() for x, y in zip(cut, cut[1:])], pa.binary())})

    notes = masks.groupBy("gid").agg(F.collect_list(F.struct("part", "bits")).alias("notes"))
    with C.batches_of(spark, 4):
        verdicts = C.save(blocks.select("gid", "docs", "offs", "text").join(notes, "gid", "left").mapInArrow(send, "part int, gid long, hashes binary, sizes binary, least binary, text binary").groupBy("part").applyInArrow(sort_shards, note), "op1-verdicts")
    C.release(spark)

    def cut_out(batches):
        for row in C.rows_of(batches):
            got = row["notes"] or ()
            s, docs_ = marked(row, {x["part"]: x["bits"] for x in got if x["kind"] == 0})
            buf, offs = s.buf, s.offs
            gone = np.zeros(len(buf) + 1, np.int64)
            o, i = s.distinct()
            if len(i):
                word = np.zeros(len(i), U64)
                words_of = {x["part"]: x["bits"] for x in got if x["kind"] == 1}
                for part, x, y in _by_part(s.hash[o[i]], parts):
                    word[x:y] = np.frombuffer(words_of[part], "<u4")
                size = np.diff(np.append(i, len(o)))
                d = docs_[s.doc][o]
                least = np.repeat(np.minimum.reduceat(d, i), size)
                word = np.where(d > least, U64(0xFFFFFFFF), np.repeat(word, size))
                first, m = s.first[o], s.last[o] - s.first[o] + 1
                for j in range(span - gram(span) + 1):
                    hit = first[(m > j) & (word >> U64(j) & U64(1) == 1)] + j
                    np.add.at(gone, hit, 1)
                    np.add.at(gone, hit + span, -1)
            cover = np.cumsum(gone)[:-1] > 0
            left = buf[~cover]
            cum = np.concatenate([[0], np.cumsum(cover)])
            removed = cum[offs[1:]] - cum[offs[:-1]]
            begin = cover.copy()
            begin[1:] &= ~cover[:-1]
            inner = offs[:-1][np.diff(offs) > 0]
            begin[inner] = cover[inner]  # runs end with their document
            runs = np.concatenate([[0], np.cumsum(begin)])
            n = np.diff(offs)
            keep_at = np.concatenate([[0], np.cumsum(n - removed)])
            kept = [left[x:y].tobytes() for x, y in zip(keep_at, keep_at[1:])]
            cols = [pa.array(docs_, pa.int64(), mask=docs_ == NEVER), pa.array(n), pa.array(removed), pa.array(runs[offs[1:]] - runs[offs[:-1]]), pa.array([hashlib.sha256(x).hexdigest() for x in kept])]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if text_out:
                cols += [pa.array([x.decode(errors="ignore") for x in kept]), pa.array(row["rest"] if other else [None] * len(kept), pa.string())]
                names += ["text", "rest"]
            yield pa.RecordBatch.from_arrays(cols, names)

    both = masks.unionByName(verdicts).groupBy("gid").agg(F.collect_list(F.struct("kind", "part", "bits")).alias("notes"))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", text string, rest string" if text_out else "")
    with C.batches_of(spark, 4):
        out = C.save(blocks.join(both, "gid", "left").mapInArrow(cut_out, schema), "op1-result")
    C.drop(blocks, masks, verdicts)
    if not text_out:
        return out
    if other:
        rest = F.from_json("rest", docs.select(*other).schema)
        out = out.withColumn("rest", rest).select("*", *[F.col("rest")[c].alias(c) for c in other if c not in ("n_bytes", "n_removed", "n_spans", "kept_sha256")])
    return out.drop("rest")
