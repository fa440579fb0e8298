"""SentencePiece encoding and decoding by a weighted finite-state transducer (operator 8).

The model file is compiled to three transducers: the normaliser (white space to the meta symbol, a meta symbol in front),
the pieces, and the byte fallback of characters that no piece has.  Their composition with an input is a lattice whose
states are places in the input; its shortest path in the tropical semiring is the encoding.

* Unigram models: an arc weighs the piece's negated log probability.
* BPE models: a path is legal if no adjacent pair of its pieces would have been merged differently, which is what merging
  by rank leaves; other continuations weigh infinity.  The shortest path to each place is then the encoding of that
  prefix, and its last piece is all that the next arc has to know.

No piece spans certain byte pairs (a letter and the space after it, say), so the shortest path passes between them, and an
input is composed span by span; each distinct span is composed once and kept.
"""

from __future__ import annotations

import functools
import math
import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from . import common as C

META = "▁"
NORMAL, UNKNOWN, CONTROL, USER, BYTE = 1, 2, 3, 4, 6


def _fields(b: bytes):
    """(field, value) pairs of a protocol buffer message."""
    i = 0

    def varint():
        nonlocal i
        x = shift = 0
        while True:
            c = b[i]
            i += 1
            x |= (c & 127) << shift
            shift += 7
            if c < 128:
                return x

    while i < len(b):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind == 2:
            n = varint()
            yield tag >> 3, b[i : i + n]
            i += n
        else:
            n = 4 if kind == 5 else 8
            yield tag >> 3, struct.unpack("<f" if kind == 5 else "<d", b[i : i + n])[0]
            i += n


class Transducer:
    KEPT = 400_000

    def __init__(self, model: bytes):
        top = list(_fields(model))
        pieces = [dict(_fields(v)) for f, v in top if f == 1]
        trainer = dict(x for f, v in top if f == 2 for x in _fields(v))
        norm = dict(x for f, v in top if f == 3 for x in _fields(v))
        if norm.get(2) or norm.get(4, 1):
            raise ValueError("only the identity normaliser without removal of white space is compiled")
        self.bpe, self.prefix = trainer.get(3, 1) == 2, bool(norm.get(3, 1))
        self.text = [p[1].decode() for p in pieces]
        kind = [p.get(3, NORMAL) for p in pieces]
        self.weight = {}
        self.bytes = {}
        self.unknown = kind.index(UNKNOWN)
        for i, (t, k) in enumerate(zip(self.text, kind)):
            if k == NORMAL:
                self.weight[t] = -pieces[i].get(2, 0.0)
            elif k == BYTE:
                self.bytes[int(t[3:5], 16)] = i
            elif k == USER:
                raise ValueError("user-defined pieces are not compiled")
        self.id = {t: i for i, (t, k) in enumerate(zip(self.text, kind)) if k == NORMAL}
        self.longest = max(map(len, self.id))
        self.single = {t for t in self.id if len(t) == 1}
        # byte pairs that some piece spans; a span of the input ends between any others
        self.joined = np.zeros((256, 256), bool)
        for t in self.id:
            b = np.frombuffer(t.replace(META, " ").encode(), np.uint8)
            self.joined[b[:-1], b[1:]] = True
        out = [(t.replace(META, " ").encode() if k in (NORMAL, USER) else bytes([int(t[3:5], 16)]) if k == BYTE else " ⁇ ".encode() if k == UNKNOWN else b"") for t, k in zip(self.text, kind)]
        self.out_len = np.array([len(x) for x in out], np.int64)
        self.out_at = np.cumsum(self.out_len) - self.out_len
        self.out = np.frombuffer(b"".join(out), np.uint8)
        self.is_byte = np.array([k == BYTE for k in kind])
        self.kept: dict[bytes, bytes] = {}
        self.legal: dict[tuple[str, str], bool] = {}

    # ------------------------------------------------------------ BPE pairs

    def merged(self, s: str) -> list[str]:
        """What merging by rank leaves of a short string."""
        parts, w = list(s), self.weight
        while len(parts) > 1:
            best, at = math.inf, -1
            for i in range(len(parts) - 1):
                x = w.get(parts[i] + parts[i + 1])
                if x is not None and x < best:
                    best, at = x, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def pair(self, a: str, b: str) -> bool:
        got = self.legal.get((a, b))
        if got is None:
            if len(self.legal) > 1_000_000:
                self.legal.clear()
            got = self.legal[a, b] = a + b not in self.weight and self.merged(a + b) == [a, b]
        return got

    # ------------------------------------------------------------ composition

    def shortest(self, s: str) -> list[str]:
        """Output labels of the shortest path of a span; a character without a piece stands for itself."""
        n, w = len(s), self.weight
        cost = [0.0] + [math.inf] * n
        back: list[str | None] = [None] * (n + 1)
        for e in range(1, n + 1):
            for a in range(max(0, e - self.longest), e):
                if cost[a] == math.inf:
                    continue
                t = s[a:e]
                x = w.get(t)
                if x is None:
                    if e - a > 1 or t in self.single:
                        continue
                    x = 1e6  # the fallback's arc
                if self.bpe:
                    if a and not self.pair(back[a], t):
                        continue
                    x = 1.0
                if cost[a] + x < cost[e]:
                    cost[e], back[e] = cost[a] + x, t
        path, e = [], n
        while e > 0:
            if back[e] is None:
                return self.merged(s)
            path.append(back[e])
            e -= len(back[e])
        return path[::-1]

    def compose(self, span: bytes) -> bytes:
        """Ids of a span of normalised input, as little-endian u32."""
        ids = []
        for t in self.shortest(span.decode().replace(" ", META)):
            i = self.id.get(t)
            if i is not None:
                ids.append(i)
            elif self.bytes:
                ids += [self.bytes[x] for x in t.replace(META, " ").encode()]
            else:
                ids.append(self.unknown)
        return np.array(ids, "<u4").tobytes()

    def encode(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """(all ids, ids of each row, normalised rows) of a text column."""
        col = col.cast(pa.large_string()).fill_null("")
        if pc.any(pc.match_substring(col, META)).as_py():
            col = pc.replace_substring(col, META, " ")
        if self.prefix:
            col = pc.if_else(pc.equal(pc.binary_length(col), 0), col, pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), col, pa.scalar("", pa.large_string())))
        buf, offs = C.text_buffer(col)
        rows, n = len(offs) - 1, len(buf)
        if not n:
            return np.zeros(0, "<u4"), np.zeros(rows, np.int64), col
        start = np.ones(n, bool)
        start[1:] = ~self.joined[buf[:-1], buf[1:]] & ((buf[1:] & 0xC0) != 0x80)
        start[offs[:-1][np.diff(offs) > 0]] = True
        s = np.flatnonzero(start)
        e = np.append(s[1:], n)
        _, at, which = np.unique(C.span_hash(buf, s, e, lower=False), return_index=True, return_inverse=True)
        data, kept = buf.tobytes(), self.kept
        if len(kept) > self.KEPT:
            kept.clear()
        ids = []
        for i, j in zip(s[at].tolist(), e[at].tolist()):
            x = data[i:j]
            got = kept.get(x)
            if got is None:
                got = kept[x] = self.compose(x)
            ids.append(got)
        size = np.array([len(x) for x in ids], np.int64) // 4
        flat = np.frombuffer(b"".join(ids), "<u4")
        lens, first = size[which], (np.cumsum(size) - size)[which]
        ends = np.cumsum(lens)
        out = flat[np.arange(int(ends[-1])) + np.repeat(first - ends + lens, lens)]
        cut = np.concatenate([[0], ends])[np.searchsorted(s, offs)]
        return out, np.diff(cut), col

    def decode(self, ids: np.ndarray, lens: np.ndarray) -> list[bytes]:
        """Bytes of each row of ids, without the meta symbol in front."""
        size = self.out_len[ids]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        raw = self.out[np.arange(total) + np.repeat(self.out_at[ids] - ends + size, size)].tobytes()
        cut = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(lens)])].tolist()
        skip = int(self.prefix)
        return [raw[i + skip if j > i and raw[i] == 32 else i : j] for i, j in zip(cut, cut[1:])]


@functools.lru_cache(maxsize=2)
def load(path: str) -> Transducer:
    with open(path, "rb") as f:
        return Transducer(f.read())


C.HELD["wfst"] = load.cache_clear

OUTPUTS = "n_ids long, n_fallback long, ids_crc32 long, round_trip boolean, ids array<int>, decoded string"


def transduce(docs: DataFrame, model: str, outputs: tuple[str, ...] = ("ids",), keep_text: bool = False) -> DataFrame:
    """The columns of ``docs`` but its text (unless ``keep_text``), and of each text the ``outputs`` asked for: ``ids``,
    ``decoded`` (the text that the ids stand for), ``n_ids``, ``n_fallback`` (ids of single bytes), ``ids_crc32`` (of the
    ids as little-endian unsigned 32-bit integers) and ``round_trip`` (decoding gives the normalised text).

    Null and empty texts have no ids.  Output columns replace columns of the same name.  The model is a file at the same
    path on every executor.
    """
    fields = {f.name: f for f in StructType.fromDDL(OUTPUTS)}
    carried = [c for c in docs.columns if c not in outputs and (keep_text or c != "text")]
    schema = StructType([*docs.select(*carried).schema, *(fields[c] for c in outputs)])
    source = docs.select(*dict.fromkeys([*carried, "text"]))

    def run(batches):
        C.serve("wfst")
        t = load(model)
        for b in C.pieces(batches, "text", 1 << 20, "wfst"):
            ids, lens, norm = t.encode(b.column("text"))
            cut = np.concatenate([[0], np.cumsum(lens)])
            made = {"n_ids": lambda: pa.array(lens, pa.int64())}
            made["ids"] = lambda: pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(ids.astype(np.int32)))
            if "n_fallback" in outputs:
                total = np.concatenate([[0], np.cumsum(t.is_byte[ids])])[cut]
                made["n_fallback"] = lambda: pa.array(np.diff(total), pa.int64())
            if "ids_crc32" in outputs:
                view = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(view[4 * i : 4 * j]) for i, j in zip(cut.tolist(), cut[1:].tolist())]
                made["ids_crc32"] = lambda: pa.array(crc, pa.int64())
            if {"decoded", "round_trip"} & {*outputs}:
                text = t.decode(ids, lens)
                made["decoded"] = lambda: pa.array([x.decode(errors="replace") for x in text], pa.string())
                buf, offs = C.text_buffer(norm)
                raw, skip = buf.tobytes(), int(t.prefix)
                made["round_trip"] = lambda: pa.array([x == raw[i + skip : j] for x, i, j in zip(text, offs.tolist(), offs[1:].tolist())])
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in carried), *(made[c]() for c in outputs)], [*carried, *outputs])

    return source.mapInArrow(run, schema)


def decode(coded: DataFrame, model: str) -> DataFrame:
    """``coded`` with its ``ids`` decoded to a text column; null ids give an empty text."""
    carried = [c for c in coded.columns if c != "text"]
    schema = StructType([*coded.select(*carried).schema, *StructType.fromDDL("text string")])

    def run(batches):
        t = load(model)
        for b in batches:
            rows = b.column("ids").to_pylist()
            lens = np.array([len(x or ()) for x in rows], np.int64)
            ids = np.fromiter((i for x in rows for i in x or ()), np.int64, int(lens.sum()))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in carried), pa.array([x.decode(errors="replace") for x in t.decode(ids, lens)])], [*carried, "text"])

    return coded.select(*carried).mapInArrow(run, schema)
