"""Simple-8b word-aligned coding of token ids (operator 5).

File image, all little-endian: ``S8B1``, u32 documents, u32 blocks, u64 ids, i64 document ids, u64 ids of each document,
u32 first word of each block (and the end), u64 words.  A block holds BLOCK ids (the last one fewer) and starts on a word
boundary, so blocks are packed and unpacked side by side.  The top four bits of a word select how many ids of how many
bits the other sixty hold; selector 0 escapes: the next word is one id of up to 64 bits.
"""

from __future__ import annotations

import functools
import json
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

U64 = np.uint64
BLOCK = 128
COUNTS = np.array([1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1, 1], np.int64)
WIDTHS = np.array([64, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60, 60], np.int64)
_PACKING = range(1, 15)  # selector 15 is spare
_NARROW = np.searchsorted(2 ** WIDTHS[1:15], np.arange(1 << 17), "right").astype(np.uint8)  # widths that are too narrow for an id


def encode(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words and the first word of each block (plus the end)."""
    ids = ids.astype(U64)
    n = len(ids)
    nb = -(-n // BLOCK)
    if not n:
        return np.zeros(0, U64), np.zeros(1, np.uint32)
    bits = np.full(nb * BLOCK, 255, np.uint8)
    if ids.max() < len(_NARROW):
        bits[:n] = _NARROW[ids]
    else:
        bits[:n] = 0
        for w in WIDTHS[1:15]:
            bits[:n] += ids >> U64(w) > 0
    # bits now counts the packing widths that are too narrow; 14 means none fits
    best = np.zeros((nb, BLOCK), np.uint8)
    runs = {1: bits}
    for s in reversed(_PACKING):
        k = int(COUNTS[s])
        # the widest value among the next k
        have, top = max(x for x in runs if x <= k), None
        top = runs[have]
        while have < k:
            step = min(have, k - have)
            shifted = np.full_like(top, 255)
            shifted[:-step] = top[step:]
            top = np.maximum(top, shifted)
            have += step
        runs[k] = top
        room = BLOCK - k + 1  # a word holds ids of one block
        np.copyto(best[:, :room], s, where=(top <= s - 1).reshape(nb, BLOCK)[:, :room])
    best = best.ravel()
    # where each word begins and its selector: one word of each block at a time
    at = np.arange(nb) * BLOCK
    end = np.minimum(at + BLOCK, n)
    used = np.zeros(nb, np.int64)
    blk, begin, slot = [], [], []
    live = np.arange(nb)
    while len(live):
        p = at[live]
        s = best[p]
        blk.append(live)
        begin.append(p)
        slot.append(used[live])
        used[live] += np.where(s == 0, 2, 1)  # an escaped id has a word of its own
        at[live] = p = p + COUNTS[s]
        live = live[p < end[live]]
    first = np.zeros(nb + 1, np.uint32)
    np.cumsum(used, out=first[1:])
    begin = np.concatenate(begin)
    to = first[np.concatenate(blk)].astype(np.int64) + np.concatenate(slot)
    padded = np.concatenate([ids, np.zeros(BLOCK, U64)])
    out = np.empty(int(first[-1]), U64)
    sel = best[begin]
    for s in np.flatnonzero(np.bincount(sel, minlength=16)):
        rows = np.flatnonzero(sel == s)
        p = begin[rows]
        if s == 0:
            out[to[rows]] = 0
            out[to[rows] + 1] = padded[p]
            continue
        w = int(WIDTHS[s])
        acc = np.full(len(rows), int(s) << 60, U64)
        for j in range(int(COUNTS[s])):
            acc |= padded[p + j] << U64(j * w)
        out[to[rows]] = acc
    return out, first


def decode(words: np.ndarray, first: np.ndarray, n: int) -> np.ndarray:
    """All ids; ``first`` says where each block's words begin and so where its ids go, and the blocks are unpacked together."""
    blocks = len(first) - 1
    if not n:
        return np.zeros(0, U64)
    lo = first[:-1].astype(np.int64)
    n_words = first[1:].astype(np.int64) - lo
    sel = (words >> U64(60)).astype(np.int64)
    raw = np.zeros(len(words), bool)
    if (sel == 0).any():
        # which words are escaped ids is settled for all blocks side by side: one word of each block at a time
        zeros = np.add.reduceat(sel == 0, lo)
        live = np.flatnonzero(zeros)
        skip = np.zeros(len(live), bool)
        for j in range(int(n_words[live].max())):
            inside = j < n_words[live]
            live, skip = live[inside], skip[inside]
            at = lo[live] + j
            raw[at] = skip
            skip = ~skip & (sel[at] == 0)
    count = np.where(raw, 0, COUNTS[sel])
    run = np.cumsum(count) - count
    block = np.repeat(np.arange(blocks), n_words)
    start = run - run[lo][block] + block * BLOCK
    out = np.zeros(n, U64)
    for s in np.unique(sel[~raw]):
        rows = np.flatnonzero((sel == s) & ~raw)
        if s == 0:
            out[start[rows]] = words[rows + 1]
            continue
        w = int(WIDTHS[s])
        mask = U64((1 << w) - 1)
        for j in range(int(COUNTS[s])):
            out[start[rows] + j] = (words[rows] >> U64(j * w)) & mask
    return out


def decode_block(words: np.ndarray, first: np.ndarray, n: int, block: int) -> np.ndarray:
    """The ids of one block alone; no other block's words are read."""
    size = min(BLOCK, n - block * BLOCK)
    return decode(words[first[block] : first[block + 1]], np.array([0, first[block + 1] - first[block]], np.uint32), size)


def pack_file(doc_ids: np.ndarray, lens: np.ndarray, ids: np.ndarray) -> bytes:
    words, first = encode(ids)
    head = b"S8B1" + np.array([len(doc_ids), len(first) - 1], "<u4").tobytes() + np.array([len(ids)], "<u8").tobytes()
    return head + doc_ids.astype("<i8").tobytes() + lens.astype("<u8").tobytes() + first.astype("<u4").tobytes() + words.astype("<u8").tobytes()


def unpack_file(image: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document ids, ids of each, all ids) of a file image."""
    if image[:4] != b"S8B1":
        raise ValueError("not a Simple-8b file image")
    nd, nb = np.frombuffer(image, "<u4", 2, 4)
    (n,) = np.frombuffer(image, "<u8", 1, 12)
    at = 20
    docs = np.frombuffer(image, "<i8", nd, at)
    lens = np.frombuffer(image, "<u8", nd, at + 8 * int(nd)).astype(np.int64)
    at += 16 * int(nd)
    first = np.frombuffer(image, "<u4", int(nb) + 1, at)
    words = np.frombuffer(image, "<u8", int(first[-1]), at + 4 * (int(nb) + 1))
    return docs, lens, decode(words, first, int(n))


# ---------------------------------------------------------------- tokenising


@functools.lru_cache(maxsize=2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _odd_rows(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Rows with any white space but single spaces and line feeds between words, or with text like an added token."""
    n = len(buf)
    bad = np.isin(buf, np.array([9, 11, 12, 13, 0x1C, 0x1D, 0x1E, 0x1F], np.uint8))
    sep = (buf == 32) | (buf == 10)
    bad[1:] |= sep[1:] & sep[:-1]
    bad[:-1] |= (buf[:-1] == ord("<")) & (buf[1:] == ord("|"))
    ends = offs[1:][np.diff(offs) > 0]
    starts = offs[:-1][np.diff(offs) > 0]
    bad[starts] |= sep[starts]
    bad[ends - 1] |= sep[ends - 1]
    for lead in (0xC2, 0xE1, 0xE2, 0xE3):  # white space beyond ASCII
        at = np.flatnonzero(buf == lead)
        b1, b2 = buf[np.minimum(at + 1, n - 1)], buf[np.minimum(at + 2, n - 1)]
        if lead == 0xC2:
            hit = (b1 == 0x85) | (b1 == 0xA0)
        elif lead == 0xE2:
            hit = (b1 == 0x80) & ((b2 <= 0x8A) | (b2 == 0xA8) | (b2 == 0xA9) | (b2 == 0xAF)) | (b1 == 0x81) & (b2 == 0x9F)
        else:
            hit = (b1 == (0x9A if lead == 0xE1 else 0x80)) & (b2 == 0x80)
        bad[at[hit]] = True
    at = np.searchsorted(np.flatnonzero(bad), offs)
    return at[1:] > at[:-1]


def _distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct values, the place of one occurrence of each, and which of them each place has."""
    coded = pa.array(h).dictionary_encode()
    which, values = coded.indices.to_numpy(), coded.dictionary.to_numpy()
    at = np.empty(len(values), np.int64)
    at[which] = np.arange(len(h))
    return values, at, which


_UNIT = np.ones(256, bool)
_UNIT[[10, 32]] = False
_LETTER = np.zeros(256, bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = True


#: the pre-tokeniser that the word-by-word path is made for (fixed values of the tokenizer file format)
BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}


class Encoder:
    """The library's ids of whole texts.

    With a byte-level pre-tokeniser a single space or line feed between other characters always starts a new pre-token, so
    a text is the concatenation of words that begin there; each distinct word is given to the library once and its ids are
    kept.  Words are told apart by a 64-bit hash; rows with a word of over LONG bytes, with any other white space, or with
    text that looks like an added token, go to the library whole, and so does every row where the tokenizer has a
    normaliser, another pre-tokeniser, or added tokens that are not of the form ``<|...|>``.
    """

    LIMIT = 2_000_000  # words that are kept; beyond that the half that is used least goes
    LONG = 255

    def __init__(self, path: str):
        self.tok = _tokenizer(path)
        spec = json.loads(self.tok.to_str())
        pre = spec.get("pre_tokenizer") or {}
        added = [t["content"] for t in spec.get("added_tokens") or ()]
        plain = spec.get("normalizer") is None and all(pre.get(k) == v for k, v in BYTE_LEVEL.items()) and all(t.startswith("<|") for t in added)
        feed = self.tok.encode("\n", add_special_tokens=False).ids
        marks = {m: self.tok.encode(m, add_special_tokens=False).ids for m in ",."}
        self.whole = not plain or len(feed) != 1 or any(len(x) != 1 for x in marks.values())
        if self.whole:
            return
        self.feed = feed[0]
        self.marks = np.zeros(256, np.int64)  # id of a last comma or full stop, a pre-token of its own after a letter
        for m, ids in marks.items():
            self.marks[ord(m)] = ids[0]
        vocab = self.tok.get_vocab()
        self.begins = np.zeros(max(vocab.values()) + 1, bool)  # ids that begin with a space
        self.begins[[i for t, i in vocab.items() if t.startswith("\u0120")]] = True
        self.known = np.zeros(0, U64)  # hashes of the words kept, with the uses, place and number of the ids of each
        self.uses = self.start = self.size = np.zeros(0, np.int64)
        self.flat = np.zeros(0, "<u4")

    def _each(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, hashes: np.ndarray, words: list[bytes]) -> None:
        """Keep the ids of new words, each with its space, if any."""
        place, size, ids = [], [], []
        spaced = [i for i, x in enumerate(words) if x[0] == 32]
        bare = [i for i, x in enumerate(words) if x[0] != 32]
        for lo in range(0, len(spaced), 4096):
            some = spaced[lo : lo + 4096]
            got = self._each([b"".join([words[i] for i in some]).decode()])[0]
            at = np.flatnonzero(self.begins[got])
            if len(at) == len(some):  # each word has one id that begins with a space, its first
                place.append(np.array(some))
                size.append(np.diff(np.append(at, len(got))))
                ids.append(got)
            else:
                bare += some
        if bare:
            each = self._each([words[i].decode() for i in bare])
            place.append(np.array(bare))
            size.append(np.array([len(x) for x in each]))
            ids += each
        size = np.concatenate(size)
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.known = np.concatenate([self.known, hashes[np.concatenate(place)]])
        self.uses = np.concatenate([self.uses, np.zeros(len(size), np.int64)])
        self.flat = np.concatenate([self.flat, *ids])

    def _forget(self) -> None:
        o = np.argsort(-self.uses, kind="stable")[: self.LIMIT // 2]
        size = self.size[o]
        ends = np.cumsum(size)
        self.flat = self.flat[np.arange(int(ends[-1])) + np.repeat(self.start[o] - ends + size, size)]
        self.known, self.uses, self.size, self.start = self.known[o], self.uses[o] >> 1, size, ends - size

    def _look_up(self, hashes: np.ndarray) -> np.ndarray:
        """Place of each hash among those known, or -1."""
        return pc.fill_null(pc.index_in(pa.array(hashes), value_set=pa.array(self.known)), -1).to_numpy()

    def batch(self, col: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the rows, each with the end id after it, and how many each row has."""
        if self.whole:
            each = [np.append(x, np.array([end], "<u4")) for x in self._each([x or "" for x in col.to_pylist()])]
            return np.concatenate([np.zeros(0, "<u4"), *each]), np.array([len(x) for x in each], np.int64)
        buf, offs = C.text_buffer(col)
        rows = len(offs) - 1
        odd = _odd_rows(buf, offs) if len(buf) else np.zeros(rows, bool)
        s, e, first = C.spans(buf, offs, _UNIT)
        row = np.repeat(np.arange(rows), np.diff(first))
        odd[row[e - s > self.LONG]] = True
        own = np.zeros(len(s), bool)
        own[first[:-1][np.diff(first) > 0]] = True
        before = np.where(own, 0, buf[s - 1]) if len(s) else np.zeros(0, np.uint8)
        space, feed = before == 32, before == 10
        if odd.any():
            use = ~odd[row]
            s, e, row, space, feed = s[use], e[use], row[use], space[use], feed[use]
        last = buf[e - 1]
        b1, b2 = buf[np.maximum(e - 2, 0)], buf[np.maximum(e - 3, 0)]
        letter = _LETTER[b1] | (b2 == 0xC3) & (b1 >= 0x80) & (b1 != 0x97) & (b1 != 0xB7)  # of ASCII and Latin-1
        mark = ((last == 44) | (last == 46)) & letter & (e - s > np.where(b1 >= 0x80, 2, 1))
        e = e - mark
        values, at, which = _distinct(C.span_hash(buf, s, e, lower=False) ^ C.mix(space.astype(np.uint64)))
        if len(self.known) > self.LIMIT:
            self._forget()
        found = self._look_up(values)
        new = np.flatnonzero(found < 0)
        if len(new):
            data, i = buf.tobytes(), at[new]
            self._learn(values[new], [data[x:y] for x, y in zip((s[i] - space[i]).tolist(), e[i].tolist())])
            found = self._look_up(values)
        self.uses += np.bincount(found, np.bincount(which, minlength=len(values)), len(self.known)).astype(np.int64)
        found = found[which]
        lens, start = self.size[found], self.start[found]
        whole = np.flatnonzero(odd)
        more = self._each([x or "" for x in col.take(pa.array(whole)).to_pylist()]) if len(whole) else []
        # a line feed id stands before the ids of the word after it, a mark's after them, the end id after the row's last
        took = np.concatenate([[0], np.cumsum(lens + feed + mark)])
        cut = took[np.searchsorted(row, np.arange(rows + 1))]
        per_row = np.diff(cut)
        per_row[whole] = [len(x) for x in more]
        per_row += 1
        row_end = np.cumsum(per_row)
        out = np.empty(int(row_end[-1]) if rows else 0, "<u4")
        out[row_end - 1] = end
        if len(s):
            to = (row_end - per_row - cut[:-1])[row] + took[:-1] + feed
            out[(to - 1)[feed]] = self.feed
            out[(to + lens)[mark]] = self.marks[last[mark]]
            ends = np.cumsum(lens)
            place = np.arange(int(ends[-1]))
            out[np.repeat(to - ends + lens, lens) + place] = self.flat[np.repeat(start - ends + lens, lens) + place]
        for r, x in zip(whole.tolist(), more):
            out[row_end[r] - per_row[r] : row_end[r] - 1] = x
        return out, per_row


_ENCODERS: dict[str, Encoder] = {}


def write_ids(docs: DataFrame, tokenizer: str, end_id: int = 2, ids_per_file: int = 1 << 20) -> DataFrame:
    """Encode ``docs(doc_id, text)`` in ascending doc_id order; returns the written table of file images.

    Null and empty texts have the end id alone.  Rows with the same doc_id each have their own place, in the order of
    their texts.  A null doc_id is kept as the smallest possible id.  Columns: part, seq, before (ids of the part's
    earlier files), n_ids, image.
    """
    spark = docs.sparkSession
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc_id"), "text")
    n = C.parts_for(docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0], spark)
    ranged = docs.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")

    def code(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from pyspark import TaskContext

        part, seq, before = TaskContext.get().partitionId(), 0, 0
        enc = _ENCODERS.setdefault(tokenizer, Encoder(tokenizer))
        doc, blob, size, have = [], [], [], 0

        def flush():
            ids = np.concatenate(blob)
            image = pack_file(np.concatenate(doc), np.concatenate(size), ids)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([before], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([image], pa.binary())], ["part", "seq", "before", "n_ids", "image"]), len(ids)

        for b in C.pieces(batches, "text", 8 << 20):
            ids, lens = enc.batch(b.column(1), end_id)
            doc.append(b.column(0).to_numpy())
            blob.append(ids)
            size.append(lens)
            have += len(ids)
            if have >= ids_per_file:
                row, k = flush()
                yield row
                seq, before, have = seq + 1, before + k, 0
                doc, blob, size = [], [], []
        if doc:
            yield flush()[0]

    return C.save(ranged.mapInArrow(code, "part int, seq int, before long, n_ids long, image binary"), "op5-files")


def read_ids(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and the first id) of each document, from the file images alone."""
    # one number for each shuffle partition comes to the driver, however many documents there are
    totals = sorted((r["part"], r["n"]) for r in files.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    offset, at = {}, 0
    for part, n in totals:
        offset[part] = at
        at += n

    def rows(batches):
        for b in batches:
            for part, before, image in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                docs, lens, ids = unpack_file(image.as_py())
                ids = ids.astype("<u4")
                ends = np.cumsum(lens)
                view = memoryview(ids.tobytes())
                crc = [zlib.crc32(view[4 * (e - k) : 4 * e]) for e, k in zip(ends.tolist(), lens.tolist())]
                null = docs == -(1 << 63)
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64(), mask=null), pa.array(ends - lens + offset[part] + before), pa.array(lens), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.select("part", "before", "image").mapInArrow(rows, "doc_id long, start long, n_tokens long, ids_crc32 long")
