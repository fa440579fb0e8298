"""BAM files as a Spark data source in pure Python, by the public SAM/BAM specification.

``spark.dataSource.register(BamDataSource)``, then ``spark.read.format("alnquant_bam").load(path)``.  A file is cut into
partitions at BGZF blocks, found from the blocks' own headers.  A partition takes the records that begin in its blocks: its
first record is found by testing each byte as the start of a chain of plausible records.  Sequences and qualities are
skipped, not decoded.
"""

from __future__ import annotations

import struct
import zlib

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "stream_id string, qname string, flag int, rid int, refname string, reflength int, pos int, mapq int, cigar string, rnext int, pnext int, tlen int, len_seq int, nm int, rg int, tags map<string,string>"
OPS = "MIDNSHP=X"
#: value codes of tags: struct format (fixed values)
NUMBERS = {"c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f"}


def _open(path: str):
    """A seekable binary file; paths with a scheme go through Arrow's file systems."""
    if "://" in path or path.startswith(("file:", "hdfs:")):
        from pyarrow import fs

        system, p = fs.FileSystem.from_uri(path)
        return system.open_input_file(p)
    return open(path, "rb")


def _list(path: str) -> list[str]:
    import glob
    import os

    if "://" in path or path.startswith(("file:", "hdfs:")):
        from pyarrow import fs

        system, p = fs.FileSystem.from_uri(path)
        info = system.get_file_info(p)
        if info.type == fs.FileType.Directory:
            scheme = path[: len(path) - len(p)] if path.endswith(p) else ""
            return sorted(scheme + f.path for f in system.get_file_info(fs.FileSelector(p)) if f.path.endswith(".bam"))
        return [path]
    if os.path.isdir(path):
        return sorted(glob.glob(os.path.join(path, "*.bam")))
    return sorted(glob.glob(path)) or [path]


def block_size(head: bytes) -> int:
    """Size of the BGZF block whose first 18 bytes or more are given."""
    if head[:4] != b"\x1f\x8b\x08\x04":
        raise ValueError("not a BGZF block")
    extra = struct.unpack_from("<H", head, 10)[0]
    at = 12
    while at < 12 + extra:
        a, b, n = struct.unpack_from("<BBH", head, at)
        if (a, b) == (66, 67):
            return struct.unpack_from("<H", head, at + 4)[0] + 1
        at += 4 + n
    raise ValueError("a BGZF block without its size")


def blocks(f, at: int, end: int | None = None):
    """(offset, contents) of the blocks that begin in [at, end)."""
    while end is None or at < end:
        f.seek(at)
        head = f.read(18)
        if len(head) < 18:
            return
        n = block_size(head)
        f.seek(at)
        raw = f.read(n)
        yield at, zlib.decompress(raw[12 + struct.unpack_from("<H", raw, 10)[0] : -8], -15)
        at += n


def header(f) -> tuple[str, list[tuple[str, int]], int]:
    """(header text, references, bytes of the decompressed stream before the first record)."""
    data = b""
    stream = blocks(f, 0)

    def need(n):
        nonlocal data
        while len(data) < n:
            data += next(stream)[1]

    need(8)
    if data[:4] != b"BAM\x01":
        raise ValueError("not a BAM file")
    n_text = struct.unpack_from("<i", data, 4)[0]
    need(12 + n_text)
    text, at = data[8 : 8 + n_text].rstrip(b"\0").decode(), 8 + n_text
    n_ref = struct.unpack_from("<i", data, at)[0]
    at, refs = at + 4, []
    for _ in range(n_ref):
        need(at + 4)
        k = struct.unpack_from("<i", data, at)[0]
        need(at + 8 + k)
        refs.append((data[at + 4 : at + 3 + k].decode(), struct.unpack_from("<i", data, at + 4 + k)[0]))
        at += 8 + k
    return text, refs, at


def tags(raw: bytes) -> dict[str, str]:
    out, at = {}, 0
    while at + 3 <= len(raw):
        name, kind = raw[at : at + 2].decode(), chr(raw[at + 2])
        at += 3
        if kind == "A":
            out[name], at = chr(raw[at]), at + 1
        elif kind in NUMBERS:
            form = "<" + NUMBERS[kind]
            out[name] = str(struct.unpack_from(form, raw, at)[0])
            at += struct.calcsize(form)
        elif kind in "ZH":
            end = raw.index(0, at)
            out[name], at = raw[at:end].decode(), end + 1
        elif kind == "B":
            sub, n = chr(raw[at]), struct.unpack_from("<I", raw, at + 1)[0]
            form = f"<{n}{NUMBERS[sub]}"
            out[name] = ",".join(map(str, struct.unpack_from(form, raw, at + 5)))
            at += 5 + struct.calcsize(form)
        else:
            raise ValueError(f"unknown tag type {kind}")
    return out


def _int(x: str | None) -> int | None:
    try:
        return int(x)
    except (TypeError, ValueError):
        return None


def record(raw: bytes, stream: str, refs: list[tuple[str, int]]) -> tuple:
    rid, pos, l_name, mapq, _, n_cigar, flag, l_seq, rnext, pnext, tlen = struct.unpack_from("<iiBBHHHiiii", raw)
    at = 32 + l_name
    cigar = struct.unpack_from(f"<{n_cigar}I", raw, at)
    t = tags(raw[at + 4 * n_cigar + (l_seq + 1) // 2 + l_seq :])
    name, length = refs[rid] if rid >= 0 else ("*", None)
    return (
        stream, raw[32 : 31 + l_name].decode(), flag, rid, name, length, pos, mapq,
        "".join(f"{c >> 4}{OPS[c & 15]}" for c in cigar) or "*", rnext, pnext, tlen, l_seq, _int(t.get("NM")), _int(t.get("RG")), t,
    )


def plausible(data: bytes, at: int, n_ref: int) -> int:
    """Size of the record at a place that could be one, or 0."""
    if at + 36 > len(data):
        return 0
    size, rid, pos, l_name, _, _, n_cigar, _, l_seq, rnext, pnext = struct.unpack_from("<iiiBBHHHiii", data, at)
    fixed = 32 + l_name + 4 * n_cigar + (l_seq + 1) // 2 + l_seq
    if not (32 <= fixed <= size < 1 << 26 and -1 <= rid < n_ref and -1 <= rnext < n_ref and pos >= -1 and pnext >= -1 and l_name > 1 and l_seq >= 0):
        return 0
    end = at + 36 + l_name - 1
    if end < len(data) and (data[end] != 0 or not all(33 <= c <= 126 for c in data[at + 36 : end])):
        return 0
    return size + 4


def find_start(data: bytes, n_ref: int, chain: int = 6) -> int | None:
    """First place from which a chain of plausible records runs on, or reaches the end of the data."""
    for at in range(len(data) - 36):
        p = at
        for _ in range(chain):
            n = plausible(data, p, n_ref)
            if not n:
                break
            p += n
            if p + 36 > len(data):
                return at
        else:
            return at
    return None


class BamPartition(InputPartition):
    def __init__(self, path: str, first: int, end: int | None):
        self.path, self.first, self.end = path, first, end


class BamReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.split = int(options.get("splitsize", 64 << 20))

    def partitions(self):
        """Cuts at the first block at or after each multiple of the split size; a cut reads a few bytes of the file."""
        out = []
        for path in _list(self.path):
            with _open(path) as f:
                f.seek(0, 2)
                size = f.tell()
                cuts = [0]
                for at in range(self.split, size, self.split):
                    f.seek(at)
                    near = f.read(1 << 17)
                    i = near.find(b"\x1f\x8b\x08\x04")
                    while i >= 0:
                        try:
                            n = block_size(near[i : i + 18])
                            if near[i + n : i + n + 4] in (b"\x1f\x8b\x08\x04", b""):
                                cuts.append(at + i)
                                break
                        except (ValueError, struct.error):
                            pass
                        i = near.find(b"\x1f\x8b\x08\x04", i + 1)
                cuts = sorted({*cuts})
                out += [BamPartition(path, a, b) for a, b in zip(cuts, [*cuts[1:], None])]
        return out

    def read(self, partition):
        with _open(partition.path) as f:
            _, refs, skip = header(f)
            data, own, more = b"", 0, blocks(f, partition.first, partition.end)
            for _, x in more:
                data += x
                own += len(x)
                if partition.first == 0 and len(data) < skip:
                    continue
                break
            if partition.first == 0:
                while len(data) < skip:
                    x = next(more)[1]
                    data, own = data + x, own + len(x)
                at = skip
            else:
                at = find_start(data, len(refs))
                while at is None:
                    try:
                        x = next(more)[1]
                    except StopIteration:
                        return
                    data, own = data + x, own + len(x)
                    at = find_start(data, len(refs))
            rest = None
            gone = 0  # bytes of this partition's blocks that were dropped from data
            while True:
                if gone + at >= own:
                    nxt = next(more, None)
                    if nxt is None:
                        return
                    data, own = data + nxt[1], own + len(nxt[1])
                while len(data) < at + 4 or len(data) < at + 4 + struct.unpack_from("<i", data, at)[0]:
                    nxt = next(more, None)
                    if nxt is not None:
                        data, own = data + nxt[1], own + len(nxt[1])
                        continue
                    # the last record may end in the next partition's blocks
                    rest = rest or blocks(f, partition.end) if partition.end is not None else iter(())
                    tail = next(rest, None)
                    if tail is None:
                        return
                    data += tail[1]
                n = struct.unpack_from("<i", data, at)[0]
                yield record(data[at + 4 : at + 4 + n], partition.path, refs)
                at += 4 + n
                if at > 1 << 20:
                    data, gone, at = data[at:], gone + at, 0


class BamDataSource(DataSource):
    @classmethod
    def name(cls):
        return "alnquant_bam"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return BamReader(self.options)


def read_bam(spark, path: str, **options):
    spark.dataSource.register(BamDataSource)
    return spark.read.format("alnquant_bam").options(**options).load(path)


def references(spark, path: str):
    """rid, refname, reflength of a BAM file's header."""
    with _open(_list(path)[0]) as f:
        _, refs, _ = header(f)
    return spark.createDataFrame([(i, n, k) for i, (n, k) in enumerate(refs)], "rid int, refname string, reflength int")


def write_bam(path: str, refs: list[tuple[str, int]], rows: list[dict], text: str = "", block: int = 60_000) -> None:
    """A small BAM file from dictionaries (qname, flag, rid, pos, mapq, cigar, tags); for tests and exports of samples."""
    import re

    out = b"BAM\x01" + struct.pack("<i", len(text)) + text.encode() + struct.pack("<i", len(refs))
    for n, k in refs:
        out += struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", k)
    for r in rows:
        ops = [int(n) << 4 | OPS.index(o) for n, o in re.findall(r"(\d+)([MIDNSHP=X])", r.get("cigar", ""))]
        name = r["qname"].encode() + b"\0"
        body = struct.pack("<iiBBHHHiiii", r["rid"], r["pos"], len(name), r.get("mapq", 60), 0, len(ops), r["flag"], 0, -1, -1, 0) + name + struct.pack(f"<{len(ops)}I", *ops)
        for k, v in r.get("tags", {}).items():
            body += k.encode() + (b"i" + struct.pack("<i", v) if isinstance(v, int) else b"f" + struct.pack("<f", v) if isinstance(v, float) else b"BS" + struct.pack(f"<I{len(v)}H", len(v), *v) if isinstance(v, list) else b"Z" + v.encode() + b"\0")
        out += struct.pack("<i", len(body)) + body
    with open(path, "wb") as f:
        for i in range(0, len(out), block):
            raw = out[i : i + block]
            c = zlib.compressobj(6, zlib.DEFLATED, -15)
            z = c.compress(raw) + c.flush()
            f.write(b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(z) + 25) + z + struct.pack("<II", zlib.crc32(raw), len(raw)))
        f.write(bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000"))
