"""N-gram Jaccard join over parity sketches (operator 9).

A document's set is its distinct K-word shingles.  Two sets of sizes a and b with Jaccard similarity of at least t differ
in at most (1 - t) / (1 + t) * (a + b) shingles.  Shingles are dealt by hash to m cells and each cell keeps the XOR of its
shingles' hashes, so a difference of D shingles changes at most D cells: the number of unlike cells is a lower bound for
the symmetric difference.  Sets are put in bands by size, m depends on the band alone, and each set gives the keys of its
first D + 1 cells that hold three shingles or more (pigeonhole: a partner must agree in one of them); sets with too few
such cells give all that hold two, else one, else all cells (a cell that is alike in both sets has the same count in both,
so whichever list has more cells than can differ meets the other).  A set near the upper edge of its band does so in the next band too.  Sets that share a key are
candidates, a 1024-bit parity sketch (again a lower bound) rejects most false ones, and the others are verified on the
whole sets.

Equal sets are one class from the start.  Within a key, members are compared with one of them (a hub) first; components are
formed, and only members that are still apart are compared further, in rounds, until none is left untested: no link
between components is lost, and large groups of near copies never become all their pairs.  Keys whose members are all in one
component are done; large ones are split over tasks.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import common as C

U64 = np.uint64
STEP = 1.5  # ratio of band edges
EDGES = np.unique(np.ceil(STEP ** np.arange(0, 90)).astype(np.int64))
SKETCH = 1024
STRONG = 3
NEAREST = 8  # partners tried for each member in the second round; the last round tries all that are left
BLOCK, SLICE = 2048, 16384  # probes and members of one key that one group compares
ROWS = 1000  # texts that go to Python at a time; a step then cuts them by bytes
SMALL = 1 << 20  # rows of (class, doc_id) that are broadcast at most: 16 MB


def sets_of(col: pa.Array, k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    buf, offs = C.text_buffer(col)
    _, _, h, first = C.words(buf, offs, C.SPACE_WORD)
    g, out = C.grams(h, k), []
    for a, e in zip(first[:-1].tolist(), first[1:].tolist()):
        x = np.sort(g[a : e - k + 1]) if e - a >= k else C.grams(h[a:e], e - a) if e > a else h[:0]
        if len(x) > 1:
            x = x[np.concatenate([[True], x[1:] != x[:-1]])]
        out.append(x)
    return out


def class_id(x: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(x.tobytes(), digest_size=8).digest(), "little", signed=True)


def apart(s: int, num: int) -> int:
    """Largest symmetric difference of two sets whose sizes add up to s, at a similarity of num / 100."""
    return (100 - num) * s // (100 + num)


def cell_keys(x: np.ndarray, num: int) -> np.ndarray:
    """Candidate keys of a set, for its own band and, where a partner can lie there, for the next one."""
    a = len(x)
    most = 100 * a // num  # size of the largest partner
    band = int(np.searchsorted(EDGES, a, "right")) - 1
    y, out = None, []
    for j in (band, band + 1):
        if j > band and most < EDGES[j]:
            break
        top = int(EDGES[j + 1]) - 1
        d = apart(a + min(top, most), num)
        if d == 0:  # only equal sets can link, and they are one class
            continue
        m = int(1.25 * apart(2 * top, num)) + 4
        if y is None:
            y = C.mix(x ^ U64(0xA0761D6478BD642F))
        cell = ((x >> U64(32)) * U64(m) >> U64(32)).astype(np.int64)
        n = np.bincount(cell, minlength=m)
        use = np.flatnonzero(n >= STRONG)[: d + 1]
        for least in range(STRONG - 1, -1, -1):  # too few: all cells of a lower count, of which a partner's are a part
            if len(use) > d:
                break
            use = np.flatnonzero(n >= least)
        value = np.zeros(m, U64)
        full = np.flatnonzero(n)
        value[full] = np.bitwise_xor.reduceat(y, (np.cumsum(n) - n)[full])
        out.append(C.mix(value[use] ^ C.mix(use.astype(U64) * U64(1 << 20) + n[use].astype(U64) * U64(1 << 44) + U64(j))))
    return np.concatenate(out) if out else np.zeros(0, U64)


def sketch_of(x: np.ndarray) -> bytes:
    return np.packbits((np.bincount((x & U64(SKETCH - 1)).astype(np.int64), minlength=SKETCH) & 1).astype(np.uint8)).tobytes()


def components(docs: DataFrame, k: int = 4, num: int = 85, also: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_shingles, component_id of each row of ``docs(doc_id, text)``, and its columns ``also``; links at
    similarity >= num / 100.

    A text with fewer than k words is one shingle; one without words, or null, has none and links with nothing.  Rows that
    share a doc_id are separate documents.  component_id is the smallest doc_id of the linked documents (nulls last).
    """
    spark = docs.sparkSession
    whole, docs = docs.select("doc_id", "text", *also), docs.select("doc_id", "text")

    def sign(batches):
        for b in C.pieces(batches):
            sets = sets_of(b.column(1), k)
            yield pa.RecordBatch.from_arrays([b.column(0), *(b.column(c) for c in also), pa.array([len(x) for x in sets], pa.int64()), pa.array([class_id(x) if len(x) else None for x in sets], pa.int64()), pa.array([sketch_of(x) if len(x) > 1 else None for x in sets], pa.binary())], ["doc_id", *also, "n_shingles", "cls", "sketch"])

    schema = StructType([*whole.drop("text").schema, *StructType.fromDDL("n_shingles long, cls long, sketch binary")])
    with C.batches_of(spark, ROWS):
        signed = C.save(whole.mapInArrow(sign, schema), "op9-classes")
    total = signed.agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()[0]
    parts = C.parts_for(4 * total, spark, 4 << 20)

    def keys(batches):
        kept, seen, have = [], set(), 0

        def flush():
            key = np.concatenate([x for x, _ in kept])
            cls = np.concatenate([np.full(len(x), c, np.int64) for x, c in kept])
            part = ((key >> U64(32)) * U64(parts) >> U64(32)).astype(np.int64)
            o = np.argsort(part, kind="stable")
            key, cls, part = key[o], cls[o], part[o]
            at = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            to = np.append(at[1:], len(part))
            return pa.RecordBatch.from_arrays([pa.array(part[at], pa.int32()), pa.array([key[i:j].tobytes() for i, j in zip(at, to)], pa.binary()), pa.array([cls[i:j].tobytes() for i, j in zip(at, to)], pa.binary())], ["part", "keys", "cls"])

        for b in C.pieces(batches):
            for x in sets_of(b.column(1), k):
                if len(x) < 2 or (c := class_id(x)) in seen:
                    continue
                seen.add(c)
                y = cell_keys(x, num)
                if len(y):
                    kept.append((y, c))
                    have += len(y)
            if have > 1 << 19:
                yield flush()
                kept, seen, have = [], set(), 0
        if kept:
            yield flush()

    def meet(group: pa.Table) -> pa.Table:
        key = np.frombuffer(b"".join(group.column("keys").to_pylist()), U64)
        cls = np.frombuffer(b"".join(group.column("cls").to_pylist()), np.int64)
        o = np.lexsort((cls, key))
        key, cls = key[o], cls[o]
        same = np.zeros(len(key), bool)
        same[1:] = key[1:] == key[:-1]
        new = ~same
        new[1:] |= cls[1:] != cls[:-1]
        key, cls, same = key[new], cls[new], same[new]
        at = np.flatnonzero(~same)
        n = np.diff(np.append(at, len(key)))
        rank = C.mix(cls.view(U64))
        least = np.minimum.reduceat(rank, at) if len(at) else rank
        # one of any keys that have the same members will do
        sums = np.add.reduceat(C.mix(rank), at) if len(at) else rank
        first = np.zeros(len(at), bool)
        first[np.unique(C.mix(sums + n.astype(U64)), return_index=True)[1]] = True
        first &= n > 1
        of = np.repeat(np.arange(len(at)), n)
        ok = first[of]
        hub = np.zeros(len(at), np.int64)
        is_hub = rank == least[of]
        hub[of[is_hub]] = cls[is_hub]
        pick = ok & ~is_hub
        lo, hi = np.minimum(cls, hub[of])[pick], np.maximum(cls, hub[of])[pick]
        pair = np.unique(np.stack([lo, hi], 1), axis=0) if len(lo) else np.zeros((0, 2), np.int64)
        more = ok & (n > 2)[of]
        a = np.concatenate([pair[:, 0], key[more].view(np.int64)])
        b = np.concatenate([pair[:, 1], cls[more]])
        kind = np.concatenate([np.zeros(len(pair), bool), np.ones(int(more.sum()), bool)])
        return pa.table({"more": pa.array(kind), "a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    with C.batches_of(spark, ROWS):
        met = C.save(docs.mapInArrow(keys, "part int, keys binary, cls binary").groupBy("part").applyInArrow(meet, "more boolean, a long, b long"), "op9-keys")
    runs = met.where("more").select(F.col("a").alias("key"), F.col("b").alias("cls"))
    pairs = met.where("not more").select("a", "b").distinct()
    classes = signed.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("rep"))
    # sets without a partner in any key need no sketch
    wanted = met.select(F.explode(F.when(F.col("more"), F.array("b")).otherwise(F.array("a", "b"))).alias("cls")).distinct()
    sketches = C.save(signed.where("sketch is not null").select("cls", F.col("n_shingles").alias("n"), "sketch").join(wanted, "cls", "left_semi").dropDuplicates(["cls"]), "op9-sketches")

    def texts(batches):
        """One text of each class stands for all that are equal as sets; a row of another class with the same doc_id goes."""
        for b in C.pieces(batches):
            found = [class_id(x) if len(x) else None for x in sets_of(b.column("text"), k)]
            ok = pa.array([x is not None and x == c for x, c in zip(found, b.column("cls").to_pylist())], pa.bool_())
            yield b.select(["cls", "text"]).filter(ok)

    def unnamed(batches):
        for b in C.pieces(batches):
            found = [class_id(x) if len(x) else None for x in sets_of(b.column("text"), k)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), b.column("text")], ["cls", "text"])

    # classes of rows that all have a null doc_id are found by class
    lost = classes.where("rep is null").select("cls")
    nameless = None if lost.isEmpty() else C.save(docs.where("doc_id is null").select("text").mapInArrow(unnamed, "cls long, text string").join(lost, "cls", "left_semi").dropDuplicates(["cls"]), "op9-nameless")

    def texts_of(near: DataFrame) -> DataFrame:
        rep = near.select(F.explode(F.array("a", "b")).alias("cls")).distinct().join(classes.where("rep is not null"), "cls").withColumnRenamed("rep", "doc_id")
        few = rep.count() <= SMALL
        found = docs.where("doc_id is not null").join(F.broadcast(rep) if few else rep, "doc_id").select("cls", "text")
        found = found.mapInArrow(texts, "cls long, text string").dropDuplicates(["cls"])
        with C.batches_of(spark, ROWS):
            return C.save(found if nameless is None else found.unionByName(nameless), "op9-texts")

    def possible(batches):
        for b in batches:
            na, nb = b.column("na").to_numpy(), b.column("nb").to_numpy()
            d = np.frombuffer(b"".join(b.column("sa").to_pylist()), U64) ^ np.frombuffer(b"".join(b.column("sb").to_pylist()), U64)
            far = np.bitwise_count(d.reshape(-1, SKETCH // 64)).sum(1)
            ok = (far <= (100 - num) * (na + nb) // (100 + num)) & (100 * np.minimum(na, nb) >= num * np.maximum(na, nb))
            yield b.select(["a", "b"]).filter(pa.array(ok))

    def verify(batches):
        last, own = None, None
        for b in C.pieces(batches, "tb", C.CHUNK):
            la, lb, hit = b.column("a").to_pylist(), b.column("b").to_pylist(), []
            for i, y in enumerate(sets_of(b.column("tb"), k)):
                if la[i] != last:
                    last, own = la[i], sets_of(b.column("ta").slice(i, 1), k)[0]
                both = len(np.intersect1d(own, y, assume_unique=True))
                if 100 * both >= num * (len(own) + len(y) - both):
                    hit.append(i)
            yield b.select(["a", "b"]).take(pa.array(hit, pa.int32()))

    def links_of(p: DataFrame) -> DataFrame:
        """Of the pairs those that link: sketches rule out most, and only texts of the others are sent."""
        left = sketches.select(F.col("cls").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
        right = sketches.select(F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
        near = C.save(p.join(right, "b").where("nb is not null").join(left, "a").mapInArrow(possible, "a long, b long"), "op9-near")
        full = texts_of(near)
        ta, tb = (full.select(F.col("cls").alias(c), F.col("text").alias(f"t{c}")) for c in "ab")
        with C.batches_of(spark, ROWS):
            out = C.save(near.join(tb, "b").join(ta, "a").mapInArrow(verify, "a long, b long"), "op9-links")
        C.drop(near, full)
        return out

    links = links_of(pairs)
    labels = connect(links)
    keys_left, tested = None, pairs
    for every in (False, True):
        rows = runs if keys_left is None else runs.join(keys_left, "key")
        named = C.save(rows.join(labels.withColumnRenamed("v", "cls"), "cls", "left").withColumn("label", F.coalesce("label", "cls")), "op9-members")
        crossed = C.save(dealt(named, sketches).groupBy("key", "block", "slice").applyInArrow(_crossing(num, every), "a long, b long, cut boolean"), "op9-crossed")
        C.drop(named)
        new = C.save(crossed.where("not cut").select("a", "b").distinct().join(tested, ["a", "b"], "left_anti"), "op9-pairs")
        # keys of which a member had more possible partners than were named
        keys_left = C.save(crossed.where("cut").select(F.col("a").alias("key")).distinct(), "op9-left")
        C.drop(crossed)
        if not new.isEmpty():
            more = links_of(new)
            tested = tested.unionByName(new)
            if not more.isEmpty():
                links = C.save(links.unionByName(more), "op9-links")
                labels = connect(links)
        if keys_left.isEmpty():
            break
    named = classes.join(labels.withColumnRenamed("v", "cls"), "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    least = named.groupBy("label").agg(F.min("rep").alias("component_id"))
    ids = C.save(named.join(least, "label").select("cls", "component_id"), "op9-components")
    out = C.save(signed.join(ids, "cls", "left").select("doc_id", *also, "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")), "op9-result")
    C.drop(met, signed, sketches, ids, keys_left, new, links, labels, *([] if nameless is None else [nameless]))
    C.release(spark)
    return out


def dealt(members: DataFrame, sketches: DataFrame, block: int = BLOCK, part: int = SLICE) -> DataFrame:
    """Rows of ``members(key, cls, label)`` of the keys whose members are still apart, with their sketches, dealt to tasks.

    A key's members outside its most frequent component (the probes) are compared with all members of other components.
    Keys in one component are left out.  Large keys are split into blocks of probes and slices of members, so that a group
    (key, block, slice) has about ``block`` probes and ``part`` members however many the key has; other keys are one group.
    A row is a probe, a member (``other``), or both.
    """
    sums = members.groupBy("key", "label").agg(F.count("*").alias("c")).groupBy("key")
    keys = sums.agg(F.sum("c").alias("m"), F.max(F.struct("c", "label")).alias("big")).where("m > big.c")
    keys = keys.select("key", F.col("big.label").alias("big"), F.expr(f"cast(ceil((m - big.c) / {block}) as int)").alias("blocks"), F.expr(f"cast(ceil(m / {part}) as int)").alias("slices"))
    keys = C.save(keys, "op9-apart")  # few: where their size allows, they are broadcast, and members stay where they are
    place = "label <> big as probes", "pmod(xxhash64(cls, 1), blocks) as ob", "pmod(xxhash64(cls, 2), slices) as os"
    rows = members.join(keys, "key").selectExpr("key", "cls", "label", "blocks", "slices", *place)
    # in every block as a member, and in every slice as a probe
    member = "transform(sequence(0, blocks - 1), x -> struct(x as block, cast(os as int) as slice, probes and x = ob as probe, true as other))"
    probe = "transform(filter(sequence(0, slices - 1), y -> probes and y <> os), y -> struct(cast(ob as int) as block, y as slice, true as probe, false as other))"
    return rows.join(sketches, "cls").selectExpr("key", "cls", "label", "n", "sketch", f"inline(concat({member}, {probe}))")


def _crossing(num: int, every: bool):
    def cross(t: pa.Table) -> pa.Table:
        C.serve()
        return _cross(t, num, every)

    return cross


def _cross(t: pa.Table, num: int, every: bool) -> pa.Table:
    """Pairs of a probe and a member in different components that the sketches don't rule out; for each probe the nearest
    ones, or every one.  Where there were more, a last row has the key and ``cut``."""
    cls, label, n, probe, other = (t.column(c).to_numpy() for c in ("cls", "label", "n", "probe", "other"))
    sk = np.frombuffer(b"".join(t.column("sketch").to_pylist()), U64).reshape(-1, SKETCH // 64)
    # members are in the order of their sizes, so those of a possible size stand together
    at = np.flatnonzero(other)
    at = at[np.argsort(n[at], kind="stable")]
    size, others, of = n[at], cls[at], label[at]
    a, b, cut = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], False
    for i in np.flatnonzero(probe).tolist():
        lo, hi = np.searchsorted(size, [-(-num * n[i] // 100), 100 * n[i] // num + 1])
        j = lo + np.flatnonzero(of[lo:hi] != label[i])
        if not len(j):
            continue
        far = np.bitwise_count(sk[at[j]] ^ sk[i]).sum(1)
        ok = far <= (100 - num) * (size[j] + n[i]) // (100 + num)
        j, far = j[ok], far[ok]
        if not every and len(j) > NEAREST:
            j, cut = j[np.lexsort((others[j], far))[:NEAREST]], True
        a.append(np.minimum(others[j], cls[i]))
        b.append(np.maximum(others[j], cls[i]))
    p = np.unique(np.stack([np.concatenate(a), np.concatenate(b)], 1), axis=0)
    p = np.concatenate([p, [[t.column("key")[0].as_py(), 0]]]) if cut else p
    flag = np.zeros(len(p), bool)
    flag[len(p) - cut :] = True
    return pa.table({"a": pa.array(p[:, 0], pa.int64()), "b": pa.array(p[:, 1], pa.int64()), "cut": pa.array(flag)})


def connect(links: DataFrame) -> DataFrame:
    """(v, label) of each end of ``links(a, b)``: the smallest end that can be reached.  Labels pass along links, and each
    label then follows its own label, until nothing changes."""
    both = C.save(links.select(F.col("a").alias("v"), F.col("b").alias("w")).union(links.select("b", "a")).distinct(), "edges")
    labels = C.save(both.groupBy("v").agg(F.least(F.min("w"), F.col("v")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("v").alias("w"), "label"), "w").groupBy("v").agg(F.min("label").alias("near"))
        step = labels.join(near, "v").select("v", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        root = labels.select(F.col("v").alias("label"), F.col("label").alias("root"))
        new = C.save(step.join(root, "label", "left").select("v", F.least("label", F.coalesce("root", "label")).alias("label"), "old"), "labels")
        changed = not new.where("label <> old").isEmpty()
        C.drop(labels)
        labels = new
        if not changed:
            C.drop(both)
            return labels.select("v", "label")
