"""Suffix-array dedup and the n-gram Jaccard join against brute force."""

import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest

from alnquant.llm import parity, suffix_dedup
from alnquant.llm.induce import suffix_array
from tests.llm.conftest import corpus

DDL = "doc_id long, text string, n_spans string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("budget", [0, 1 << 20])
def test_suffix_array(budget):
    rng = np.random.default_rng(0)
    for _ in range(150):
        n, k = int(rng.integers(0, 60)), int(rng.integers(1, 5))
        t = np.append(rng.integers(1, k + 1, n), 0)
        sa, lcp = suffix_array(t, 12, budget)
        x = t.tolist()
        want = sorted(range(n + 1), key=lambda i: x[i:])
        assert sa.tolist() == want
        for i in range(1, n + 1):
            d, a, b = 0, want[i - 1], want[i]
            while d < 12 and max(a, b) + d <= n and x[a + d] == x[b + d]:
                d += 1
            assert lcp[i] == d


def brute_cut(docs, span):
    first = {}
    for d, t in docs:
        b = (t or "").encode()
        for i in range(len(b) - span + 1):
            s = b[i : i + span]
            first[s] = min(first.get(s, d), d)
    out = []
    for d, t in docs:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - span + 1):
            if first[b[i : i + span]] < d:
                gone[i : i + span] = b"\1" * span
        runs = sum(1 for i in range(len(b)) if gone[i] and not (i and gone[i - 1]))
        out.append((d, len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_substring_dedup(spark, seed):
    docs = corpus(seed)
    df = spark.createDataFrame([(d, t, "clash") for d, t in docs], DDL).repartition(3)
    got = suffix_dedup.remove_repeats(df, 50).collect()
    assert sorted(tuple(r) for r in got) == brute_cut(docs, 50)


@pytest.mark.parametrize("span", [3, 20, 52, 100])
def test_substring_dedup_of_any_span(spark, span):
    docs = [(d, t) for d, t in corpus(5, 30) if d != 33]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert sorted(tuple(r) for r in suffix_dedup.remove_repeats(df, span).collect()) == sorted(tuple(x) for x in brute_cut(docs, span))


def test_substring_dedup_text_null_ids_and_empty(spark):
    p = "é" * 40 + "0123456789" * 6
    df = spark.createDataFrame([(1, p, "a"), (2, "ab" + p + "cd", "b"), (None, p, "c"), (None, None, None)], "doc_id long, text string, lang string")
    got = {(r["doc_id"], r["lang"]): r["text"] for r in suffix_dedup.remove_repeats(df, text_out=True).collect()}
    assert got == {(1, "a"): p, (2, "b"): "abcd", (None, "c"): p, (None, None): ""}
    assert suffix_dedup.remove_repeats(df.where("false")).count() == 0


def brute_components(docs, k, num):
    sets = []
    for d, t in docs:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    up = list(range(len(docs)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                up[find(i)] = find(j)
    least = defaultdict(lambda: 10**9)
    for i, (d, _) in enumerate(docs):
        least[find(i)] = min(least[find(i)], d)
    return sorted((d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(docs))


@pytest.mark.parametrize("seed,k,num", [(1, 4, 85), (2, 5, 80), (3, 2, 60)])
def test_jaccard(spark, seed, k, num):
    docs = corpus(seed, 50, 200)
    df = spark.createDataFrame([(d, t, "clash") for d, t in docs], DDL).repartition(3)
    assert sorted(tuple(r) for r in parity.components(df, k, num).collect()) == brute_components(docs, k, num)


def test_jaccard_family_without_its_centre(spark):
    """Copies that differ from a lost original: many pairs fall short, chains hold the rest together."""
    rng = np.random.default_rng(4)
    base = [f"w{i}" for i in range(120)]
    docs = []
    for d in range(60):
        w = list(base)
        for i in rng.choice(120, 2, replace=False):
            w[i] = f"x{d}{i}"
        docs.append((d, " ".join(w)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(tuple(r) for r in parity.components(df).collect()) == brute_components(docs, 4, 85)
    assert parity.components(df.where("false")).count() == 0


def test_jaccard_null_ids_link(spark):
    """A row without a doc_id links two others that are too far apart to link themselves."""
    w = [f"w{i}" for i in range(200)]
    far = [*w[:5], "a1", *w[6:100], "a2", *w[101:190], "a3", *w[191:]]
    mid = [*w[:5], "a1", *w[6:100], "a2", *w[101:]]
    docs = [(1, " ".join(w)), (None, " ".join(mid)), (3, " ".join([*far[:40], "a4", *far[41:]])), (None, "quite alone here and now"), (None, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for num in (85, 90):
        sets = [{tuple(t.split()[i : i + 4]) for i in range(len(t.split()) - 3)} for _, t in docs[:3]]
        link = [[100 * len(x & y) >= num * len(x | y) for y in sets] for x in sets]
        got = sorted((tuple(r) for r in parity.components(df, 4, num).select("doc_id", "component_id", "n_shingles").collect()), key=str)
        same = link[0][1] and link[1][2]
        assert (1, 1, 197) in got and (3, 1 if same or link[0][2] else 3, 197) in got and (None, 1, 197) in got
        assert (None, None, 2) in got and (None, None, 0) in got
    assert link[0][1] and not link[0][2]


@pytest.mark.parametrize("num", [85, 80])
def test_keys_of_linked_sets_meet(num):
    rng = np.random.default_rng(3)
    for n in (6, 7, 12, 20, 50, 200, 1000):
        for _ in range(60):
            a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.int64).astype(np.uint64))
            cut = rng.integers(0, len(a) * 15 // 100 + 1)
            b = np.unique(np.concatenate([a[cut:], rng.integers(0, 1 << 63, rng.integers(0, len(a) * 15 // 100 + 1), dtype=np.int64).astype(np.uint64)]))
            both = len(np.intersect1d(a, b))
            if 100 * both >= num * (len(a) + len(b) - both) and not np.array_equal(a, b):
                assert len(np.intersect1d(parity.cell_keys(a, num), parity.cell_keys(b, num)))


def test_large_keys_are_split(spark):
    """Each probe meets each member of another component in one group, whatever the blocks and slices."""
    rng = np.random.default_rng(5)
    members = [(7, i, int(rng.choice([100, 100, 100, 200, i]))) for i in range(300)] + [(8, i, 100) for i in range(50)] + [(9, 1, 1), (9, 2, 2)]
    sk = [(i, 10, bytes(rng.integers(0, 256, 128, dtype=np.uint8))) for i in range(300)]
    m, s = spark.createDataFrame(members, "key long, cls long, label long"), spark.createDataFrame(sk, "cls long, n long, sketch binary")
    label = {c: x for k, c, x in members if k == 7}
    want = {(a, b) for a in label for b in label if a < b and label[a] != label[b]}
    for block, part in ((1000, 1000), (40, 1000), (1000, 70), (32, 50)):
        groups = {}
        for r in parity.dealt(m, s, block, part).collect():
            groups.setdefault((r["key"], r["block"], r["slice"]), []).append(r)
        assert not any(k == 8 for k, _, _ in groups) and len(groups[9, 0, 0]) == 2
        met = [(p["cls"], o["cls"]) for (k, _, _), g in groups.items() if k == 7 for p in g if p["probe"] for o in g if o["other"] and o["label"] != p["label"]]
        assert len(met) == len(set(met)) and {(min(x), max(x)) for x in met} == want
        assert max(sum(r["probe"] for r in g) for g in groups.values()) <= 2 * block
