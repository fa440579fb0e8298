"""Hand-computed profiles, and an independent scalar evaluation of random reads."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from alnquant import proxy
from alnquant.config import AmbigMode, Overlap, ProfileConfig, RgPolicy, RunMode, Scaling
from alnquant.operators import align, counts, coverage, features, overlap, weight
from alnquant.plans import profile

LEN = {1: 100, 2: 200, 3: 50}
# read, read group, flag, reference
MICRO = [
    ("r1", 1, 0, 1), ("r2", 1, 0, 1), ("r2", 1, 256, 2), ("r3", 2, 65, 1), ("r3", 2, 129, 2),
    ("r4", 2, 65, 1), ("r4", 2, 65 + 256, 3), ("r4", 2, 129, 2),
]
EXPECT = {
    "1overN": {1: (1.5, 2.25), 2: (0.5, 1.5), 3: (0, 0.25)},
    "all1": {1: (1.5, 3.0), 2: (0.5, 2.0), 3: (0, 0.5)},
    "primary_only": {1: (1.5, 3.0), 2: (0.5, 1.0)},
    "unique_only": {1: (1.5, 1.5), 2: (0.5, 0.5)},
}


def frame(spark, rows):
    data = [(0, i, q, rg, f, rid, LEN[rid], 50, 0, 0, 60) for i, (q, rg, f, rid) in enumerate(rows)]
    return spark.createDataFrame(data, "stream_id int, aln_id long, qname string, rg int, flag int, rid int, reflength int, alen int, nm int, pos int, mapq int")


def annotations(spark):
    return spark.createDataFrame([(1, "A", ["f1", "f2"]), (1, "B", ["x"]), (2, "A", ["f1"])], "rid int, category string, features array<string>")


@pytest.mark.parametrize("mode", EXPECT)
@pytest.mark.parametrize("exact", [False, True])
def test_modes(spark, mode, exact):
    got = profile.gene_counts(frame(spark, MICRO), ProfileConfig(ambiguity=AmbigMode(mode), exact_sums=exact)).collect()
    assert {r["rid"]: (r["uniq_raw"], r["combined_raw"]) for r in got} == EXPECT[mode]


def test_features_and_scaling(spark):
    g = profile.gene_counts(frame(spark, MICRO))
    ann = annotations(spark)
    a = features.annotate(g, ann, ["rid"])
    f = {(r["category"], r["feature"]): r for r in features.feature_counts(a).collect()}
    assert f["A", "f1"]["combined_raw"] == pytest.approx(3.75) and f["A", "f1"]["combined_scaled"] == pytest.approx(3.75)
    assert f["A", "f2"]["combined_scaled"] == pytest.approx(2.8125) and f["B", "x"]["combined_scaled"] == pytest.approx(2.25)
    c = {r["category"]: r for r in features.category_rows(a, g.join(ann.select("rid").distinct(), "rid", "left_semi")).collect()}
    assert c["A"]["combined_scaled"] == pytest.approx(3.75) and c["B"]["combined_scaled"] == pytest.approx(2.8125)
    per = {r["feature"]: r for r in features.feature_counts(a, Scaling.PER_FEATURE).collect()}
    assert per["f1"]["combined_scaled"] == pytest.approx(0.03 * 6 / 0.0525)
    t = features.total_factors(g).first()
    assert t["combined_factor"] == pytest.approx(4.0 / 0.035)


def test_report_rows(spark):
    r = profile.report(frame(spark, MICRO), annotations(spark), ProfileConfig(restrict_metrics=("raw",))).orderBy("category", "rank", "feature").collect()
    assert [(x["category"], x["feature"], x["combined_raw"]) for x in r] == [
        ("A", "total_reads", 4.0), ("A", "filtered_reads", 4.0), ("A", "category", 3.75), ("A", "f1", 3.75), ("A", "f2", 2.25),
        ("B", "total_reads", 4.0), ("B", "filtered_reads", 4.0), ("B", "category", 2.25), ("B", "x", 2.25),
    ]
    assert "uniq_lnorm" not in r[0].asDict()


def test_only_secondary_is_ambiguous_and_no_read_group(spark):
    rows = [("a", None, 256, 1), ("b", None, 0, 1), ("c", None, 65, 1)]
    g = weight.groups(align.derive(frame(spark, rows)))
    w = {r["qname"]: (r["ambiguous"], r["contrib"]) for r in weight.weighted(g).collect()}
    assert w == {"a": (True, 1.0), "b": (False, 1.0), "c": (False, 0.5)}
    with pytest.raises(Exception, match="read group"):
        weight.weighted(g, policy=RgPolicy.STRICT).collect()


def test_read_group_conflict(spark):
    g = weight.groups(align.derive(frame(spark, [("a", 1, 0, 1), ("a", 2, 0, 1), ("b", 1, 0, 1)])))
    assert [r["qname"] for r in weight.library_conflicts(g).collect()] == ["a"]


def test_filters(spark):
    rows = [("length", 44, 10), ("pass", 100, 3), ("pass", 100, None), ("seqid", 100, 4)]
    d = spark.createDataFrame([(s, a, n, 0) for s, a, n in rows], "want string, alen int, nm int, flag int")
    assert all(r["want"] == r["s"] for r in d.withColumn("s", align.filter_status()).collect())


@pytest.mark.parametrize("qs,qe,hits", [(4, 9, "d"), (5, 10, "sde"), (19, 24, "sde"), (20, 25, "s")])
def test_overlap_edges(spark, qs, qe, hits):
    a = spark.createDataFrame([(1, "g", qs, qe)], "aln_id int, rid string, q_start int, q_end int")
    r = spark.createDataFrame([("g", 10, 20)], "seqid string, start_pos int, end_pos int")
    for rule, key in ((Overlap.SMALL_GENOME, "s"), (Overlap.DOMAIN, "d"), (Overlap.EXACT, "e")):
        for size in (None, 4, 128):
            assert overlap.overlap(a, r, rule, bin_size=size).count() == (key in hits)


def test_coverage(spark):
    seg = spark.createDataFrame([(1, 1, 10, False, 2, 4, 1.0), (1, 1, 10, False, 4, 6, 0.5), (1, 1, 10, True, 6, 8, 0.5)], "rid int, start_pos int, end_pos int, ambiguous boolean, cov_start int, cov_end int, weight double")
    m = coverage.metrics(coverage.depth_runs(seg)).first()
    got = [m[c] for c in ("uniq_depth", "uniq_depth_covered", "uniq_horizontal", "combined_depth", "combined_depth_covered", "combined_horizontal")]
    assert got == pytest.approx([0.45, 0.9, 0.5, 0.6, 6 / 7, 0.7])
    assert coverage.depth_per_base(seg).where("base = 4").first()["depth"] == 1.5


def test_region_mode_counts_reads_that_hit(spark):
    aln = spark.createDataFrame(
        [(0, 1, "a", 1, 0, 1, 500, 50, 0, 0, 60), (0, 2, "a", 1, 256, 1, 500, 50, 0, 400, 60), (0, 3, "b", 1, 0, 2, 500, 50, 0, 0, 60)],
        "stream_id int, aln_id long, qname string, rg int, flag int, rid int, reflength int, alen int, nm int, pos int, mapq int",
    )
    reg = spark.createDataFrame([(1, 1, 100), (1, 1, 100), (1, 20, 60)], "seqid int, start_pos int, end_pos int")
    r = profile.region_counts(aln, reg, ProfileConfig(mode=RunMode.SMALL_GENOME)).collect()
    # the secondary hits nothing: N is 1, but the read is ambiguous; equal intervals are one
    assert sorted((x["start_pos"], x["uniq_raw"], x["combined_raw"]) for x in r) == [(1, 0.0, 1.0), (20, 0.0, 1.0)]


def test_random_reads_against_scalar_evaluation(spark):
    rng = random.Random(5)
    rows = []
    for q in range(150):
        rg = rng.choice([1, 2])
        for _ in range(rng.randint(1, 6)):
            f = rng.choice([0, 256]) + (rng.choice([65, 129]) if rg == 2 else 0)
            rows.append((f"q{q}", rg, f, rng.choice([1, 2, 3])))
    for mode in AmbigMode:
        for pec in (1, 2):
            want = defaultdict(lambda: [0.0, 0.0])
            reads = defaultdict(list)
            for r in rows:
                reads[r[0]].append(r)
            for g in reads.values():
                amb = any(r[2] & 256 for r in g)
                if amb and mode is AmbigMode.UNIQUE_ONLY:
                    continue
                n = defaultdict(int)
                for r in g:
                    n[bool(r[2] & 128)] += 1
                for r in g:
                    if mode is AmbigMode.PRIMARY_ONLY and r[2] & 256:
                        continue
                    inc = 1.0 if r[1] == 1 else pec / 2
                    want[r[3]][amb] += inc / n[bool(r[2] & 128)] if amb and mode is AmbigMode.ONE_OVER_N else inc
            got = profile.gene_counts(frame(spark, rows).repartition(3), ProfileConfig(ambiguity=mode, paired_end_count=pec)).collect()
            assert {r["rid"]: pytest.approx([r["uniq_raw"], r["ambig_raw"]]) for r in got} == dict(want)


def test_stranded_and_gene_groups(spark):
    w = weight.weighted(weight.groups(align.derive(frame(spark, [("a", 1, 16, 1), ("b", 1, 0, 1)]))))
    r = counts.stranded(w, ["rid"], ~F.col("rev_strand")).first()
    assert (r["uniq_raw"], r["uniq_raw_ss"], r["uniq_raw_as"]) == (2.0, 1.0, 1.0)
    c = spark.createDataFrame([("x.1f", 2.0), ("y.1f", 1.0), ("z.0", 4.0)], "ref string, uniq_raw double")
    got, rest = features.gene_group_counts(c, "ref", spark.createDataFrame([(31, "g")], "id bigint, a string"))
    assert got.agg(F.sum("uniq_raw")).first()[0] == 3.0 and rest.first()["uniq_raw"] == 4.0


def test_runs_pairs_and_unseen(spark):
    d = spark.createDataFrame([(i, k) for i, k in enumerate("aabba")], "i int, k string")
    assert [r["run_id"] for r in align.run_ids(d, "k", ["i"]).orderBy("i").collect()] == [1, 1, 2, 2, 3]
    rng = random.Random(1)
    keys = [rng.choice(["a", "a", "b", None]) for _ in range(300)]
    d = spark.createDataFrame(list(enumerate(keys)), "i int, k string")
    want, n = [], 0
    for i, k in enumerate(keys):
        n += i == 0 or k != keys[i - 1]
        want.append(n)
    assert [r["run_id"] for r in align.run_ids(d, "k", ["i"]).orderBy("i").collect()] == want
    c = spark.createDataFrame([("A", "f", 1.0)], "category string, feature string, uniq_raw double")
    dim = spark.createDataFrame([("A", "f"), ("A", "g"), ("B", "h")], "category string, feature string")
    assert sorted((r["feature"], r["uniq_raw"]) for r in features.with_unseen(c, dim).collect()) == [("f", 1.0), ("g", 0.0)]


def test_config():
    assert RunMode.parse("genes") is RunMode.GENE and RunMode.SMALL_GENOME.report_unannotated
    for bad in (dict(restrict_metrics=("x",)), dict(inputs={"bam": ("a",), "sam": ("b",)}), dict(inputs={"fastq": ("a",)}), dict(paired_end_count=3)):
        with pytest.raises(ValueError):
            ProfileConfig(**bad)
    from alnquant.config import aligner_command, bind_reads

    assert bind_reads(("a",), ("b",), orphans=("c",)) == [("paired", ("a", "b")), ("orphan", ("c",))]
    assert "@RG\\tID:2\\tSM:sample" in aligner_command("bwa", "ref", "orphan", ("c",))
    with pytest.raises(ValueError):
        bind_reads(("a", "b"), ("c",))


def unfolded(spark):
    """Annotations that the optimizer takes for small."""
    return spark.range(1, 4).selectExpr("cast(id as int) as rid", "'A' as category", "array('f1', 'f2') as features")


def test_annotations_are_not_broadcast(spark):
    a = features.annotate(profile.gene_counts(frame(spark, MICRO)), unfolded(spark), ["rid"])
    plan = features.feature_counts(a, Scaling.PER_FEATURE)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [rid" in plan and "BroadcastHashJoin [rid" not in plan


def test_references_are_broadcast_only_if_few(spark, tmp_path):
    spark.range(300_000).selectExpr("id as p_partkey", "cast(id % 50 as int) as p_size").write.parquet(f"{tmp_path}/part.parquet")
    row = "0L as l_orderkey, 1 as l_linenumber, {} as l_partkey, 0L as l_suppkey, 1d as l_extendedprice, 10d as l_quantity, 0d as l_discount, 'N' as l_returnflag, timestamp '1995-01-01' as l_shipdate"
    spark.range(1).selectExpr(*row.format("299999L").split(", ")).write.parquet(f"{tmp_path}/lineitem.parquet")
    aln = proxy.alignments(spark, str(tmp_path))
    ann = spark.createDataFrame([(299999, "A", ["f"])], "rid long, category string, features array<string>")
    got = features.restrict(features.feature_counts(features.annotate(profile.gene_counts(aln), ann, ["rid"])), ("raw",))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [l_partkey" in plan and "BroadcastHashJoin [l_partkey" not in plan
    assert [tuple(r) for r in got.collect()] == [("A", "f", 1.0, 1.0)]


def test_keys_of_annotations_are_not_broadcast(spark):
    g, ann = profile.gene_counts(frame(spark, MICRO)), unfolded(spark)
    for d in (features.unannotated(g, ann, "rid"), align.on_target(frame(spark, MICRO), ann, seqid="rid"), features.annotated(g, ann, ["rid"])):
        assert "BroadcastHashJoin" not in d._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("exact", [False, True])
def test_depth_spreads_after_the_last_shuffle(spark, exact):
    rng = random.Random(3)
    rows = [(rng.randint(1, 3), 1, 150_000, rng.random() < 0.5, s, s + rng.choice([-2, -1, 0, 1, 30, 900]), rng.choice([0.25, 0.5, 1.0])) for s in [rng.choice([1, 65_000, 131_000]) + rng.randint(0, 1000) for _ in range(300)]]
    want = defaultdict(float)
    for rid, _, _, amb, a, b, weight_ in rows:
        for base in range(a, b + 1):
            want[rid, amb, base] += weight_
    seg = spark.createDataFrame(rows, "rid int, start_pos int, end_pos int, ambiguous boolean, cov_start int, cov_end int, weight double")
    got = coverage.depth_per_base(seg, exact)
    assert {(r["rid"], r["ambiguous"], r["base"]): r["depth"] for r in got.collect()} == want and dict(got.dtypes)["base"] == "int"
    above = got._jdf.queryExecution().optimizedPlan().toString().split("Repartition")[0]
    assert "sequence(run_start" in above and "Aggregate" not in above


@pytest.mark.parametrize("few", [True, False])
def test_region_hits_without_lists(spark, few, monkeypatch):
    monkeypatch.setattr(overlap, "BROADCAST_ROWS", 1000 if few else 0)
    # a read whose first alignment hits three regions (one in its later bins only), one that misses, and one without an interval
    rows = [(0, 1, "a", 1, 0, 1, 900, 300, 0, 100, 60), (0, 2, "a", 1, 256, 1, 900, 50, 0, 800, 60), (0, 3, "a", 1, 256, 2, 900, 50, 0, 10, 60), (0, 4, "b", 1, 256, 1, 900, 50, 0, None, 60), (0, 5, "b", 1, 0, 2, 900, 50, 0, 10, 60)]
    aln = spark.createDataFrame(rows, "stream_id int, aln_id long, qname string, rg int, flag int, rid int, reflength int, alen int, nm int, pos int, mapq int")
    reg = spark.createDataFrame([(1, 380, 390), (1, 110, 120), (1, 350, 500), (2, 1, 100), (2, 1, 100)], "seqid int, start_pos int, end_pos int")
    cfg = ProfileConfig(mode=RunMode.SMALL_GENOME)
    got = profile.region_counts(aln, reg, cfg)
    assert {(r["rid"], r["start_pos"]): (r["uniq_raw"], r["combined_raw"]) for r in got.collect()} == {(1, 380): (0, 0.5), (1, 110): (0, 0.5), (1, 350): (0, 0.5), (2, 1): (0, 1.5)}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "[aln_id" not in "".join(x for x in plan.split("\n") if "Join" in x)
    assert few or "BroadcastHashJoin" not in plan


def test_region_features_without_lists_and_broadcasts(spark, monkeypatch):
    monkeypatch.setattr(overlap, "BROADCAST_ROWS", 0)
    aln = frame(spark, MICRO).withColumn("pos", F.lit(10))
    reg = spark.createDataFrame([(1, 5, 20), (1, 30, 70), (2, 30, 70)], "seqid int, start_pos int, end_pos int")
    ann = reg.select(F.col("seqid").alias("rid"), "start_pos", "end_pos", F.lit("A").alias("category"), F.array(F.concat(F.lit("f"), F.col("seqid"))).alias("features"))
    got = profile.feature_profile(aln, ann, ProfileConfig(mode=RunMode.SMALL_GENOME), reg)
    assert {r["feature"]: r["combined_raw"] for r in got.collect()} == {"f1": 5.0, "f2": 1.5}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "BroadcastHashJoin [rid" not in plan
