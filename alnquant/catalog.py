"""Registered queries over the proxy tables, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import oracle as O
from . import proxy
from .config import AmbigMode, Overlap, ProfileConfig, RunMode, Scaling
from .operators import align, collate, counts, coverage, features, overlap, store, weight
from .plans import profile

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
EXACT = ProfileConfig(exact_sums=True)
REGION = ProfileConfig(mode=RunMode.SMALL_GENOME, exact_sums=True)


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def _aln(spark, d):
    return align.derive(proxy.alignments(spark, d))


def _passed(spark, d):
    return align.passed(_aln(spark, d))


def _weighted(spark, d, mode=AmbigMode.ONE_OVER_N, pec=1):
    return weight.weighted(weight.groups(_passed(spark, d)), mode, pec)


def _genes(spark, d, cfg=EXACT):
    return profile.gene_counts(proxy.alignments(spark, d), cfg)


def _annotated(spark, d):
    return features.annotate(_genes(spark, d), proxy.annotations(spark, d), ["rid"])


# ---------------------------------------------------------------- alignments

query("aln_derive", O.q([O.ALN, O.STATUS], "select aln_id, qname, rid, flag, q_start, q_end, mate, flag & 16 <> 0 as rev_strand from st"))(
    lambda s, d: _aln(s, d).select("aln_id", "qname", "rid", "flag", "q_start", "q_end", "mate", "rev_strand")
)
query("aln_filter_status", O.q([O.ALN, O.STATUS], "select status, count(*) as n from st group by status"))(
    lambda s, d: _aln(s, d).groupBy(align.filter_status().alias("status")).agg(F.count("*").alias("n"))
)
query("aln_filtered", O.q([O.ALN, O.STATUS, O.PASSED], "select aln_id, rid, alen, nm, 1 - nm / cast(alen as double) as identity from passed"))(
    lambda s, d: _passed(s, d).select("aln_id", "rid", "alen", "nm", align.identity().alias("identity"))
)
_STATS = """rs as (select count(*) as total_reads, sum(al) as aligned_reads, sum(pa) as filtered_reads, sum(p) as pass_alignments, sum(s) as seqid_filtered, sum(l) as length_filtered from (
 select qname, max(cast(flag & 4 = 0 as bigint)) as al, max(cast(status = 'pass' as bigint)) as pa, count(*) filter (where status = 'pass') as p,
  count(*) filter (where status = 'seqid') as s, count(*) filter (where status = 'length') as l from st group by qname))"""


def _stats(s, d):
    return align.read_stats(_aln(s, d), align.filter_status()).drop("stream_id")


_STAT_COLS = "total_reads, cast(aligned_reads as bigint) as aligned_reads, cast(filtered_reads as bigint) as filtered_reads, cast(pass_alignments as bigint) as pass_alignments, cast(seqid_filtered as bigint) as seqid_filtered, cast(length_filtered as bigint) as length_filtered"
query("read_stats", O.q([O.ALN, O.STATUS, _STATS], f"select {_STAT_COLS} from rs"))(_stats)
query("aln_rates", O.q([O.ALN, O.STATUS, _STATS], f"select {_STAT_COLS}, round(aligned_reads / total_reads, 3) * 100 as alignment_rate, round(filtered_reads / total_reads, 3) * 100 as pass_rate from rs"))(
    lambda s, d: align.rates(_stats(s, d))
)
query(
    "aln_stats",
    O.q([O.ALN, O.STATUS, _STATS], "select unnest(['Total', 'Passed', 'Seqid', 'Length']) as stat, unnest([cast(pass_alignments + seqid_filtered + length_filtered as bigint), cast(pass_alignments as bigint), cast(seqid_filtered as bigint), cast(length_filtered as bigint)]) as n from rs"),
)(lambda s, d: align.stats_table(_stats(s, d)))


def _flags(s, d):
    from .functions import sam

    names = ("paired", "reverse", "first", "second", "secondary", "supplementary", "unmapped")
    return _aln(s, d).agg(*[F.count_if(sam.has(n)).alias(n) for n in names], F.count_if(sam.is_primary()).alias("primary_aln"))


query(
    "flag_predicates",
    O.q([O.ALN], "select " + ", ".join(f"count(*) filter (where flag & {m} <> 0) as {n}" for n, m in (("paired", 1), ("reverse", 16), ("first", 64), ("second", 128), ("secondary", 256), ("supplementary", 2048), ("unmapped", 4))) + ", count(*) filter (where flag & 2304 = 0) as primary_aln from aln"),
)(_flags)

# ---------------------------------------------------------------- reads and weights

_GRP = [O.ALN, O.STATUS, O.PASSED, O.grouped()]
query("group_ambiguity", O.q(_GRP, "select qname, bool_or(ambiguous) as ambiguous, count(*) as n from grp group by qname"))(
    lambda s, d: weight.groups(_passed(s, d)).groupBy("qname").agg(F.max("ambiguous").alias("ambiguous"), F.count("*").alias("n"))
)
query("group_ambiguity_mapq", O.q([O.ALN, O.STATUS, O.PASSED, O.grouped(by="mapq = 0")], "select ambiguous, count(*) as n from grp group by ambiguous"))(
    lambda s, d: weight.groups(_passed(s, d), ambiguous_by="mapq").groupBy("ambiguous").agg(F.count("*").alias("n"))
)
query("mate_alternatives", O.q(_GRP, "select aln_id, n_mate1, n_mate2, n_alt from grp"))(lambda s, d: weight.groups(_passed(s, d)).select("aln_id", "n_mate1", "n_mate2", "n_alt"))
for _m in AmbigMode:
    query(f"weights_{_m.value}", O.q([*_GRP, O.weighted(_m.value)], "select aln_id, ambiguous, contrib from wt"))(lambda s, d, m=_m: _weighted(s, d, m).select("aln_id", "ambiguous", "contrib"))
    query(
        f"seq_counts_{_m.value}", O.q([*_GRP, O.weighted(_m.value), O.counts("rid", "wt")], "select rid, uniq_raw, ambig_raw, combined_raw, uniq_lnorm, combined_lnorm from cnt")
    )(lambda s, d, m=_m: _genes(s, d, ProfileConfig(ambiguity=m, exact_sums=True)).drop("reflength"))
query("increments_pec2", O.q([*_GRP, O.weighted("all1", 2)], "select aln_id, contrib from wt"))(lambda s, d: _weighted(s, d, AmbigMode.ALL1, 2).select("aln_id", "contrib"))
query("run_detection", "select event_id, user_id, cast(sum(new) over (order by ts, event_id rows unbounded preceding) as bigint) as run_id from (select *, case when lag(user_id) over (order by ts, event_id) is not distinct from user_id then 0 else 1 end as new from events)")(
    lambda s, d: align.run_ids(s.read.parquet(f"{d}/events.parquet").select("event_id", "user_id", "ts"), "user_id", ["ts", "event_id"]).select("event_id", "user_id", "run_id")
)
query(
    "fragment_borders",
    O.q([O.ALN, O.STATUS], "select qname, min(rid) as rid, min(q_start) as frag_start, max(q_end) as frag_end from st where flag & 2304 = 0 and flag & 1 <> 0 group by qname having min(rid) = max(rid) and bool_or(mate = 1) and bool_or(mate = 2)"),
)(lambda s, d: align.aligned_pairs(_aln(s, d)).select("qname", "rid", "frag_start", "frag_end"))
query("reference_clashes", "select p_partkey as rid, count(distinct (p_name, p_size)) as variants from part group by 1 having count(distinct (p_name, p_size)) > 1")(
    lambda s, d: align.reference_clashes(s.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("rid"), F.col("p_name").alias("refname"), F.col("p_size").alias("reflength")))
)

# ---------------------------------------------------------------- counts, features, scaling

_STRANDS = ", ".join(
    f"coalesce(sum({O.U}) filter (where {on} and not ambiguous), 0) / 720720e0 as uniq_raw{x}, coalesce(sum({O.U}) filter (where {on}), 0) / 720720e0 as combined_raw{x}"
    for x, on in (("", "true"), ("_ss", "flag & 16 = 0"), ("_as", "flag & 16 <> 0"))
)
query("seq_counts_stranded", O.q([*_GRP, O.weighted()], f"select rid, {_STRANDS} from wt group by rid"))(lambda s, d: counts.stranded(_weighted(s, d), ["rid"], ~F.col("rev_strand"), True))
query(
    "gene_table",
    O.q([*O.GENE, f"t as (select {O.factor('uniq')}, {O.factor('combined')} from (select {O.four()} from cnt))"], "select rid, uniq_raw, uniq_lnorm, uniq_lnorm * uniq_factor as uniq_scaled, combined_raw, combined_lnorm, combined_lnorm * combined_factor as combined_scaled from cnt, t"),
)(lambda s, d: features.gene_table(_genes(s, d), True).drop("reflength", "ambig_raw"))
query(
    "gene_rpkm",
    O.q([*O.GENE, _STATS], "select rid, uniq_lnorm * 1e9 / cast(filtered_reads as double) as uniq_rpkm, combined_lnorm * 1e9 / cast(filtered_reads as double) as combined_rpkm from cnt, rs"),
)(lambda s, d: features.rpkm(_genes(s, d), _stats(s, d).first()["filtered_reads"]).select("rid", "uniq_rpkm", "combined_rpkm"))
_FEAT = [*O.GENE, O.ANN, O.FACTORS, O.FEATURES]
query("feature_counts", O.q(_FEAT, "select * from feat"))(lambda s, d: profile.feature_profile(proxy.alignments(s, d), proxy.annotations(s, d), EXACT))
_PER_FEATURE = f"fac as (select category, {O.factor('uniq')}, {O.factor('combined')} from (select category, {O.four()} from cnt join ann using (rid) group by category))"
query("feature_counts_per_feature_scaling", O.q([*O.GENE, O.ANN, _PER_FEATURE, O.FEATURES], "select * from feat"))(lambda s, d: features.feature_counts(_annotated(s, d), Scaling.PER_FEATURE, True))
query("scaling_factors", O.q([*O.GENE, O.ANN, O.FACTORS], "select * from fac"))(lambda s, d: features.scaling_factors(_annotated(s, d), True))
query(
    "category_rows",
    O.q(
        [*O.GENE, O.ANN, f"t as (select {O.factor('uniq')}, {O.factor('combined')} from (select {O.four()} from cnt where rid in (select rid from ann)))"],
        f"select category, uniq_raw, uniq_lnorm, uniq_lnorm * uniq_factor as uniq_scaled, combined_raw, combined_lnorm, combined_lnorm * combined_factor as combined_scaled from (select category, {O.four()} from (select distinct c.*, category from cnt c join ann using (rid)) group by category), t",
    ),
)(lambda s, d: _category_rows(s, d))


def _category_rows(s, d):
    g = _genes(s, d)
    ann = proxy.annotations(s, d)
    return features.category_rows(features.annotate(g, ann, ["rid"]), features.annotated(g, ann, ["rid"]), True)


query("header_rows", O.q([O.ALN, O.STATUS, _STATS], "select category, feature, cast(n as double) as uniq_raw from (select unnest(['brand', 'token', 'type']) as category), (select 'total_reads' as feature, aligned_reads as n from rs union all select 'filtered_reads', filtered_reads from rs)"))(
    lambda s, d: profile.report(proxy.alignments(s, d), proxy.annotations(s, d), EXACT).where("rank in (1, 2)").select("category", "feature", "uniq_raw")
)
query("unseen_features", O.q([*_FEAT, "dim as (select distinct category, feature from ann)"], "select category, feature, coalesce(uniq_raw, 0e0) as uniq_raw, coalesce(combined_raw, 0e0) as combined_raw from dim left join (select * from feat where uniq_raw > 40) using (category, feature) where category in (select category from feat where uniq_raw > 40)"))(
    lambda s, d: features.with_unseen(features.feature_counts(_annotated(s, d), exact=True).where("uniq_raw > 40"), proxy.annotations(s, d).select("category", F.explode("features").alias("feature"))).select("category", "feature", "uniq_raw", "combined_raw")
)
query("restrict_metrics", O.q(_FEAT, "select category, feature, uniq_raw, combined_raw from feat"))(lambda s, d: features.restrict(features.feature_counts(_annotated(s, d), exact=True), ("raw",)))
query("unannotated", O.q([*O.GENE, O.ANN], "select sum(cast(round(uniq_raw * 720720e0) as bigint)) / 720720e0 as uniq_raw, sum(cast(round(combined_raw * 720720e0) as bigint)) / 720720e0 as combined_raw from cnt where rid not in (select rid from ann)"))(
    lambda s, d: features.unannotated(_genes(s, d), proxy.annotations(s, d), "rid", True)
)


def _gene_groups(s, d):
    g = _genes(s, d).withColumn("refname", F.concat(F.lit("gene."), F.lower(F.hex(F.col("rid") % 16))))
    dim = s.range(1, 16).select("id", F.concat(F.lit("group"), F.col("id").cast("string")).alias("annotation_str"))
    from .functions import sums

    got, rest = features.gene_group_counts(g, "refname", dim)
    pair = [sums.total(F.col(f"{p}_raw"), True).alias(f"{p}_raw") for p in ("uniq", "combined")]
    return got.groupBy("annotation_str").agg(*pair).unionByName(rest.groupBy(F.lit("unannotated").alias("annotation_str")).agg(*pair))


query("gene_group_counts", O.q(O.GENE, "select case when rid % 16 = 0 then 'unannotated' else 'group' || cast(rid % 16 as varchar) end as annotation_str, sum(cast(round(uniq_raw * 720720e0) as bigint)) / 720720e0 as uniq_raw, sum(cast(round(combined_raw * 720720e0) as bigint)) / 720720e0 as combined_raw from cnt group by 1"))(_gene_groups)


def _external(s, d):
    c = s.read.parquet(f"{d}/lineitem.parquet").groupBy(F.col("l_partkey").alias("rid")).agg(F.sum("l_quantity").alias("uniq_raw")).join(proxy.references(s, d), "rid")
    c = counts.normalise(c.withColumn("combined_raw", F.col("uniq_raw")), F.col("reflength"))
    return features.feature_counts(features.annotate(c, proxy.annotations(s, d), ["rid"]), exact=True)


query(
    "external_gene_counts",
    O.q([O.ANN, "cnt as (select l_partkey as rid, sum(l_quantity) as uniq_raw, sum(l_quantity) as combined_raw, sum(l_quantity) / max(200 + 20 * p_size) as uniq_lnorm, sum(l_quantity) / max(200 + 20 * p_size) as combined_lnorm from lineitem join part on p_partkey = l_partkey group by 1)", O.FACTORS, O.FEATURES], "select * from feat"),
)(_external)

# ---------------------------------------------------------------- overlaps and regions

_OV = [O.ALN, O.STATUS, O.PASSED, O.REGIONS]
for _r in (Overlap.SMALL_GENOME, Overlap.DOMAIN, Overlap.EXACT):
    query(f"overlap_{_r.value}", O.q([*_OV, O.overlaps(_r.value)], "select aln_id, rid, start_pos, end_pos, cov_start, cov_end from hits"))(
        lambda s, d, r=_r: overlap.overlap(_passed(s, d), proxy.regions(s, d), r).select("aln_id", "rid", "start_pos", "end_pos", "cov_start", "cov_end")
    )
    query(f"overlap_binned_{_r.value}", O.q([*_OV, O.overlaps(_r.value)], "select aln_id, rid, start_pos, end_pos from hits"))(
        lambda s, d, r=_r: overlap.overlap(_passed(s, d), proxy.regions(s, d), r, bin_size=128, clip=False).select("aln_id", "rid", "start_pos", "end_pos")
    )
query("on_target_semi", O.q(_OV, "select aln_id, rid from passed where rid in (select seqid from regions)"))(lambda s, d: align.on_target(_passed(s, d), proxy.regions(s, d)).select("aln_id", "rid"))


def _regions(s, d):
    return profile.region_counts(proxy.alignments(s, d), proxy.regions(s, d), REGION)


query("region_counts", O.q(O.region_steps(), "select rid, start_pos, end_pos, uniq_raw, ambig_raw, combined_raw, uniq_lnorm, combined_lnorm from rc"))(_regions)


def _region_hits(s, d):
    return profile.weighted_alignments(proxy.alignments(s, d), REGION, proxy.regions(s, d))


_RSTR = ", ".join(
    f"coalesce(sum({O.U}) filter (where {on} and not ambiguous), 0) / 720720e0 as uniq_raw{x}, coalesce(sum({O.U}) filter (where {on}), 0) / 720720e0 as combined_raw{x}"
    for x, on in (("", "true"), ("_ss", "(flag & 16 <> 0) = on_minus"), ("_as", "(flag & 16 <> 0) <> on_minus"))
)
query("region_counts_stranded", O.q(O.region_steps(), f"select rid, start_pos, end_pos, {_RSTR} from hits group by rid, start_pos, end_pos"))(
    lambda s, d: counts.stranded(_region_hits(s, d), ["rid", "start_pos", "end_pos"], F.col("rev_strand") == F.col("on_minus"), True)
)


def _region_features(s, d):
    ann = proxy.regions(s, d).select(F.col("seqid").alias("rid"), "start_pos", "end_pos", F.lit("feature").alias("category"), F.array("feature").alias("features"))
    return features.feature_counts(features.annotate(_regions(s, d), ann, ["rid", "start_pos", "end_pos"]), exact=True)


query(
    "region_feature_counts",
    O.q(
        [*O.region_steps(), f"rf as (select r.*, feature from rc r join regions on seqid = rid and regions.start_pos = r.start_pos and regions.end_pos = r.end_pos)", f"fac as (select {O.factor('uniq')}, {O.factor('combined')} from (select {O.four()} from rf))"],
        f"select 'feature' as category, feature, uniq_raw, uniq_lnorm, uniq_lnorm * uniq_factor as uniq_scaled, combined_raw, combined_lnorm, combined_lnorm * combined_factor as combined_scaled from (select feature, {O.four()} from rf group by feature), fac",
    ),
)(_region_features)

# ---------------------------------------------------------------- coverage

_SEG = f"seg as (select rid, start_pos, end_pos, ambiguous, cov_start, cov_end, sum({O.U}) as wu from hits group by all)"
_BASE = "base as (select rid, start_pos, end_pos, b, coalesce(sum(wu) filter (where not ambiguous), 0) as u, sum(wu) as c, count(*) filter (where not ambiguous) as nu from (select *, unnest(range(cov_start, cov_end + 1)) as b from seg) group by rid, start_pos, end_pos, b)"
_COV = """cov as (select rid, start_pos, end_pos, sum(u) / 720720e0 / (end_pos - start_pos + 1) as uniq_depth, coalesce(sum(u) / 720720e0 / nullif(count(*) filter (where nu > 0), 0), 0e0) as uniq_depth_covered,
 count(*) filter (where nu > 0) / cast(end_pos - start_pos + 1 as double) as uniq_horizontal, sum(c) / 720720e0 / (end_pos - start_pos + 1) as combined_depth,
 sum(c) / 720720e0 / count(*) as combined_depth_covered, count(*) / cast(end_pos - start_pos + 1 as double) as combined_horizontal from base group by rid, start_pos, end_pos)"""


def _segments(s, d):
    return coverage.segments(_region_hits(s, d), True)


def _coverage(s, d):
    return coverage.metrics(coverage.depth_runs(_segments(s, d), True), True)


query("coverage_segments", O.q([*O.region_steps(), _SEG], "select rid, start_pos, end_pos, ambiguous, cov_start, cov_end, wu / 720720e0 as weight from seg"))(_segments)
query(
    "coverage_depth",
    O.q([*O.region_steps(), _SEG], "select rid, start_pos, end_pos, ambiguous, cast(b as integer) as base, sum(wu) / 720720e0 as depth from (select *, unnest(range(cov_start, cov_end + 1)) as b from seg) group by rid, start_pos, end_pos, ambiguous, b"),
)(lambda s, d: coverage.depth_per_base(_segments(s, d), True))
query("coverage_metrics", O.q([*O.region_steps(), _SEG, _BASE, _COV], "select * from cov"))(_coverage)
query(
    "coverage_features",
    O.q(
        [*O.region_steps(), _SEG, _BASE, _COV],
        "select 'feature' as category, feature, " + ", ".join(f"sum(cast(floor({p}_horizontal * 1e12 + 0.5e0) as bigint)) / 1e12 / count(*) as {p}_horizontal, sum(cast(floor({p}_depth * 1e12 + 0.5e0) as bigint)) / 1e12 as {p}_depth" for p in ("uniq", "combined")) + " from cov c join regions r on r.seqid = c.rid and r.start_pos = c.start_pos and r.end_pos = c.end_pos group by feature",
    ),
)(
    lambda s, d: coverage.by_feature(
        _coverage(s, d), proxy.regions(s, d).select(F.col("seqid").alias("rid"), "start_pos", "end_pos", F.lit("feature").alias("category"), F.array("feature").alias("features")), True
    )
)

# ---------------------------------------------------------------- collation

YEARS = [str(y) for y in range(1992, 1999)]
_LONG = "lng as (select cast(year(l_shipdate) as varchar) as sample, p_brand as feature, sum(l_quantity) as uniq_raw, case when year(l_shipdate) % 2 = 0 then cast(count(*) as double) end as combined_raw from lineitem join part on p_partkey = l_partkey group by year(l_shipdate), p_brand)"


def _long(s, d):
    li = s.read.parquet(f"{d}/lineitem.parquet").select("l_partkey", "l_quantity", F.year("l_shipdate").alias("y"))
    j = li.join(s.read.parquet(f"{d}/part.parquet").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    return j.groupBy(F.col("y").cast("string").alias("sample"), F.col("p_brand").alias("feature")).agg(F.sum("l_quantity").alias("uniq_raw"), F.when(F.first("y") % 2 == 0, F.count("*").cast("double")).alias("combined_raw"))


def _cols(metric: str, samples=YEARS) -> str:
    return ", ".join(f"""max({metric}) filter (where sample = '{y}') as "{y}" """ for y in samples)


query("collate_pivot", O.q([_LONG], f"select feature, {_cols('uniq_raw')} from lng group by feature"))(lambda s, d: collate.matrix(_long(s, d), YEARS, "uniq_raw"))
query("collate_fallback", O.q([_LONG], f"select feature, {_cols('coalesce(combined_raw, uniq_raw)')} from lng group by feature"))(lambda s, d: collate.matrix(_long(s, d), YEARS, "combined_raw"))
query("collate_index", O.q([_LONG], f"select feature, {_cols('uniq_raw')} from (select distinct p_brand as feature from part where p_brand like '%1') left join lng using (feature) group by feature"))(
    lambda s, d: collate.matrix(_long(s, d), YEARS, "uniq_raw", index=s.read.parquet(f"{d}/part.parquet").where("p_brand like '%1'").select(F.col("p_brand").alias("feature")))
)
query("collate_studies", O.q([_LONG], f"select feature, {_cols('uniq_raw')} from lng where (sample < '1995' and not feature like '%1') or (sample >= '1995' and not feature like '%2') group by feature"))(
    lambda s, d: collate.merge_studies([
        collate.matrix(_long(s, d).where("not feature like '%1'"), YEARS[:3], "uniq_raw"),
        collate.matrix(_long(s, d).where("not feature like '%2'"), YEARS[3:], "uniq_raw"),
    ])
)


def _stats_by_year(s, d):
    a = _aln(s, d).withColumn("sample", F.col("sample_year").cast("string"))
    st = align.read_stats(a, align.filter_status(), ("sample",))
    long = st.selectExpr("sample", "stack(4, 'Total', pass_alignments + seqid_filtered + length_filtered, 'Passed', pass_alignments, 'Seqid', seqid_filtered, 'Length', length_filtered) as (stat, n)")
    return collate.stats_matrix(long, YEARS)


query(
    "collate_aln_stats",
    O.q(
        [O.ALN, O.STATUS, "l as (select cast(sample_year as varchar) as sample, unnest(['Total', 'Passed', 'Seqid', 'Length']) as stat, unnest([count(*) filter (where status in ('pass', 'seqid', 'length')), count(*) filter (where status = 'pass'), count(*) filter (where status = 'seqid'), count(*) filter (where status = 'length')]) as n from st group by 1)"],
        f"select stat, {_cols('cast(n as double)')} from l group by stat",
    ),
)(_stats_by_year)


def _eav(s, d):
    sup = s.read.parquet(f"{d}/supplier.parquet").select(F.col("s_suppkey").alias("sample_id"), F.col("s_nationkey").alias("n_nationkey"))
    nat = s.read.parquet(f"{d}/nation.parquet").join(s.read.parquet(f"{d}/region.parquet"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("r_name").alias("sample"))
    samples = sup.join(nat, "n_nationkey").select("sample_id", "sample")
    feats = s.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("feature_id"), F.col("p_type").alias("feature"))
    obs = s.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_suppkey").alias("sample_id"), F.col("l_partkey").alias("feature_id"), F.col("l_quantity").alias("value"))
    return collate.eav(obs, samples, feats).groupBy("sample", "feature").agg(F.sum("value").alias("value"))


query("eav_collate", "select r_name as sample, p_type as feature, sum(l_quantity) as value from lineitem join supplier on s_suppkey = l_suppkey join nation on n_nationkey = s_nationkey join region on r_regionkey = n_regionkey join part on p_partkey = l_partkey group by 1, 2")(_eav)


def _split(s, d):
    ev = s.read.parquet(f"{d}/events.parquet").select("event_id", F.when(F.col("event_id") % 50 == 0, F.concat(F.lit("#"), "event_type", F.lit("_"), F.col("event_id").cast("string"))).otherwise(F.col("event_type")).alias("line"), F.pmod(F.col("user_id"), F.lit(8)).alias("table_id"))
    return collate.split_table(ev, "event_id", by=["table_id"]).groupBy("table_id", "category").agg(F.count("*").alias("n"))


query(
    "table_split",
    "select table_id, category, count(*) as n from (select *, last_value(case when line like '#%' then substr(line, 2) end ignore nulls) over (partition by table_id order by event_id rows unbounded preceding) as category from (select event_id, case when event_id % 50 = 0 then '#' || event_type || '_' || cast(event_id as varchar) else event_type end as line, user_id % 8 as table_id from events)) where not line like '#%' group by 1, 2",
)(_split)

# ---------------------------------------------------------------- annotation store


def _store(s, d):
    p = s.read.parquet(f"{d}/part.parquet").select(
        F.col("p_partkey").alias("seqid"), F.col("p_brand").alias("brand"), F.regexp_replace("p_name", " ", ",").alias("token"), F.when(F.col("p_size") % 5 == 0, "-").otherwise(F.col("p_type")).alias("type")
    )
    return store.long_form(p, ["seqid"], ["brand", "token", "type"])


_STORE = "lf as (select p_partkey as seqid, 'brand' as category, [p_brand] as features from part union all select p_partkey, 'token', list_sort(list_distinct(string_split(p_name, ' '))) from part union all select p_partkey, 'type', [p_type] from part where p_size % 5 <> 0)"
query("annot_long", O.q([_STORE], "select seqid, category, array_to_string(features, ',') as features from lf"))(
    lambda s, d: _store(s, d).select("seqid", "category", F.array_join(F.array_sort("features"), ",").alias("features"))
)
query("annot_dictionary", O.q([_STORE, "p as (select distinct category, unnest(features) as feature from lf)"], "select category, feature, cast(dense_rank() over (order by category) - 1 as bigint) as category_id, cast(row_number() over (order by category, feature) - 1 as bigint) as feature_id from p"))(
    lambda s, d: store.dictionary(_store(s, d)).select("category", "feature", F.col("category_id").cast("bigint").alias("category_id"), "feature_id")
)
_ENC = "enc as (select seqid, string_agg(category || '=' || array_to_string(features, ','), ';' order by category) as annotation from lf group by seqid)"
query("annot_encode", O.q([_STORE, _ENC], "select * from enc"))(lambda s, d: store.encode(_store(s, d), ["seqid"]))
query("annot_decode", O.q([_STORE], "select seqid, category, array_to_string(features, ',') as features from lf"))(
    lambda s, d: store.decode(store.encode(_store(s, d), ["seqid"]), ["seqid"]).select("seqid", "category", F.array_join("features", ",").alias("features"))
)


def _cog(s, d):
    letters = F.translate(F.upper(F.substring("p_name", 1, 1 + 0)), "", "")
    p = s.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("seqid"), F.when(F.col("p_size") % 3 == 0, letters).otherwise(F.upper(F.substring("p_type", 1, 3))).alias("COG_category"))
    return store.long_form(p, ["seqid"], ["COG_category"]).select("category", F.explode("features").alias("feature")).groupBy("category", "feature").agg(F.count("*").alias("n"))


query(
    "cog_split",
    "with c as (select case when p_size % 3 = 0 then upper(substr(p_name, 1, 1)) else upper(substr(p_type, 1, 3)) end as v from part) select category, feature, count(*) as n from (select 'COG_category' as category, unnest(string_split(v, '')) as feature from c union all select 'COG_category_composite', v from c where length(v) > 1) where feature <> '' group by 1, 2",
)(_cog)
query("annstr_sha256", "select sha256(lang || '=' || source) as annotation_hash, count(*) as n from documents group by 1")(
    lambda s, d: store.dedup_by_hash(s.read.parquet(f"{d}/documents.parquet").select("doc_id", F.concat("lang", F.lit("="), "source").alias("a")), "a", ["doc_id"])[1].groupBy("annotation_hash").agg(F.count("*").alias("n"))
)


def _merge(s, d):
    r = proxy.regions(s, d)
    more = r.where("seqid % 4 = 1").withColumn("feature", F.concat("feature", F.lit("x")))
    return overlap.merge_regions(r.drop("on_minus").unionByName(more.drop("on_minus"))).withColumn("features", F.array_join("features", ","))


query("interval_merge_features", O.q([O.REGIONS], "select seqid, start_pos, end_pos, case when seqid % 4 = 1 then feature || ',' || feature || 'x' else feature end as features from regions"))(_merge)
query("duplicate_seqids", "select p_brand as seqid, count(*) as n from part group by 1 having count(*) > 1")(lambda s, d: store.duplicate_seqids(s.read.parquet(f"{d}/part.parquet").select(F.col("p_brand").alias("seqid"))))
