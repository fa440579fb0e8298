"""DuckDB SQL over the same tables: shared steps, and one final statement for each registered query."""

from __future__ import annotations

ALN = """aln as (
 select l.l_orderkey * 64 + ln as aln_id, l_orderkey as qname, l_partkey as rid, l_suppkey, l_quantity, ln,
  cast(1 + l_orderkey % 2 as integer) as rg,
  cast((case when l_orderkey % 2 = 1 then 1 + case when ln % 2 = 0 then 128 else 64 end else 0 end)
   + case when l_returnflag = 'R' then 16 else 0 end + case when ln > 1 + l_orderkey % 2 then 256 else 0 end
   + case when l_suppkey % 50 = 3 then 4 else 0 end + case when l_suppkey % 50 = 7 then 2048 else 0 end as integer) as flag,
  cast(200 + 20 * p_size as integer) as reflength, cast(40 + l_quantity as integer) as alen,
  cast(floor(round(l_discount * 100) / 2) as integer) as nm,
  cast(cast(round(l_extendedprice * 100) as bigint) % (200 + 20 * p_size - cast(40 + l_quantity as integer)) as integer) as pos,
  cast(l_suppkey % 61 as integer) as mapq, cast(year(l_shipdate) as bigint) as sample_year
 from (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_returnflag, l_shipdate) as ln from lineitem) l
 join part on p_partkey = l_partkey)"""
STATUS = """st as (
 select *, pos as q_start, pos + alen as q_end, case when flag & 128 <> 0 then 2 else 1 end as mate,
  case when flag & 4 <> 0 then 'unmapped' when flag & 2048 <> 0 then 'excluded' when alen < 45 then 'length'
   when 1 - nm / cast(alen as double) < 0.97e0 then 'seqid' else 'pass' end as status from aln)"""
PASSED = "passed as (select * from st where status = 'pass')"
REGIONS = """regions as (
 select p_partkey as seqid, cast(1 + 60 * i as integer) as start_pos, cast(100 + 60 * i + p_size as integer) as end_pos, p_brand as feature, i % 2 = 1 as on_minus
 from (select *, unnest(range(0, p_partkey % 3 + 1)) as i from part where p_partkey % 10 <> 0))"""
ANN = """ann as (
 select p_partkey as rid, 'brand' as category, p_brand as feature from part where p_partkey % 10 <> 0
 union all select p_partkey, 'type', p_type from part where p_partkey % 10 <> 0
 union all select distinct p_partkey, 'token', unnest(string_split(p_name, ' ')) from part where p_partkey % 10 <> 0)"""


def grouped(src: str = "passed", hit: str = "true", by: str = "flag & 256 <> 0", name: str = "grp") -> str:
    return f"""{name} as (
 select *, case when flag & 128 <> 0 then n_mate2 else n_mate1 end as n_alt from (
  select *, bool_or({by}) over (partition by qname) as ambiguous,
   count(*) filter (where {hit} and flag & 128 = 0) over (partition by qname) as n_mate1,
   count(*) filter (where {hit} and flag & 128 <> 0) over (partition by qname) as n_mate2 from {src}))"""


def weighted(mode: str = "1overN", pec: int = 1, src: str = "grp") -> str:
    inc = f"(case when rg = 1 then 1e0 else {pec}e0 / 2e0 end)"
    where = {"unique_only": "where not ambiguous", "primary_only": "where flag & 256 = 0"}.get(mode, "")
    share = f"case when ambiguous then {inc} / nullif(n_alt, 0) else {inc} end" if mode == "1overN" else inc
    return f"wt as (select *, {share} as contrib from {src} {where})"


U = "cast(round(contrib * 720720e0) as bigint)"


def counts(keys: str, src: str, name: str = "cnt", length: str = "max(reflength)") -> str:
    return f"""{name} as (
 select *, uniq_raw / len as uniq_lnorm, combined_raw / len as combined_lnorm from (
  select {keys}, coalesce(sum({U}) filter (where not ambiguous), 0) / 720720e0 as uniq_raw, coalesce(sum({U}) filter (where ambiguous), 0) / 720720e0 as ambig_raw,
   coalesce(sum({U}), 0) / 720720e0 as combined_raw, cast({length} as double) as len from {src} group by {keys}))"""


def four(prefix: str = "") -> str:
    out = []
    for p in ("uniq", "combined"):
        out.append(f"sum(cast(round({p}_raw * 720720e0) as bigint)) / 720720e0 as {p}_raw")
        out.append(f"sum(cast(floor({p}_lnorm * 1e12 + 0.5e0) as bigint)) / 1e12 as {p}_lnorm")
    return ", ".join(out)


def factor(p: str) -> str:
    return f"coalesce({p}_raw / nullif({p}_lnorm, 0e0), 0e0) as {p}_factor"


FACTORS = f"fac as (select category, {factor('uniq')}, {factor('combined')} from (select category, {four()} from (select distinct c.*, category from cnt c join ann using (rid)) group by category))"
FEATURES = f"""feat as (select category, feature, uniq_raw, uniq_lnorm, uniq_lnorm * uniq_factor as uniq_scaled, combined_raw, combined_lnorm, combined_lnorm * combined_factor as combined_scaled
 from (select category, feature, {four()} from cnt join ann using (rid) group by category, feature) join fac using (category))"""
GENE = [ALN, STATUS, PASSED, grouped(), weighted(), counts("rid", "wt")]


def q(steps: list[str], final: str) -> str:
    return ("with " + ",\n".join(steps) + "\n" if steps else "") + final


RULES = {
    "small_genome": "start_pos <= q_end and end_pos >= q_start",
    "domain": "q_end >= start_pos - 1 and q_start <= end_pos - 1",
    "exact": "start_pos <= q_end and end_pos >= q_start + 1",
}


def overlaps(rule: str, src: str = "passed") -> str:
    return f"hits as (select *, greatest(q_start, start_pos) as cov_start, least(q_end, end_pos) as cov_end from {src} join regions on rid = seqid and {RULES[rule]})"


def region_steps(rule: str = "small_genome") -> list[str]:
    return [
        ALN, STATUS, PASSED, REGIONS,
        "tgt as (select p.*, exists(select 1 from regions r where r.seqid = p.rid and r.start_pos <= p.q_end and r.end_pos >= p.q_start) as has_hit from passed p where rid in (select seqid from regions))",
        grouped("tgt", "has_hit"), weighted(), overlaps(rule, "wt"),
        counts("rid, start_pos, end_pos", "hits", "rc", "max(end_pos - start_pos + 1)"),
    ]
