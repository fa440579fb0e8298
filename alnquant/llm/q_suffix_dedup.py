"""Registered query of operator 1."""

from . import common as C
from . import suffix_dedup


def op1_suffix_dedup(spark, sf_dir):
    return suffix_dedup.remove_repeats(C.read(spark, sf_dir, "documents").select("doc_id", "text"), span=50)


QUERIES = {"op1_suffix_dedup": op1_suffix_dedup}

#: windows as hexadecimal text; spans from the gaps between removed windows
ORACLE = {
    "op1_suffix_dedup": """
with d as (select doc_id, lower(hex(encode(coalesce(text, '')))) as h, octet_length(encode(coalesce(text, ''))) as n from documents),
w as (select doc_id, i, md5(substr(h, 2 * i + 1, 100)) as s from (select doc_id, h, unnest(range(0, n - 49)) as i from d where n >= 50)),
f as (select s, min(doc_id) as first_doc from w group by s),
r as (select w.doc_id, i from w join f using (s) where first_doc < w.doc_id),
g as (select *, case when i - lag(i) over (partition by doc_id order by i) <= 50 then 0 else 1 end as new from r),
k as (select *, sum(new) over (partition by doc_id order by i rows unbounded preceding) as span from g),
sp as (select doc_id, span, min(i) as a, max(i) + 50 as e from k group by doc_id, span),
pc as (select sp.doc_id, a, e, substr(h, 2 * coalesce(lag(e) over (partition by sp.doc_id order by a), 0) + 1, 2 * (a - coalesce(lag(e) over (partition by sp.doc_id order by a), 0))) as before from sp join d using (doc_id)),
t as (select doc_id, cast(count(*) as bigint) as n_spans, cast(sum(e - a) as bigint) as n_removed, string_agg(before, '' order by a) as kept, max(e) as last_end from pc group by doc_id)
select d.doc_id, cast(n as bigint) as n_bytes, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans,
 sha256(unhex(coalesce(kept || substr(h, 2 * last_end + 1), h))) as kept_sha256
from d left join t using (doc_id)""",
}
