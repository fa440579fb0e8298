"""Registered query of operator 10."""

from . import common as C
from . import winnow


def op10_decontamination(spark, sf_dir):
    docs = C.read(spark, sf_dir, "documents").select("doc_id", "text")
    return winnow.scan(docs, C.read(spark, sf_dir, "benchmark"))


QUERIES = {"op10_decontamination": op10_decontamination}

ORACLE = {
    "op10_decontamination": r"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
bw as (select distinct item_id, k, array_to_string(w[i : i + k - 1], ' ') as g from (select item_id, w, least(len(w), 13) as k, unnest(range(1, len(w) - least(len(w), 13) + 2)) as i from b where len(w) > 0)),
dw as (select doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') as g from (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) as i from d, (select distinct k from bw) where len(w) >= k)),
h as (select doc_id, i, dw.k as k, item_id from dw join bw on dw.k = bw.k and dw.g = bw.g),
x as (select doc_id, count(distinct j) as n_hit from (select doc_id, unnest(range(i, i + k)) as j from h) group by doc_id),
y as (select doc_id, count(*) as n_items, string_agg(id, ',' order by id) as ids from (select distinct doc_id, cast(item_id as varchar) as id from h where item_id is not null) group by doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256,
 coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join x using (doc_id) left join y using (doc_id)""",
}
