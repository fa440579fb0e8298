"""Registered query of operator 9."""

from . import common as C
from . import parity


def op9_jaccard_join(spark, sf_dir):
    return parity.components(C.read(spark, sf_dir, "documents").select("doc_id", "text"), k=4, num=85)


QUERIES = {"op9_jaccard_join": op9_jaccard_join}

ORACLE = {
    "op9_jaccard_join": r"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select distinct doc_id, array_to_string(w[i : i + 3], ' ') as g from (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) as i from d where len(w) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as m from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
e as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * m >= 85 * (x.n + y.n - m)),
c as (select doc_id as v, doc_id as r from d union select e.b, c.r from c join e on e.a = c.v)
select d.doc_id, cast(coalesce(n, 0) as bigint) as n_shingles, (select min(r) from c where v = d.doc_id) as component_id from d left join n using (doc_id)""",
}
