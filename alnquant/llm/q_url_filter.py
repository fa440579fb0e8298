"""Registered query of operator 3."""

from . import common as C
from . import url_filter


def op3_url_filter(spark, sf_dir):
    return url_filter.judge(C.read(spark, sf_dir, "pages").select("page_id", "url")).drop("score")


QUERIES = {"op3_url_filter": op3_url_filter}


def _oracle() -> str:
    rules = sorted(url_filter.RULES, key=lambda r: -len(r[1] + r[2]))
    fits = [(f"(host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}')", h + p, a) for a, h, p in rules]
    rule = "case " + " ".join(f"when {f} then '{n}'" for f, n, _ in fits) + " end"
    action = "case " + " ".join(f"when {f} then '{a}'" for f, _, a in fits) + " end"
    steps, prob = [], {"a": f"1e0 / {url_filter.ALPHABET}e0", "b": f"1e0 / {url_filter.ALPHABET}e0"}
    joins = ""
    for k in range(url_filter.ORDER + 1):
        at = url_filter.ORDER + 1 - k
        steps.append(f"t{k} as (select substr(g, {at}, {k + 1}) as t, sum(a) as a{k}, sum(b) as b{k} from full_g group by 1)")
        steps.append(f"c{k} as (select substr(g, {at}, {k}) as c, sum(a) as ca{k}, sum(b) as cb{k} from full_g group by 1)")
        joins += f" join t{k} on t{k}.t = substr(g, {at}, {k + 1}) join c{k} on c{k}.c = substr(g, {at}, {k})"
        for x in "ab":
            prob[x] = f"(({x}{k} + {url_filter.BACKOFF}e0 * {prob[x]}) / (c{x}{k} + {url_filter.BACKOFF}e0))"
    return f"""
with u as (select page_id, regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 1) as h0, regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 2) as path from pages),
p as (select page_id, translate(h0, '{url_filter.UPPER}', '{url_filter.LOWER}') as host, path from u),
r as (select *, {rule} as rule, {action} as action from p),
s as (select host, path, count(*) as n, any_value(action) as action, repeat(chr(1), {url_filter.ORDER}) || lower(host || path) || chr(2) as t from r group by host, path),
gm as (select host, path, n, action, substr(t, i, {url_filter.ORDER + 1}) as g from (select *, unnest(range(1, length(t) - {url_filter.ORDER} + 1)) as i from s)),
full_g as (select g, coalesce(sum(n) filter (where action = 'allow'), 0) as a, coalesce(sum(n) filter (where action = 'block'), 0) as b from gm group by g),
{", ".join(steps)},
m as (select g, ln({prob["a"]}) - ln({prob["b"]}) as v from full_g{joins}),
sc as (select host, path, any_value(n) as n, any_value(action) as action, case when host = '' and path = '' then 0e0 else avg(v) end as score from gm join m using (g) group by host, path),
cl as (select action, sum(score * n) / sum(n) as mean, coalesce(stddev_samp(score), 0e0) + 1e-9 as sd from sc where action is not null group by action),
lim as (select case when count(*) = 2 then (max(mean) filter (where action = 'allow') * max(sd) filter (where action = 'block') + max(mean) filter (where action = 'block') * max(sd) filter (where action = 'allow')) / sum(sd) end as l from cl)
select page_id, r.host, r.path, rule, coalesce(r.action, case when l is null or score >= l then 'allow' else 'block' end) as verdict
from r join sc on sc.host = r.host and sc.path = r.path, lim"""


ORACLE = {"op3_url_filter": _oracle()}
