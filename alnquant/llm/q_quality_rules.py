"""Registered query of operator 4."""

from . import common as C
from . import quality_rules as R


def op4_quality_rules(spark, sf_dir):
    return R.judge(C.read(spark, sf_dir, "documents").select("doc_id", "text", "lang")).drop("char_distance", "word_distance")


QUERIES = {"op4_quality_rules": op4_quality_rules}


#: the character classes of the operator, as patterns
PATTERNS = {
    "lower": "[a-z]",
    "upper": "[A-Z]",
    "digit": "[0-9]",
    "space": "[ ]",
    "line": "[\\x09-\\x0D]",
    "stop": "[.,;:?'\"()-]",
    "symbol": "[\\x21\\x23-\\x26\\x2A\\x2B\\x2F\\x3C-\\x3E\\x40\\x5B-\\x60\\x7B-\\x7F]",
}


def _distance(bins: int, p: str, q: str) -> str:
    term = "case when {x} > 0 then {x} * log2({x} / (({x} + {y}) / 2e0)) else 0e0 end"
    both = [f"({term.format(x=f'{p}{i}', y=f'{q}{i}')} + {term.format(x=f'{q}{i}', y=f'{p}{i}')}) / 2e0" for i in range(bins)]
    return f"sqrt(greatest(0e0, {' + '.join(both)}))"


def _oracle() -> str:
    forms = ", ".join(f"'{f(x)}'" for x in R.WORDS for f in (str.lower, str.capitalize, str.upper))
    chars, words = [PATTERNS[k] for k in R.CLASSES], R.WORDS
    count = ", ".join("length(t) - length(regexp_replace(t, '{}', '', 'g')) as n{}".format(c.replace("'", "''"), i) for i, c in enumerate(chars))
    per_word = ", ".join(f"coalesce(sum(n) filter (where x = '{x}'), 0) as m{i}" for i, x in enumerate(words))
    shares = [f"n{i} / greatest(cast(n_all as double), 1e0) as p{i}" for i in range(len(chars))]
    shares.append(f"(n_all - {' - '.join(f'n{i}' for i in range(len(chars)))}) / greatest(cast(n_all as double), 1e0) as p{len(chars)}")
    shares += [f"coalesce(m{i}, 0) / greatest(cast(n_words as double), 1e0) as q{i}" for i in range(len(words))]
    shares.append(f"(n_words - {' - '.join(f'coalesce(m{i}, 0)' for i in range(len(words)))}) / greatest(cast(n_words as double), 1e0) as q{len(words)}")
    means = ", ".join([f"avg(p{i}) as rp{i}" for i in range(len(chars) + 1)] + [f"avg(q{i}) as rq{i}" for i in range(len(words) + 1)])
    return rf"""
with d as (select doc_id, lang, coalesce(text, '') as t, length(coalesce(text, '')) as n_all, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
ws as (select doc_id, unnest(w) as x from d),
cw as (select doc_id, lower(x) as x, count(*) as n from ws where x in ({forms}) group by 1, 2),
cm as (select doc_id, {per_word} from cw group by doc_id),
wc as (select doc_id, sum(length(x)) as word_chars from ws group by doc_id),
g as (select doc_id, i, array_to_string(w[i : i + 2], ' ') as g from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from d where len(w) >= 3)),
dup as (select doc_id, g from g group by 1, 2 having count(*) > 1),
rp as (select doc_id, count(distinct j) as n_repeat_words from (select doc_id, unnest(range(i, i + 3)) as j from g join dup using (doc_id, g)) group by doc_id),
ln as (select doc_id, count(*) - count(distinct l) as n_dup_lines from (select doc_id, unnest(string_split(t, chr(10))) as l from d) where regexp_matches(l, '[^\x20\x09-\x0D]') group by doc_id),
m as (select d.doc_id, lang, n_all, cast(len(w) as bigint) as n_words, cast(coalesce(word_chars, 0) as bigint) as word_chars, cast(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
  coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words, {count}, cm.* exclude (doc_id)
 from d left join cm using (doc_id) left join wc using (doc_id) left join rp using (doc_id) left join ln using (doc_id)),
s as (select *, n_words < {R.MIN_WORDS} or 100 * n_repeat_words > 50 * n_words as base_failed, {", ".join(shares)} from m),
r as (select lang, {means} from s where not base_failed group by lang),
x as (select doc_id, min({_distance(len(chars) + 1, "p", "rp")}) as dc, min({_distance(len(words) + 1, "q", "rq")}) as dw from s, r group by doc_id)
select s.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
 not base_failed and coalesce(dc <= {R.CHAR_LIMIT}e0 + {R.ROOM}e0 / sqrt(greatest(cast(n_words as double), 1e0)), true)
  and coalesce(dw <= {R.WORD_LIMIT}e0 + {R.ROOM}e0 / sqrt(greatest(cast(n_words as double), 1e0)), true) as kept
from s left join x using (doc_id)"""


ORACLE = {"op4_quality_rules": _oracle()}
