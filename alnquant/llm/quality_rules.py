"""Quality rules with a distribution-divergence test (operator 4), in DataFrame functions only.

Each document's histograms of character classes and of common words are compared with references of the languages by
Jensen-Shannon distance (base 2, so 0 to 1).  A language's reference is the mean histogram of its documents that pass the
base rules, over the whole corpus.  A document is judged by the language that it is nearest to, so a wrong or missing
language tag does no harm; short documents have noisier histograms and get more room, and below MIN_WORDS the test is off.
"""

from __future__ import annotations

import string
from itertools import islice

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

MIN_WORDS = 50
# distances that a long document may have: chosen on half of sf0.1's labelled documents that pass the base rules (135 of 141
# of quality 0 rejected, 2 of 1529 of quality 1 lost); the other half, held out: 145 of 150 and 1 of 1714
CHAR_LIMIT, WORD_LIMIT = 0.16, 0.22
ROOM = 0.7  # added, divided by the square root of the number of words
LOW = (1 << 24) - 1  # bits of a window's place beside its hash
BLOCK = 64  # language references that one step compares with

#: character classes: name and characters
CLASSES = {
    "lower": string.ascii_lowercase,
    "upper": string.ascii_uppercase,
    "digit": string.digits,
    "space": " ",
    "line": "\t\n\x0b\x0c\r",
    "stop": ".,;:?'\"()-",
    "symbol": "!#$%&*+/<=>@[\\]^_`{|}~\x7f",
}
#: the most frequent words of each language (fixed values)
COMMON = {
    "en": "the of and to in a is that it was for on are as with at be this by from".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als".split(),
    "fr": "de la le et les des en un une du dans pour que qui sur par au est il pas".split(),
    "es": "de la que el en y a los del se las por un para con no una su al lo".split(),
}
WORDS = sorted({w for ws in COMMON.values() for w in ws})
RANKED = list(dict.fromkeys(w for ws in zip(*COMMON.values()) for w in ws))  # the most frequent of each language first
FIRST = "lower"  # the class of most characters


def _lit(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def measures(docs: DataFrame, carried: list[str]) -> DataFrame:
    """Base measures and histograms of each text; a null text has no words."""
    d = docs.select(*carried, F.coalesce(F.col("text"), F.lit("")).alias("t"))
    # splitting at one plain character needs no regular expression, and replacing a character that is not there is a scan
    blank = "t"
    for code in range(0x09, 0x0E):
        blank = f"replace({blank}, char({code}), ' ')"
    d = d.withColumn("w", F.expr(f"array_remove(split({blank}, ' '), '')"))
    d = d.withColumns({
        "rest": F.expr(f"translate(t, {_lit(CLASSES[FIRST] + CLASSES['space'])}, '')"),
        "lines": F.expr(r"filter(split(t, '\n'), l -> l rlike '[^\\x20\\x09-\\x0D]')"),
        "found": F.expr(f"filter(w, x -> x in ({', '.join(_lit(f(x)) for x in WORDS for f in (str.lower, str.capitalize, str.upper))}))"),
        "g": F.expr("case when size(w) >= 3 then transform(arrays_zip(slice(w, 1, size(w) - 2), slice(w, 2, size(w) - 2), slice(w, 3, size(w) - 2)), x -> xxhash64(x)) else cast(array() as array<bigint>) end"),
    })
    # what is neither of the first class nor a blank is a small part of the text; the other classes are counted there
    rest = [k for k in CLASSES if k not in (FIRST, "space")]
    # the common words, each between bars of its own, are taken out one after the other: the lengths give their counts
    tally = f"aggregate(array({', '.join(_lit(f'|{x}|') for x in RANKED)}), struct(concat('|', lower(array_join(found, '||')), '|') as s, cast(array() as array<int>) as n), (a, x) -> struct(replace(a.s, x, '') as s, concat(a.n, array(octet_length(a.s))) as n), a -> concat(a.n, array(octet_length(a.s))))"
    d = d.select(
        *carried,
        "g",
        F.size("w").alias("n_w"),
        F.size("found").alias("n_found"),
        F.char_length("t").alias("n_all"),
        F.char_length("rest").alias("n_rest"),
        F.expr("octet_length(t) - octet_length(replace(t, ' ', ''))").alias("c_space"),
        *(F.expr(f"char_length(rest) - char_length(translate(rest, {_lit(CLASSES[k])}, ''))").alias(f"c_{k}") for k in rest),
        F.expr("cast(char_length(rest) - char_length(translate(rest, '#*$%&|<>', '')) as bigint)").alias("n_symbols"),
        F.expr("cast(size(lines) - size(array_distinct(lines)) as bigint)").alias("n_dup_lines"),
        F.expr(tally).alias("tally"),
    )
    chars = [F.col("n_all") - F.col("n_rest") - F.col("c_space"), *(F.col(f"c_{k}") for k in CLASSES if k != FIRST)]
    words = [F.expr(f"(tally[{i}] - tally[{i + 1}]) div {len(x.encode()) + 2}") for x in WORDS for i in [RANKED.index(x)]]
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines"]
    d = d.select(
        *carried,
        "g",
        F.col("n_w").cast("long").alias("n_words"),
        (F.col("n_all") - F.col("c_space") - F.col("c_line")).cast("long").alias("word_chars"),
        "n_symbols",
        "n_dup_lines",
        _shares(chars, F.col("n_all"), sum(chars[1:], chars[0])).alias("p"),
        _shares(words, F.col("n_w"), F.col("n_found")).alias("q"),
    )
    # windows found twice or more: hashes sorted (their low 24 bits given to the place), places in the order with an equal one before
    d = d.withColumn("s", F.expr(f"case when size(array_distinct(g)) < size(g) then sort_array(transform(g, (h, i) -> (h & {~LOW}L) | i)) end"))
    d = d.withColumn("k", F.expr("filter(sequence(1, size(s) - 1), k -> shiftright(s[k] ^ s[k - 1], 24) = 0)"))
    # places beyond 24 bits, or hashes that differ in the bits given away, are told apart by (hash, place) in full
    d = d.withColumn("full", F.expr(f"size(g) > {LOW} or coalesce(exists(k, k -> g[cast(s[k] & {LOW} as int)] <> g[cast(s[k - 1] & {LOW} as int)]), false)"))
    pairs = "sort_array(transform(g, (h, i) -> struct(h as h, i as i)))"
    told = f"transform(array({pairs}), z -> sort_array(transform(filter(z, (x, k) -> (k > 0 and x.h = z[greatest(k - 1, 0)].h) or (k < size(z) - 1 and x.h = z[least(k + 1, size(z) - 1)].h)), x -> x.i)))[0]"
    brief = f"sort_array(array_distinct(flatten(transform(k, k -> array(cast(s[k] & {LOW} as int), cast(s[k - 1] & {LOW} as int))))))"
    d = d.withColumn("at", F.expr(f"case when s is null then null when full then {told} else {brief} end"))
    d = d.withColumn("n_repeat_words", F.expr("case when at is null then 0L else cast(aggregate(sequence(0, size(at) - 1), 0, (n, k) -> n + case when k = size(at) - 1 then 3 else least(3, at[least(k + 1, size(at) - 1)] - at[k]) end) as bigint) end"))
    return d.select(*carried, *base, "n_repeat_words", "p", "q")


def _shares(counts: list[Column], total: Column, counted: Column) -> Column:
    """Histogram of the counts, with what is left of the total as the last bin."""
    # no lambda: an expression that a lambda refers to may be put into it, and be worked out for each element
    whole = F.greatest(total.cast("double"), F.lit(1.0))
    return F.array(*[x / whole for x in (*counts, total - counted)])


def _distance(p: str, q: str) -> str:
    """Jensen-Shannon distance of two histograms."""
    part = "case when {x} > 0 then {x} * log2({x} / (({x} + {y}) / 2e0)) else 0e0 end"
    both = f"zip_with({p}, {q}, (x, y) -> ({part.format(x='x', y='y')} + {part.format(x='y', y='x')}) / 2e0)"
    return f"sqrt(greatest(0e0, aggregate({both}, 0e0, (a, x) -> a + x)))"


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, and the distances, of each row
    of ``docs(doc_id, text, lang)``.  Where no document passes the base rules there is no reference and the base rules
    alone decide; a null language tag is a tag of its own."""
    d = measures(docs, ["doc_id", "lang"])
    d = d.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    d = C.save(d, "op4-measures")
    np_, nq = len(CLASSES) + 1, len(WORDS) + 1
    refs = d.where("not base_failed").groupBy("lang").agg(
        F.array(*[F.avg(F.col("p")[i]) for i in range(np_)]).alias("p"),
        F.array(*[F.avg(F.col("q")[i]) for i in range(nq)]).alias("q"),
    )
    # every language's reference, a block of constants at a time; the running least passes from block to block
    refs = C.save(refs, "op4-references")
    d = d.withColumns({"char_distance": F.lit(None).cast("double"), "word_distance": F.lit(None).cast("double")})
    it = refs.toLocalIterator()
    rows, first = list(islice(it, BLOCK)), True
    while rows:
        for name, col in (("char_distance", "p"), ("word_distance", "q")):
            each = [_distance(col, "array(" + ", ".join(f"{x:.17e}" for x in r[col]) + ")") for r in rows]
            d = d.withColumn(name, F.expr(each[0] if first and len(each) == 1 else f"least({', '.join(each if first else [name, *each])})"))
        rows, first = list(islice(it, BLOCK)), False
        if rows:
            was, d = d, C.save(d, "op4-distances")
            C.drop(was)
    C.drop(refs)
    room = f"{ROOM}e0 / sqrt(greatest(cast(n_words as double), 1e0))"
    for name, limit in (("char_distance", CHAR_LIMIT), ("word_distance", WORD_LIMIT)):
        d = d.withColumn(name, F.coalesce(name, F.lit(0.0)))
        d = d.withColumn(f"{name}_ok", F.col(name) <= F.lit(limit) + F.expr(room))
    kept = ~F.col("base_failed") & F.col("char_distance_ok") & F.col("word_distance_ok")
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "char_distance", "word_distance")
