"""Column expressions over SAM fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: flag bits of the SAM specification (fixed values)
FLAGS = {
    "paired": 0x1, "properly_paired": 0x2, "unmapped": 0x4, "mate_unmapped": 0x8, "reverse": 0x10, "mate_reverse": 0x20,
    "first": 0x40, "second": 0x80, "secondary": 0x100, "qc_failed": 0x200, "duplicate": 0x400, "supplementary": 0x800,
}


def has(name: str, flag: str | Column = "flag") -> Column:
    return (F.col(flag) if isinstance(flag, str) else flag).bitwiseAND(FLAGS[name]) != 0


def is_primary(flag: str = "flag") -> Column:
    return F.col(flag).bitwiseAND(FLAGS["secondary"] | FLAGS["supplementary"]) == 0


def mate(flag: str = "flag") -> Column:
    """2 for the second read of a pair, else 1."""
    return F.when(has("second", flag), 2).otherwise(1)


def ref_length(cigar: str = "cigar") -> Column:
    """Bases of the reference that a CIGAR string spans: M, D, N, = and X."""
    return F.expr(f"aggregate(transform(regexp_extract_all({cigar}, '([0-9]+)[MDN=X]', 1), x -> cast(x as int)), 0, (a, x) -> a + x)")


def md_length(md: str = "md") -> Column:
    """Reference length from an MD tag: matched runs and mismatched or deleted letters."""
    return F.expr(
        f"aggregate(transform(regexp_extract_all({md}, '([0-9]+)', 1), x -> cast(x as int)), 0, (a, x) -> a + x)"
        f" + char_length(regexp_replace({md}, '[^A-Za-z]', ''))"
    )


def unpack_cigar_op(packed: str) -> tuple[Column, Column]:
    """(length, operation letter) of a packed BAM operation."""
    c = F.col(packed)
    return F.shiftrightunsigned(c, 4), F.substring(F.lit("MIDNSHP=X"), c.bitwiseAND(15).cast("int") + 1, F.lit(1))


def fragment_borders(s1, e1, s2, e2) -> tuple[Column, Column]:
    return F.least(s1, e1, s2, e2), F.greatest(s1, e1, s2, e2)
