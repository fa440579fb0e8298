"""Modes and parameters of a profile."""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import Enum


class RunMode(Enum):
    """What reads are counted on: (overlap with regions needed, unannotated reads reported)."""

    GENE = (False, False)
    DOMAIN = (True, False)
    SMALL_GENOME = (True, True)

    @classmethod
    def parse(cls, name: str) -> RunMode:
        key = name.strip().upper().removesuffix("S")
        if key not in cls.__members__:
            raise ValueError(f"unknown run mode: {name}")
        return cls[key]

    @property
    def overlap_required(self) -> bool:
        return self.value[0]

    @property
    def report_unannotated(self) -> bool:
        return self.value[1]


class AmbigMode(Enum):
    """(ambiguous reads kept, secondary alignments kept, share divided by the number of alternatives)."""

    ONE_OVER_N = "1overN"
    ALL1 = "all1"
    PRIMARY_ONLY = "primary_only"
    UNIQUE_ONLY = "unique_only"

    @property
    def allow_ambiguous(self) -> bool:
        return self is not AmbigMode.UNIQUE_ONLY

    @property
    def allow_secondary(self) -> bool:
        return self in (AmbigMode.ONE_OVER_N, AmbigMode.ALL1)

    @property
    def divides(self) -> bool:
        return self is AmbigMode.ONE_OVER_N


class RgPolicy(Enum):
    INFER = "infer"  # no read group: single or paired by the flag
    STRICT = "strict"  # no read group, or two in one read: an error


class Overlap(Enum):
    SMALL_GENOME = "small_genome"
    DOMAIN = "domain"
    EXACT = "exact"
    HALF_OPEN = "half_open"


class Scaling(Enum):
    PER_REGION = "per_region"
    PER_FEATURE = "per_feature"


METRICS = ("raw", "lnorm", "scaled", "rpkm")


@dataclass(frozen=True)
class ProfileConfig:
    mode: RunMode = RunMode.GENE
    ambiguity: AmbigMode = AmbigMode.ONE_OVER_N
    min_seqlen: int = 45
    min_identity: float = 0.97
    paired_end_count: int = 1
    unmarked_orphans: bool = False
    strand_specific: bool = False
    gene_group_db: bool = False
    rg_policy: RgPolicy = RgPolicy.INFER
    ambiguous_by: str = "secondary"  # or "mapq"
    overlap: Overlap | None = None
    scaling: Scaling = Scaling.PER_REGION
    restrict_metrics: tuple[str, ...] = ("raw", "lnorm", "scaled")
    report_unseen: bool = True
    gene_key: str = "featureid"  # or "contig"
    exact_sums: bool = False
    inputs: dict[str, tuple[str, ...]] = field(default_factory=dict)
    reference: str | None = None
    aligner: str | None = None

    def __post_init__(self):
        bad = sorted(set(self.restrict_metrics) - set(METRICS))
        if bad:
            raise ValueError(f"unknown metrics: {bad}")
        if self.paired_end_count not in (1, 2):
            raise ValueError("paired_end_count is 1 or 2")
        if self.inputs:
            kinds = [k for k in ("bam", "sam", "fastq", "gene_counts") if self.inputs.get(k)]
            if len(kinds) != 1:
                raise ValueError("exactly one of bam, sam, fastq and gene_counts is needed")
            if kinds == ["fastq"] and not (self.aligner and self.reference):
                raise ValueError("fastq needs an aligner and a reference")
            if kinds != ["fastq"] and (self.aligner or self.reference):
                raise ValueError("aligner and reference go with fastq only")
            if kinds == ["gene_counts"] and self.strand_specific:
                raise ValueError("external counts have no strands")
        if self.ambiguous_by not in ("secondary", "mapq"):
            raise ValueError("ambiguous_by is secondary or mapq")

    @property
    def overlap_rule(self) -> Overlap:
        return self.overlap or (Overlap.DOMAIN if self.mode is RunMode.DOMAIN else Overlap.SMALL_GENOME)


def bind_reads(fwd=(), rev=(), single=(), orphans=(), exists=None) -> list[tuple[str, tuple[str, ...]]]:
    """Read sets for an aligner: pairs need as many forward as reverse files; either alone is single-end."""
    for f in (*fwd, *rev, *single, *orphans):
        if exists and not exists(f):
            raise ValueError(f"no such file: {f}")
    out: list[tuple[str, tuple[str, ...]]] = []
    if fwd and rev:
        if len(fwd) != len(rev):
            raise ValueError("forward and reverse files differ in number")
        out += [("paired", pair) for pair in zip(fwd, rev)]
    elif fwd or rev:
        out += [("single", (f,)) for f in fwd or rev]
    out += [("single", (f,)) for f in single]
    out += [("orphan", (f,)) for f in orphans]
    if not out:
        raise ValueError("no reads")
    return out


def aligner_command(aligner: str, reference: str, kind: str, files: tuple[str, ...], threads: int = 1) -> list[str]:
    """Command whose standard output is SAM text; read group 1 marks single-end reads, 2 all others."""
    group = f"@RG\\tID:{1 if kind == 'single' else 2}\\tSM:sample"
    if aligner == "bwa":
        return ["bwa", "mem", "-v", "1", "-a", "-t", str(threads), "-R", group, reference, *files]
    if aligner == "minimap2":
        return ["minimap2", "-x", "sr", "--secondary=yes", "-a", "-t", str(threads), "--split-prefix", "mm2_split", "-R", group, reference, *files]
    raise ValueError(f"unknown aligner: {aligner}")


def missing_index_files(aligner: str, reference: str, exists) -> list[str]:
    need = [reference + x for x in (".amb", ".ann", ".bwt", ".pac", ".sa")] if aligner == "bwa" else [reference if reference.endswith(".mmi") else reference + ".mmi"]
    return [f for f in need if not exists(f)]
