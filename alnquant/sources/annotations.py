"""Annotation files as long tables: keys, category, features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import store

#: columns of the gene annotation formats: index -> category, and the text of a missing value (fixed values)
EMAPPER = {
    "v1": ({5: "Gene_Ontology_terms", 6: "KEGG_ko", 7: "BiGG_Reaction", 9: "eggNOG_OGs", 11: "COG_Functional_Category"}, ""),
    "v2": (
        {6: "Gene_Ontology_terms", 7: "EC_number", 8: "KEGG_ko", 9: "KEGG_Pathway", 10: "KEGG_Module", 11: "KEGG_Reaction", 12: "KEGG_rclass",
         13: "BRITE", 14: "KEGG_TC", 15: "CAZy", 16: "BiGG_Reaction", 18: "eggNOG_OGs", 20: "COG_Functional_Category"},
        "",
    ),
    "v2.1.2": (
        {4: "eggNOG_OGs", 6: "COG_cat", 9: "GOs", 10: "EC", 11: "KEGG_ko", 12: "KEGG_Pathway", 13: "KEGG_Module", 14: "KEGG_Reaction",
         15: "KEGG_rclass", 16: "BRITE", 17: "KEGG_TC", 18: "CAZy", 19: "BiGG_Reaction", 20: "PFAMs"},
        "-",
    ),
}
#: categories of a small-genome annotation table (fixed values)
GENOME_COLUMNS = "eggNOG_OGs COG_category GOs EC KEGG_ko KEGG_Pathway KEGG_Module KEGG_Reaction KEGG_rclass BRITE KEGG_TC CAZy BiGG_Reaction PFAMs".split()


def _rows(spark: SparkSession, path, sep: str = "\t", comment: str = "#") -> DataFrame:
    t = spark.read.text(path).where(F.trim("value") != "")
    if comment:
        t = t.where(~F.col("value").startswith(comment))
    return t.select(F.split(F.regexp_replace("value", r"\r$", ""), sep if sep == "\t" else "\\Q" + sep + "\\E").alias("f"))


def read_emapper(spark: SparkSession, path, version: str = "v2.1.2") -> DataFrame:
    """seqid, category, features of a gene annotation table; items are trimmed."""
    columns, na = EMAPPER[version]
    pairs = []
    for i, category in columns.items():
        c = F.trim(F.coalesce(F.get("f", F.lit(i)), F.lit("")))
        items = F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x != "")
        pairs.append(F.struct(F.lit(category).alias("category"), F.when((c == "") | (c == na), F.array().cast("array<string>")).otherwise(F.array_distinct(items)).alias("features")))
    return _rows(spark, path).select(F.col("f")[0].alias("seqid"), F.explode(F.array(*pairs)).alias("p")).select("seqid", "p.*").where(F.size("features") > 0)


def read_regions(spark: SparkSession, path, kind: str = "bed", header: bool = False, category: str = "feature") -> DataFrame:
    """seqid, start_pos, end_pos (1-based, closed), category, features; intervals of several rows are one row."""
    cols, sep, shift = ((0, 1, 2, 3), "\t", 1) if kind == "bed" else ((0, 1, 2, 4), ",", 0) if kind == "hmmer" else ((0, 1, 2, 3), "\t", 0)
    f = _rows(spark, path, sep)
    a, b = F.get("f", F.lit(cols[1])), F.get("f", F.lit(cols[2]))
    r = f.select(F.col("f")[cols[0]].alias("seqid"), (a.try_cast("int") + shift).alias("start_pos"), b.try_cast("int").alias("end_pos"), F.explode(F.split(F.get("f", F.lit(cols[3])), ",")).alias("feature"))
    if header:
        r = r.where("start_pos is not null and end_pos is not null")
    else:
        r = r.withColumn("start_pos", F.coalesce("start_pos", F.raise_error(F.lit("a region without a numeric start")).cast("int")))
    g = r.where("feature <> ''").groupBy("seqid", "start_pos", "end_pos").agg(F.array_sort(F.collect_set("feature")).alias("features"))
    return g.select("seqid", "start_pos", "end_pos", F.lit(category).alias("category"), "features")


def read_domains(spark: SparkSession, path) -> DataFrame:
    """Domain table with the header sequenceID,start,end,family."""
    t = spark.read.csv(path, header=True)
    r = t.select(F.col("sequenceID").alias("seqid"), F.col("start").cast("int").alias("start_pos"), F.col("end").cast("int").alias("end_pos"), F.explode(F.split("family", ",")).alias("feature"))
    return r.groupBy("seqid", "start_pos", "end_pos").agg(F.lit("domain").alias("category"), F.array_sort(F.collect_set("feature")).alias("features"))


def read_gff3(spark: SparkSession, path) -> DataFrame:
    """seqid, source, type, start_pos, end_pos, strand, attributes of GFF3 lines."""
    f = _rows(spark, path).where(F.size("f") >= 9)
    attr = F.expr("map_from_entries(transform(filter(split(f[8], ';'), a -> instr(a, '=') > 1), a -> struct(trim(substring_index(a, '=', 1)) as k, array_sort(split(substring(a, instr(a, '=') + 1), ',')) as v)))")
    return f.select(F.col("f")[0].alias("seqid"), F.col("f")[1].alias("source"), F.col("f")[2].alias("type"), F.col("f")[3].cast("int").alias("start_pos"), F.col("f")[4].cast("int").alias("end_pos"), store.strand_code(F.col("f")[6]).alias("strand"), attr.alias("attributes"))


def read_prodigal(spark: SparkSession, path) -> DataFrame:
    """featureid, seqid, start_pos, end_pos, strand of gene predictions: the id is the contig and what follows the last
    underscore of the ID attribute."""
    g = read_gff3(spark, path)
    suffix = F.substring_index(F.col("attributes")["ID"][0], "_", -1)
    return g.select(F.concat_ws("_", "seqid", suffix).alias("featureid"), "seqid", "start_pos", "end_pos", "strand")


def read_header_table(spark: SparkSession, path, sep: str = "\t", header: list[str] | None = None, skip_lines: int = 0) -> DataFrame:
    """A delimited table; the header is the given one, or the first line after ``skip_lines - 1`` skipped ones (a leading #
    is dropped); ## lines and lines that start with # are comments."""
    if header is None:
        first, n = None, max(1, skip_lines) + 64
        while first is None:
            head = spark.read.text(path).limit(n).collect()
            lines = [r["value"] for r in head][max(0, skip_lines - 1) :]
            first = next((x for x in lines if x.strip() and not x.startswith("##")), None)
            if first is None and len(head) < n:
                raise ValueError("the file ends before its header")
            n *= 4
        header = first.strip().lstrip("#").split(sep)
        raw = _rows(spark, path, sep).where(F.array_join("f", sep) != F.lit(first.strip()))
        if skip_lines > 1:
            gone = [r["value"].strip() for r in head][: skip_lines - 1]
            raw = raw.where(~F.array_join("f", sep).isin(gone))
    else:
        raw = _rows(spark, path, sep)
    return raw.select(*[F.trim(F.get("f", F.lit(i))).alias(h) for i, h in enumerate(header)])


def read_custom(spark: SparkSession, path, columns: list[str] | None = None, sep: str = "\t", header: list[str] | None = None, skip_lines: int = 0, na: str = "-") -> DataFrame:
    """seqid, category, features of a custom table whose first column is the sequence."""
    t = read_header_table(spark, path, sep, header, skip_lines)
    names = t.columns
    lost = [c for c in columns or [] if c not in names]
    if lost:
        raise ValueError(f"columns that the header lacks: {lost}")
    return store.long_form(t.withColumnRenamed(names[0], "seqid"), ["seqid"], columns or names[1:], na)


def read_small_genome(spark: SparkSession, gff, table, columns: list[str] | None = None, check: bool = True) -> DataFrame:
    """seqid, featureid, start_pos, end_pos, strand, category, features: predicted genes with their annotation.  An
    annotated gene without coordinates is an error; genes without annotation don't appear."""
    genes, t = read_prodigal(spark, gff), read_header_table(spark, table)
    key = t.columns[0]
    t = t.withColumnRenamed(key, "featureid")
    use = [c for c in columns or GENOME_COLUMNS if c in t.columns]
    long = store.long_form(t, ["featureid"], use)
    if check:
        lost = long.join(genes, "featureid", "left_anti").select("featureid").limit(1).collect()
        if lost:
            raise ValueError(f"an annotated gene has no coordinates: {lost[0][0]}")
    return genes.join(long, "featureid")


def read_annotation_strings(spark: SparkSession, path, seqid: str, sequence: str, columns: list[str], sep: str = "\t", header: list[str] | None = None, na: str = "-") -> tuple[DataFrame, DataFrame]:
    """(distinct annotation strings by sha256, FASTA records whose names end in the hash)."""
    t = read_header_table(spark, path, sep, header)
    for c in (seqid, sequence, *columns):
        if c not in t.columns:
            raise ValueError(f"column {c} is not in the header")
    parts = []
    for c in columns:
        for name, f in store.category_features(c, F.col(c), na):
            parts.append(F.when(F.size(f) > 0, F.concat(F.lit(name + "="), F.array_join(F.array_sort(f), ","))))
    rows = t.select(F.col(seqid).alias("seqid"), F.col(sequence).alias("sequence"), F.concat_ws(";", *parts).alias("annotation"))
    strings, named = store.dedup_by_hash(rows, "annotation", ["seqid", "sequence"])
    return strings, store.fasta(named, "seqid", "sequence")


def build_store(spark: SparkSession, kind: str, path, out: str, **options) -> None:
    """Read one kind of annotation and write it as a store."""
    readers = {"gene": read_emapper, "custom": read_custom, "domain": read_domains, "bed": read_regions, "hmmer": read_regions}
    if kind in ("bed", "hmmer"):
        options["kind"] = kind
    store.write_store(readers[kind](spark, path, **options), out)
