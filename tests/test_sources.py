"""File formats: round trips and small files."""

import gzip
import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from alnquant.functions import sam as S
from alnquant.operators import collate, report, store
from alnquant.sources import annotations as A
from alnquant.sources import bam, counts, sam, sqlite_store

SAM = "@HD\tVN:1.6\n@SQ\tSN:g1\tLN:100\n@SQ\tSN:g2\tLN:200\nr1\t0\tg1\t5\t60\t5S40M2I3D10M\t*\t0\t0\tACGT\tIIII\tNM:i:3\tRG:Z:1\tMD:Z:40^AC10\nr2\t4\t*\t0\t0\t*\t*\t0\t0\t*\t*\n"


def write(path, text, zipped=False):
    with (gzip.open(path, "wt") if zipped else open(path, "w")) as f:
        f.write(text)
    return str(path)


@pytest.mark.parametrize("zipped", [False, True])
def test_sam(spark, tmp_path, zipped):
    p = write(tmp_path / ("a.sam.gz" if zipped else "a.sam"), SAM, zipped)
    rows = {r["qname"]: r for r in sam.read_sam(spark, p).withColumn("alen", S.ref_length()).withColumn("mdlen", S.md_length()).collect()}
    r = rows["r1"]
    assert (r["pos"], r["alen"], r["nm"], r["rg"], r["md"], r["tags"]["NM"], r["len_seq"]) == (4, 53, 3, 1, "40^AC10", "3", 4)
    assert r["mdlen"] == 52 and rows["r2"]["rg"] is None and rows["r2"]["alen"] == 0
    assert sorted((x["refname"], x["reflength"]) for x in sam.read_references(spark, p).collect()) == [("g1", 100), ("g2", 200)]


def test_bam_split_over_partitions(spark, tmp_path):
    rng = random.Random(1)
    rows = [
        {"qname": f"read{i}", "flag": rng.choice([0, 16, 256]), "rid": rng.randint(0, 1), "pos": rng.randint(0, 1000), "cigar": f"{rng.randint(10, 90)}M2D5M", "tags": {"NM": rng.randint(0, 9), "RG": "2", "ZF": 0.5, "ZB": [1, 2, 3]}}
        for i in range(4000)
    ]
    p = str(tmp_path / "x.bam")
    bam.write_bam(p, [("g1", 5000), ("g2", 6000)], rows, "@HD\tVN:1.6\n", block=7000)
    for size in (1 << 26, 3000):
        df = bam.read_bam(spark, p, splitSize=size)
        got = sorted((r["qname"], r["flag"], r["rid"], r["pos"], r["cigar"], r["nm"], r["rg"]) for r in df.collect())
        assert got == sorted((r["qname"], r["flag"], r["rid"], r["pos"], r["cigar"], r["tags"]["NM"], 2) for r in rows)
        assert (df.rdd.getNumPartitions() > 5) == (size == 3000)
    one = df.where("qname = 'read0'").first()
    assert one["tags"]["ZB"] == "1,2,3" and one["refname"] in ("g1", "g2")
    assert bam.references(spark, p).count() == 2


def test_regions_and_genes(spark, tmp_path):
    bed = write(tmp_path / "a.bed", "g1\t0\t10\tf,g\ng1\t0\t10\th")  # no line end at the end
    r = A.read_regions(spark, bed).collect()
    assert [(x["seqid"], x["start_pos"], x["end_pos"], x["features"]) for x in r] == [("g1", 1, 10, ["f", "g", "h"])]
    hm = write(tmp_path / "a.csv", "seqid,start,end,x,f\ng1,3,9,z,pf1\n")
    assert A.read_regions(spark, hm, "hmmer", header=True).first()["features"] == ["pf1"]
    with pytest.raises(Exception):
        A.read_regions(spark, hm, "hmmer").collect()
    dom = write(tmp_path / "d.csv", "sequenceID,start,end,family\ng1,1,5,b\ng1,1,5,a\n")
    assert A.read_domains(spark, dom).first()["features"] == ["a", "b"]
    gff = write(tmp_path / "a.gff", "##gff\nk141_36810\tProdigal_v2.6.3\tCDS\t211\t366\t5.7\t-\t0\tID=1_1;partial=00\n")
    g = A.read_prodigal(spark, gff).first()
    assert (g["featureid"], g["start_pos"], g["end_pos"], g["strand"]) == ("k141_36810_1", 211, 366, 0)
    tab = write(tmp_path / "a.tsv", "## c\n#query\tCOG_category\teggNOG_OGs\tEC\nk141_36810_1\tCO\ta,b\t-\n")
    rows = {x["category"]: x["features"] for x in A.read_small_genome(spark, gff, tab).collect()}
    assert rows == {"COG_category": ["C", "O"], "COG_category_composite": ["CO"], "eggNOG_OGs": ["a,b"]}
    with pytest.raises(ValueError, match="no coordinates"):
        A.read_small_genome(spark, gff, write(tmp_path / "b.tsv", "#query\tEC\nother\t1.1\n"))


def test_gene_annotation_and_custom(spark, tmp_path):
    cols = [f"c{i}" for i in range(21)]
    cols[0], cols[9], cols[10], cols[6] = "gene1", "GO:1, GO:2", "-", "SS"
    t = A.read_emapper(spark, write(tmp_path / "e.tsv", "# c\n" + "\t".join(cols) + "\n")).collect()
    d = {r["category"]: r["features"] for r in t}
    assert d["GOs"] == ["GO:1", "GO:2"] and "EC" not in d and d["COG_cat"] == ["SS"]
    p = write(tmp_path / "c.tsv", "skip\n#gene\tA\tB\ng1\tx,y,x\t-\n")
    c = A.read_custom(spark, p, skip_lines=2).collect()
    assert [(r["seqid"], r["category"], r["features"]) for r in c] == [("g1", "A", ["x", "y"])]
    with pytest.raises(ValueError):
        A.read_custom(spark, p, columns=["Z"], skip_lines=2)
    s, f = A.read_annotation_strings(spark, write(tmp_path / "s.tsv", "id\tA\tseq\ng1\tx\tAC\ng2\tx\tGT\n"), "id", "seq", ["A"])
    assert s.count() == 1 and s.first()["annotation"] == "A=x" and sorted(r[0].split("\n")[1] for r in f.collect()) == ["AC", "GT"]


def test_store_codecs(spark, tmp_path):
    t = spark.createDataFrame([("s1", "b,a", "SS"), ("s2", "", "-")], "seqid string, K string, COG_category string")
    long = store.long_form(t, ["seqid"], ["K", "COG_category"])
    assert store.encode(long, ["seqid"]).first()["annotation"] == "COG_category=S,S;COG_category_composite=SS;K=a,b"
    back = store.decode(store.encode(long, ["seqid"]), ["seqid"])
    assert sorted((r["category"], r["features"]) for r in back.collect())[-1] == ("K", ["a", "b"])
    store.write_store(long, str(tmp_path / "st"))
    ann, codes = store.read_store(spark, str(tmp_path / "st"))
    assert sorted(r["feature_id"] for r in codes.collect()) == list(range(4)) and ann.count() == 3
    assert store.code_map(codes).count() == 3


def test_sqlite(spark, tmp_path):
    p = str(tmp_path / "a.sqlite3")
    c = sqlite3.connect(p)
    c.execute("create table category (id int, name text)")
    c.execute("create table feature (id int, name text, category_id int)")
    c.execute('create table annotatedsequence (id int, seqid text, featureid text, start int, "end" int, strand int, annotation_str text)')
    c.executemany("insert into category values (?, ?)", [(0, "A"), (1, "B")])
    c.executemany("insert into feature values (?, ?, ?)", [(0, "f", 0), (1, "g", 0), (2, "h", 1)])
    c.execute("insert into annotatedsequence values (1, 's', 'x', 1, 9, 1, '0=0,1;1=2')")
    c.commit()
    c.close()
    got = sqlite_store.convert(spark, p, str(tmp_path / "out")).collect()
    assert sorted((r["category"], r["features"]) for r in got) == [("A", ["f", "g"]), ("B", ["h"])]


def test_reports_collate(spark, tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    write(d / "s1.KEGG.txt.gz", "feature\tuniq_raw\tcombined_raw\ntotal_reads\t9\t9\nk1\t1\t2\n", True)
    write(d / "s2.KEGG.txt.gz", "feature\tuniq_raw\nk1\t3\nk2\t4\n", True)
    write(d / "s2.Counter.txt.gz", "x\n", True)
    long = counts.read_reports(spark, str(d))
    m = {r["feature"]: (r["s1"], r["s2"]) for r in collate.ordered(collate.matrix(long.where("category = 'KEGG'"), ["s1", "s2"], "combined_raw")).collect()}
    assert m == {"total_reads": (9.0, None), "k1": (2.0, 3.0), "k2": (None, 4.0)} and next(iter(m)) == "total_reads"
    t = spark.createDataFrame([("A", 1, "z", 0.5), ("A", 2, "b", 1.0), ("B", 1, "q", 2.0)], "category string, rank int, feature string, uniq_raw double")
    report.write_table(t, str(tmp_path / "rep"), by="category")
    back = spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "rep"))
    assert sorted((r["category"], r["feature"], r["uniq_raw"]) for r in back.collect()) == [("A", "b", "1.00000"), ("A", "z", "0.50000"), ("B", "q", "2.00000")]
    assert counts.read_count_total('{"n_reads": 7}') == 7 == counts.read_count_total("7")


def test_split_table(spark):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(["#a", "x", "y", "#b", "z"])], "line_no int, line string")
    assert [(r["category"], r["line"]) for r in collate.split_table(rows).orderBy("line_no").collect()] == [("a", "x"), ("a", "y"), ("b", "z")]


def test_streaming_counts_each_file_once(spark, tmp_path):
    from alnquant.streaming import ingest

    folder, out, cp = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "cp")
    folder.mkdir()
    line = "r{}\t0\tg1\t1\t60\t50M\t*\t0\t0\t*\t*\tNM:i:0\tRG:Z:1\n"
    write(folder / "a.sam", line.format(1) + line.format(2))
    ingest.start(spark, str(folder), out, cp).awaitTermination()
    write(folder / "b.sam", line.format(1))
    ingest.start(spark, str(folder), out, cp).awaitTermination()
    ingest.start(spark, str(folder), out, cp).awaitTermination()
    r = ingest.totals(spark, out).first()
    assert (r["rid"], r["uniq_raw"]) == ("g1", 3.0)


def test_header_after_many_comments(spark, tmp_path):
    path = tmp_path / "long.tsv"
    path.write_text("## note\n\n" * 300 + "#gene\tpf\ng1\tx\n")
    t = A.read_header_table(spark, str(path))
    assert t.columns == ["gene", "pf"] and [tuple(r) for r in t.collect()] == [("g1", "x")]
    path.write_text("## note\n" * 300)
    with pytest.raises(ValueError):
        A.read_header_table(spark, str(path))


def _sam_file(tmp_path):
    line = "{}\t{}\t{}\t{}\t60\t50M\t*\t0\t0\t*\t*\tNM:i:0"
    reads = [("a", 0, "g1", 1), ("b", 0, "g1", 11), ("b", 256, "g2", 1), ("c", 4, "*", 0), ("d", 16, "g2", 101), ("e", 0, "g3", 5)]
    text = "@SQ\tSN:g1\tLN:100\n@SQ\tSN:g2\tLN:200\n@SQ\tSN:g3\tLN:50\n" + "".join(line.format(*r) + "\n" for r in reads)
    return write(tmp_path / "reads.sam", text)


def test_report_of_sam_file(spark, tmp_path):
    from alnquant.config import ProfileConfig, RunMode
    from alnquant.operators import report as sink
    from alnquant.plans import profile

    path = _sam_file(tmp_path)
    ann = spark.createDataFrame([("g1", "KO", ["k1", "k2"]), ("g2", "KO", ["k1"]), ("g9", "KO", ["k9"])], "seqid string, category string, features array<string>")
    out = profile.report_of_files(spark, ProfileConfig(inputs={"sam": (path,)}), ann)
    rows = {r["feature"]: r for r in out.collect()}
    # read a: 1 on g1; b: 1/2 each on g1 and g2; d: 1 on g2; e has no annotation
    assert (rows["k1"]["uniq_raw"], rows["k1"]["combined_raw"]) == (2.0, 3.0)
    assert (rows["k2"]["uniq_raw"], rows["k2"]["combined_raw"], rows["k9"]["combined_raw"]) == (1.0, 1.5, 0.0)
    assert abs(rows["k1"]["combined_lnorm"] - (1.5 / 100 + 1.5 / 200)) < 1e-12
    assert (rows["total_reads"]["uniq_raw"], rows["filtered_reads"]["uniq_raw"], rows["category"]["combined_raw"]) == (4.0, 4.0, 3.0)
    regions = ann.where("seqid <> 'g9'").selectExpr("*", "1 start_pos", "60 end_pos")
    out = profile.report_of_files(spark, ProfileConfig(mode=RunMode.SMALL_GENOME, inputs={"sam": (path,)}), regions)
    rows = {r["feature"]: r for r in out.collect()}
    # d lies behind g2's region
    assert (rows["k1"]["uniq_raw"], rows["k1"]["combined_raw"], rows["k2"]["combined_raw"]) == (1.0, 2.0, 1.5)
    assert rows["unannotated"]["uniq_lnorm"] is None
    sink.write_table(out.drop("category"), str(tmp_path / "out"))
    lines = [r["value"].split("\t") for r in spark.read.text(str(tmp_path / "out")).collect()]
    head = next(x for x in lines if x[0] == "feature")
    assert next(x for x in lines if x[0] == "unannotated")[head.index("uniq_lnorm")] == "NA"


def test_report_of_external_counts(spark, tmp_path):
    from alnquant.config import ProfileConfig
    from alnquant.plans import profile

    p = write(tmp_path / "genes.txt", "gene\tuniq_raw\tuniq_lnorm\tcombined_raw\tcombined_lnorm\ng1\t2\t0.2\t3\t0.3\ng2\t1\t0.1\t1\t0.1\n")
    ann = spark.createDataFrame([("g1", "KO", ["k1"]), ("g2", "KO", ["k1", "k2"])], "seqid string, category string, features array<string>")
    rows = {r["feature"]: r for r in profile.report_of_files(spark, ProfileConfig(inputs={"gene_counts": (p,)}), ann).collect()}
    assert (rows["k1"]["uniq_raw"], rows["k1"]["combined_raw"], rows["k2"]["combined_raw"]) == (3.0, 4.0, 1.0)
    assert abs(rows["k1"]["combined_scaled"] - 4.0) < 1e-9 and "total_reads" not in rows


def test_strict_read_groups(spark):
    from alnquant.config import RgPolicy
    from alnquant.operators import weight

    ddl = "stream_id string, qname string, flag int, mapq int, rg int"
    for groups in ([1, 2], [None], [1, None]):
        d = weight.groups(spark.createDataFrame([("s", "a", 0, 60, g) for g in groups], ddl))
        with pytest.raises(Exception, match="read group"):
            weight.weighted(d, policy=RgPolicy.STRICT).collect()
    d = weight.groups(spark.createDataFrame([("s", "a", 1, 60, 2), ("s", "a", 1, 60, 2)], ddl))
    assert [r["contrib"] for r in weight.weighted(d, policy=RgPolicy.STRICT).collect()] == [0.5, 0.5]
