import pytest
from pyspark.sql import functions as F

from readloom.functions import cigar as C
from readloom.sources import bam, fastq, text

TOY = """@HD\tVN:1.4
@SQ\tSN:ref\tLN:45
@SQ\tSN:ref2\tLN:40
@RG\tID:a\tSM:s
@CO\tfree text
r001\t163\tref\t7\t30\t8M4I4M1D3M\t=\t37\t39\tTTAGATAAAGAGGATACTG\t*\tXX:B:S,12561,2,20,112
r002\t0\tref\t9\t30\t1S2I6M1P1I1P1I4M2I\t*\t0\t0\tAAAAGATAAGGGATAAA\t*
r003\t0\tref\t9\t30\t5H6M\t*\t0\t0\tAGCTAA\t*
r004\t0\tref\t16\t30\t6M14N1I5M\t*\t0\t0\tATAGCTCTCAGC\t*
r003\t16\tref\t29\t30\t6H5M\t*\t0\t0\tTAGGC\t*
r001\t83\tref\t37\t30\t9M\t=\t7\t-39\tCAGCGCCAT\t*
x3\t0\tref2\t6\tx\t9M4I13M\t*\t0\t0\tttataaaacAAATaattaagtctaca\t??????????????????????????
u1\t0x4\t*\t0\t0\t*\t*\t0\t0\tACGT\tIIII\tNM:i:3\tZZ:Z:a:b
u2\tpR\tref\t1\t0\t*\t*\t0\t0\tAC\tII
bad\t0\tref\t1\t0\t5M\t*\t0\t0\tAC\tII"""


@pytest.fixture
def toy(spark):
    return spark.createDataFrame([(v,) for v in TOY.split("\n")], "value string")


def test_sam(spark, toy):
    rows = text.read_sam(spark, toy).collect()
    by = {(r["qname"], r["pos"]): r for r in rows}
    assert len(rows) == 10
    first = by["r001", 6]
    assert (first["flag"], first["rnext"], first["pnext"], first["tlen"]) == (163, "ref", 36, 39)
    assert first["aux"]["XX"]["type"] == "B" and first["aux"]["XX"]["value"] == "S,12561,2,20,112"
    assert by["x3", 5]["mapq"] == 0 and by["u1", -1]["flag"] == 4
    assert by["u1", -1]["aux"]["ZZ"]["value"] == "a:b"
    assert by["u2", 0]["flag"] == 1 + 0x20 + 4 or by["u2", 0]["flag"] & 4  # no CIGAR: unmapped
    assert [r["qname"] for r in rows if not r["valid"]] == ["bad"]
    with pytest.raises(Exception, match="malformed record bad"):
        text.read_sam(spark, toy, "failfast").collect()


def test_cigar_expectations(spark, toy):
    x = text.read_sam(spark, toy).where("valid and cigar <> '*'")
    got = {(r[0], r[1]): tuple(r)[2:] for r in x.select("qname", "pos", C.end_pos("pos", "cigar"), C.query_len("cigar"), C.mismatches("cigar")).collect()}
    assert got["r001", 6] == (22, 19, 5)
    assert got["r002", 8] == (18, 17, 6)
    assert got["r003", 8] == (14, 6, 0)
    assert got["r004", 15] == (40, 12, 1)
    assert got["x3", 5] == (27, 26, 4)


def test_sam_round_trip(spark, toy):
    x = text.read_sam(spark, toy).where("valid")
    again = text.read_sam(spark, text.format_sam(x.drop("valid")))
    assert sorted(map(str, again.collect())) == sorted(map(str, x.collect()))


def test_header(spark, toy):
    h = text.read_sam_header(spark, toy)
    assert [tuple(r) for r in text.contigs_of(h).collect()] == [("ref", 45), ("ref2", 40)]
    assert {r["kind"] for r in h.collect()} == {"HD", "SQ", "RG", "CO"}
    other = spark.createDataFrame([("@SQ\tSN:ref\tLN:46",), ("@SQ\tSN:ref2\tLN:40",)], "value string")
    m = text.merge_headers(h, text.read_sam_header(spark, other)).where("conflict").collect()
    assert sorted(r["line"] for r in m) == ["@SQ\tSN:ref\tLN:45", "@SQ\tSN:ref\tLN:46"]


def test_regions_gff_dataset(spark):
    frame = lambda *v: spark.createDataFrame([(x,) for x in v], "value string")
    got = text.read_regions(spark, frame("chr1\t10\t20\tx", "chr1 15", "chr2\t5\t3", "chr3\tx\t9", "", "chr4\t0\t1", "chr5\t0")).collect()
    assert sorted(map(tuple, got)) == [("chr1", 10, 20), ("chr1", 14, 15), ("chr2", 4, 5), ("chr4", 0, 1)]
    g = text.read_gff(spark, frame("chr7\ts\tf\t11\t20\t.\t+\t.\tg", "#x", "scaffold\ts\tf\t1\t2\t.\t+\t.\tg")).collect()
    assert [(r["chrom"], r["start"], r["end"], r["group"]) for r in g] == [(7, 10, 19, "g")]
    ids = ["ERR016352.12652484"] * 2 + ["ERR013140.29870779"] * 2 + ["ERR016352.5879221"] + ["ERR013140.17779867"] * 2
    raw = [f"{i}\t20\t{60070 + k}\t{60178 + k}\t1\t1\t{k}" for k, i in enumerate(ids)]
    d = text.read_dataset(spark, frame(*raw))
    assert [r["seq_id"] for r in d.orderBy("seq_id", "num_indels").collect()] == [
        "ERR013140.17779867", "ERR013140.17779867", "ERR013140.29870779", "ERR013140.29870779", "ERR016352.12652484", "ERR016352.12652484", "ERR016352.5879221",
    ]
    assert sorted(r[0] for r in text.format_dataset(d).collect()) == sorted(raw)
    t = text.read_truth(spark, frame("chr1\t5\t9\t0\tr1", "chr1\t5\t9\t-\tr2")).collect()
    assert [r["strand"] for r in t] == [0, 1]


def test_fasta_fastq_vcf(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">ref first one\nACGT\nAC\n>ref2\nGG\n\n>empty\n")
    got = [tuple(r) for r in text.read_fasta(spark, str(tmp_path / "a.fa")).collect()]
    assert got == [("ref", "first one", "ACGTAC"), ("ref2", "", "GG"), ("empty", "", "")]
    (tmp_path / "a.fq").write_text("@r1 x\nACG\n+\n@II\n@r2\nT\n+\nI\n")
    assert [tuple(r) for r in fastq.read_fastq(spark, str(tmp_path / "a.fq")).collect()] == [("r1", "ACG", "@II"), ("r2", "T", "I")]
    vcf = ["##x", "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\ts2", "c1\t10\t.\tA\tC,G\t30.5\tPASS\tDP=4;INDEL;AF=0.1,0.2\tGT:PL\t0/1:1,2,3\t1/1", "c1\t11\trs1\tA\tT\t.\t.\t."]
    frame = spark.createDataFrame([(v,) for v in vcf], "value string")
    a, b = text.read_vcf(spark, frame).orderBy("pos").collect()
    assert (a["pos"], a["id"], a["alt"], a["qual"], a["info"]) == (9, None, ["C", "G"], 30.5, {"DP": "4", "INDEL": "", "AF": "0.1,0.2"})
    assert a["samples"] == [{"GT": "0/1", "PL": "1,2,3"}, {"GT": "1/1", "PL": "."}]
    assert b["samples"] == [] and b["qual"] is None and b["info"] == {}
    assert text.read_vcf(spark, frame, ["s2"]).orderBy("pos").first()["samples"] == [{"GT": "1/1", "PL": "."}]


def test_fastq_and_bed_of_alignments(spark, toy):
    x = text.read_sam(spark, toy).where("valid")
    fq = {r["name"]: (r["seq"], r["qual"]) for r in text.to_fastq(x).collect()}
    assert fq["r001/1"] == ("ATGGCGCTG", "*") and fq["r001/2"][0] == "TTAGATAAAGAGGATACTG"
    assert "ref\t6\t22\tr001\t30\t+" in [r[0] for r in text.to_bed(x).collect()]


def test_bam_round_trip(spark, tmp_path):
    bam.register(spark)
    rows = spark.range(6000).select(
        F.concat(F.lit("read"), "id").alias("qname"), (F.col("id") % 1024).cast("int").alias("flag"), (F.col("id") % 3 - 1).cast("int").alias("tid"),
        (F.col("id") * 7 - 1).cast("int").alias("pos"), (F.col("id") % 60).cast("int").alias("mapq"), F.when(F.col("id") % 5 == 0, "*").otherwise("3M1I2S").alias("cigar"),
        F.lit(-1).alias("mtid"), F.lit(-1).alias("mpos"), (-F.col("id")).cast("int").alias("isize"), F.when(F.col("id") % 7 == 0, "*").otherwise("ACGTNR").alias("seq"),
        F.when(F.col("id") % 7 == 0, "*").otherwise("!I5+#A").alias("qual"),
        F.create_map(F.lit("NM"), F.concat(F.lit("i:"), F.col("id").cast("string")), F.lit("ZZ"), F.lit("Z:a:b"), F.lit("BB"), F.lit("B:s,1,-2"), F.lit("AA"), F.lit("A:x")).alias("aux"),
    )
    out = str(tmp_path / "x")
    rows.repartition(2).write.format("bam").option("contigs", "c1:100000,c2:100000").option("header", "@HD\tVN:1.4").mode("append").save(out)
    assert bam.read_bam_header(f"{out}/part-00000.bam") == ("@HD\tVN:1.4", [("c1", 100000), ("c2", 100000)])
    plain = lambda df: sorted(str((*tuple(r)[:-1], sorted(r["aux"].items()))) for r in df.collect())
    want = plain(rows)
    assert plain(spark.read.format("bam").load(out)) == want
    small = spark.read.format("bam").option("splitbytes", "20000").load(out)  # many ranges a file
    assert small.rdd.getNumPartitions() > 4
    assert plain(small) == want
