"""Text formats as DataFrames: SAM, region lists, GFF, FASTA, FASTQ, VCF and TSV datasets.

Readers take a path (or a DataFrame with a ``value`` column, one line a row) and only use native
functions; lines that don't fit come out as nulls in permissive mode and stop the query in failfast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from readloom.functions.cigar import query_len
from readloom.functions.flags import has
from readloom.schema import FLAG_LETTERS, READ1, READ2, REVERSE, UNMAP
from readloom.functions.seq import reverse_complement


def lines(spark: SparkSession, source: str | DataFrame) -> DataFrame:
    return spark.read.text(source) if isinstance(source, str) else source.select("value")


def _flag(text: Column) -> Column:
    """A flag in decimal, hexadecimal, octal or letters."""
    by_letter = F.lit(0)
    for i, c in enumerate(FLAG_LETTERS):
        by_letter = by_letter + F.when(F.instr(text, c) > 0, 1 << i).otherwise(0)
    return (
        F.when(text.rlike("^0[xX][0-9A-Fa-f]+$"), F.conv(F.substring(text, 3, 8), 16, 10).cast("int"))
        .when(text.rlike("^0[0-7]+$"), F.conv(text, 8, 10).cast("int"))
        .when(text.rlike("^[0-9]+$"), F.expr("try_cast(__f[1] as int)"))
        .otherwise(by_letter)
    )


def flag_of(value: Column) -> Column:
    """The flag of a text in decimal, hexadecimal, octal or letters."""
    by_letter = F.lit(0)
    for i, c in enumerate(FLAG_LETTERS):
        by_letter = by_letter + F.when(F.instr(value, c) > 0, 1 << i).otherwise(0)
    digits = lambda pattern, base: F.when(value.rlike(pattern), F.conv(F.regexp_replace(value, "^0[xX]", ""), base, 10).cast("int"))
    return F.coalesce(digits("^0[xX][0-9A-Fa-f]+$", 16), digits("^0[0-7]+$", 8), digits("^[0-9]+$", 10), by_letter)


def flag_text(flag: Column | str, style: str = "decimal") -> Column:
    """A flag in decimal, ``hex`` or ``letters``."""
    f = F.col(flag) if isinstance(flag, str) else flag
    if style == "hex":
        return F.concat(F.lit("0x"), F.lower(F.hex(f)))
    if style == "letters":
        return F.concat(*[F.when(f.bitwiseAND(F.lit(1 << i)) != 0, c).otherwise("") for i, c in enumerate(FLAG_LETTERS)])
    return f.cast("string")


def read_contig_list(spark: SparkSession, source: str | DataFrame) -> DataFrame:
    """(name, len) of the lines of a sequence index or of any list of names and lengths."""
    f = F.split("value", r"\s+")
    x = lines(spark, source).where(F.trim("value") != "")
    return x.select(F.get(f, 0).alias("name"), F.expr("try_cast(get(split(value, '\\\\s+'), 1) as int)").alias("len")).where("len is not null")


#: fixed values: the tags a header line needs, and those it may have besides
HEADER_TAGS = {
    "HD": ("VN", "SO GO"), "SQ": ("SN LN", "AS M5 UR SP"), "RG": ("ID", "CN DS DT FO KS LB PG PI PL PU SM"), "PG": ("ID", "PN VN CL PP"),
}


def validate_header(header: DataFrame) -> DataFrame:
    """The header lines with the tags they lack (``missing``) and those their kind doesn't know (``unknown``), by commas; free text is always right."""
    names = F.coalesce(F.map_keys("tags"), F.array().cast("array<string>"))
    missing, unknown = F.lit(""), F.lit("")
    for kind, (need, may) in HEADER_TAGS.items():
        need, may = need.split(), may.split()
        lack = F.array_join(F.array_except(F.array(*map(F.lit, need)), names), ",")
        odd = F.array_join(F.array_sort(F.filter(names, lambda n: ~n.isin(*need, *may) & ~n.rlike("[a-z]"))), ",")  # noqa: B023
        missing, unknown = F.when(F.col("kind") == kind, lack).otherwise(missing), F.when(F.col("kind") == kind, odd).otherwise(unknown)
    return header.select("kind", "line", missing.alias("missing"), unknown.alias("unknown"))


def read_sam(spark: SparkSession, source: str | DataFrame, mode: str = "permissive") -> DataFrame:
    """Alignment records: 0-based pos and pnext, ``=`` resolved, aux tags as a map of (type, value).

    A mapped record without a CIGAR becomes unmapped. A record with fewer than 11 columns or whose
    CIGAR does not fit its sequence has ``valid`` false, or raises in failfast mode.
    """
    x = lines(spark, source).where(~F.col("value").startswith("@") & (F.col("value") != ""))
    x = x.withColumn("__f", F.split("value", "\t"))
    at = lambda i: F.expr(f"get(__f, {i})")
    integer = lambda i: F.expr(f"try_cast(get(__f, {i}) as int)")
    flag = _flag(at(1))
    aux = F.map_from_entries(
        F.transform(
            F.filter(F.slice("__f", F.lit(12), F.greatest(F.size("__f") - 11, F.lit(0))), lambda t: t.rlike("^[A-Za-z][A-Za-z0-9]:[AcCsSiIfdZHB]:")),
            lambda t: F.struct(F.substring(t, 1, 2).alias("key"), F.struct(F.substring(t, 4, 1).alias("type"), F.substring(t, F.lit(6), F.length(t)).alias("value"))),
        )
    )
    fits = (F.size("__f") >= 11) & ((at(5) == "*") | (at(9) == "*") | (query_len(at(5)) == F.length(at(9))))
    x = x.select(
        at(0).alias("qname"), F.when((at(5) == "*") & ~has(flag, UNMAP), flag + UNMAP).otherwise(flag).alias("flag"), at(2).alias("rname"), (integer(3) - 1).alias("pos"),
        F.coalesce(integer(4), F.lit(0)).alias("mapq"), at(5).alias("cigar"), F.when(at(6) == "=", at(2)).otherwise(at(6)).alias("rnext"), (integer(7) - 1).alias("pnext"),
        integer(8).alias("tlen"), at(9).alias("seq"), at(10).alias("qual"), aux.alias("aux"), F.coalesce(fits, F.lit(False)).alias("valid"),
    )
    if mode == "failfast":
        x = x.withColumn("valid", F.when(F.col("valid"), True).otherwise(F.raise_error(F.concat(F.lit("malformed record "), F.coalesce("qname", F.lit("?"))))))
    return x


def read_sam_header(spark: SparkSession, source: str | DataFrame) -> DataFrame:
    """(kind, tags, line): the kind of a header line and its tags."""
    x = lines(spark, source).where(F.col("value").startswith("@"))
    f = F.split("value", "\t")
    tags = F.map_from_entries(F.transform(F.filter(F.slice(f, F.lit(2), F.size(f)), lambda t: F.instr(t, ":") == 3), lambda t: F.struct(F.substring(t, 1, 2), F.substring(t, F.lit(4), F.length(t)))))
    return x.select(F.substring("value", 2, 2).alias("kind"), F.when(F.substring("value", 2, 2) != "CO", tags).alias("tags"), F.col("value").alias("line"))


def contigs_of(header: DataFrame) -> DataFrame:
    """(name, len) of the sequence lines."""
    return header.where("kind = 'SQ'").select(F.col("tags")["SN"].alias("name"), F.expr("try_cast(tags['LN'] as int)").alias("len"))


def merge_headers(a: DataFrame, b: DataFrame) -> DataFrame:
    """Lines of two headers, equal ones once. Lines of one kind and name that differ have ``conflict``."""
    name = F.coalesce(F.col("tags")["SN"], F.col("tags")["ID"], F.lit(""))
    x = a.unionByName(b).select("kind", name.alias("name"), "line").distinct()
    n = F.count(F.lit(1)).over(Window.partitionBy("kind", "name"))
    return x.withColumn("conflict", F.col("kind").isin("SQ", "RG", "PG") & (n > 1))


def format_sam(df: DataFrame) -> DataFrame:
    """Records back to lines (value): 1-based, ``=`` for the same contig, aux tags by name."""
    aux = F.array_join(F.transform(F.array_sort(F.map_entries("aux")), lambda e: F.concat(e["key"], F.lit(":"), e["value"]["type"], F.lit(":"), e["value"]["value"])), "\t")
    mate = F.when((F.col("rnext") == F.col("rname")) & (F.col("rname") != "*"), "=").otherwise(F.coalesce("rnext", F.lit("*")))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("*"))
    body = F.concat_ws(
        "\t", text("qname"), F.col("flag").cast("string"), text("rname"), (F.coalesce("pos", F.lit(-1)) + 1).cast("string"), F.col("mapq").cast("string"), text("cigar"),
        mate, (F.coalesce("pnext", F.lit(-1)) + 1).cast("string"), F.coalesce("tlen", F.lit(0)).cast("string"), text("seq"), text("qual"),
    )
    return df.select(F.when(F.size("aux") > 0, F.concat_ws("\t", body, aux)).otherwise(body).alias("value"))


def read_regions(spark: SparkSession, source: str | DataFrame) -> DataFrame:
    """(chrom, start, stop), half-open. A line with one number p is the base p, 1-based."""
    f = F.split(F.trim("value"), r"\s+")
    x = lines(spark, source).where(F.trim("value") != "").select(
        F.get(f, 0).alias("chrom"), F.expr("try_cast(get(split(trim(value), '\\\\s+'), 1) as int)").alias("b"), F.expr("try_cast(get(split(trim(value), '\\\\s+'), 2) as int)").alias("e")
    )
    end = F.when(F.col("e") >= F.col("b"), F.col("e"))
    start = F.when(end.isNull() & (F.col("b") > 0), F.col("b") - 1).otherwise(F.col("b"))
    x = x.select("chrom", start.alias("start"), F.coalesce(end, F.col("b")).alias("stop"))
    return x.where("start >= 0 and stop > start")


def read_gff(spark: SparkSession, source: str | DataFrame, base: int = 0) -> DataFrame:
    """Lines that begin with ``chr``: the nine columns, and the region as (chrom number, start, end),
    0-based and closed. ``base`` is taken from the number, 1 makes it a tid."""
    x = lines(spark, source).where(F.col("value").startswith("chr")).withColumn("__f", F.split("value", "\t"))
    names = ["seqname", "source", "feature", "start_text", "end_text", "score", "strand", "frame", "group"]
    x = x.select(*[F.get("__f", i).alias(n) for i, n in enumerate(names)])
    number = F.expr("try_cast(substring(seqname, 4, 10) as int)") - base
    return x.select(
        "seqname", "source", "feature", "score", "strand", "frame", "group", number.alias("chrom"),
        (F.expr("try_cast(start_text as int)") - 1).alias("start"), (F.expr("try_cast(end_text as int)") - 1).alias("end"),
    )


def read_dataset(spark: SparkSession, source: str | DataFrame) -> DataFrame:
    """(seq_id, chromosome, start, end, strand, num_errors, num_indels) of tab-separated lines."""
    f = [("seq_id", "string"), ("chromosome", "smallint"), ("start", "int"), ("end", "int"), ("strand", "smallint"), ("num_errors", "smallint"), ("num_indels", "smallint")]
    x = lines(spark, source).where("value <> ''").withColumn("__f", F.split("value", "\t"))
    return x.select(*[F.expr(f"try_cast(get(__f, {i}) as {t})").alias(n) for i, (n, t) in enumerate(f)])


def read_truth(spark: SparkSession, source: str | DataFrame) -> DataFrame:
    """(chromosome, start, end, strand, id) of the other layout; a strand other than 0 is 1."""
    x = lines(spark, source).where("value <> ''").withColumn("__f", F.split("value", "\t"))
    i = lambda k: F.expr(f"try_cast(get(__f, {k}) as int)")
    return x.select(F.get("__f", 0).alias("chromosome"), i(1).alias("start"), i(2).alias("end"), F.when(F.get("__f", 3) == "0", 0).otherwise(1).alias("strand"), F.get("__f", 4).alias("id"))


def format_dataset(df: DataFrame) -> DataFrame:
    return df.select(F.concat_ws("\t", *[F.col(c).cast("string") for c in ("seq_id", "chromosome", "start", "end", "strand", "num_errors", "num_indels")]).alias("value"))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(name, comment, seq). Records are split by the reader itself (`>` at a line start), so a record is one
    row however many lines it has and a file is read in parallel."""
    x = spark.read.option("lineSep", "\n>").text(path)
    x = x.select(F.regexp_replace("value", "^>", "").alias("v")).where(F.trim("v") != "")
    head = F.regexp_extract("v", r"^([^\n]*)", 1)
    body = F.regexp_replace(F.substring(F.col("v"), F.length(head) + 2, F.length("v")), r"\s+", "")
    return x.select(F.regexp_extract(head, r"^(\S*)", 1).alias("name"), F.trim(F.regexp_extract(head, r"^\S*(.*)", 1)).alias("comment"), body.alias("seq"))


def read_vcf(spark: SparkSession, source: str | DataFrame, samples: list[str] | None = None) -> DataFrame:
    """(chrom, pos 0-based, id, ref, alt array, qual, filter, info map, samples array of maps).

    INFO flags have an empty value. ``samples`` keeps only the named ones, by the header line.
    """
    every = lines(spark, source)
    x = every.where(~F.col("value").startswith("#") & (F.col("value") != "")).withColumn("__f", F.split("value", "\t"))
    at = lambda i: F.expr(f"get(__f, {i})")
    info = F.map_from_entries(F.transform(F.filter(F.split(at(7), ";"), lambda t: (t != "") & (t != ".")), lambda t: F.struct(F.split(t, "=", 2)[0], F.coalesce(F.get(F.split(t, "=", 2), 1), F.lit("")))))
    keys = F.split(at(8), ":")
    columns = F.slice("__f", F.lit(10), F.greatest(F.size("__f") - 9, F.lit(0)))
    genos = F.transform(columns, lambda s: F.map_from_arrays(keys, F.transform(F.sequence(F.lit(1), F.size(keys)), lambda i: F.coalesce(F.get(F.split(s, ":"), i - 1), F.lit(".")))))
    x = x.select(
        at(0).alias("chrom"), (F.expr("try_cast(get(__f, 1) as int)") - 1).alias("pos"), F.when(at(2) != ".", at(2)).alias("id"), at(3).alias("ref"), F.split(at(4), ",").alias("alt"),
        F.expr("try_cast(get(__f, 5) as double)").alias("qual"), at(6).alias("filter"), info.alias("info"), F.when(F.size("__f") > 9, genos).otherwise(F.array().cast("array<map<string,string>>")).alias("samples"),
    )
    if samples is not None:
        head = every.where(F.col("value").startswith("#CHROM")).first()
        names = head["value"].split("\t")[9:] if head else []
        x = x.withColumn("samples", F.array(*[F.get("samples", names.index(s)) for s in samples]))
    return x


def to_fastq(df: DataFrame) -> DataFrame:
    """(name, seq, qual) of primary reads as they came from the machine: reverse reads turned back, ``/1`` or
    ``/2`` where exactly one of the end bits is set."""
    r1, r2, back = has("flag", READ1), has("flag", READ2), has("flag", REVERSE)
    name = F.when(r1 & ~r2, F.concat("qname", F.lit("/1"))).when(r2 & ~r1, F.concat("qname", F.lit("/2"))).otherwise(F.col("qname"))
    return df.select(name.alias("name"), F.when(back, reverse_complement("seq")).otherwise(F.col("seq")).alias("seq"), F.when(back, F.reverse("qual")).otherwise(F.col("qual")).alias("qual"))


def to_bed(df: DataFrame) -> DataFrame:
    """Lines chrom, start, end, name, quality, strand."""
    from readloom.functions.cigar import op_sum

    strand = F.when(has("flag", REVERSE), "-").otherwise("+")
    return df.where(~has("flag", UNMAP)).select(F.concat_ws("\t", "rname", F.col("pos").cast("string"), (F.col("pos") + op_sum("cigar", "MDN")).cast("string"), "qname", F.col("mapq").cast("string"), strand).alias("value"))
