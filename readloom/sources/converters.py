"""Lines of other aligners and archives as alignment records, and result rows as lines of a shell.

Converters take lines (value) and give (qname, flag, rname, pos 0-based, mapq, cigar, seq, qual, nm).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.functions.seq import reverse_complement

RECORD = ["qname", "flag", "rname", "pos", "mapq", "cigar", "seq", "qual", "nm"]


def _fields(lines: DataFrame, separator: str = "\t") -> DataFrame:
    return lines.where(F.trim("value") != "").withColumn("__f", F.split("value", separator))


def _at(i: int, kind: str = "string") -> Column:
    return F.expr(f"try_cast(get(__f, {i}) as {kind})")


def from_bowtie(lines: DataFrame) -> DataFrame:
    """name, strand, contig, offset, sequence, qualities, other places, mismatches (``offset:ref>read`` by commas)."""
    wrong = F.size(F.filter(F.split(F.coalesce(_at(7), F.lit("")), ","), lambda m: m.contains(">")))
    return _fields(lines).select(
        F.regexp_replace(_at(0), "/[12]$", "").alias("qname"),
        (F.when(_at(1) == "-", 16).otherwise(0) + F.when(_at(0).endswith("/1"), 65).when(_at(0).endswith("/2"), 129).otherwise(0)).alias("flag"),
        _at(2).alias("rname"), _at(3, "int").alias("pos"), F.when(_at(6, "int") == 0, 25).otherwise(0).alias("mapq"), F.concat(F.length(_at(4)).cast("string"), F.lit("M")).alias("cigar"),
        _at(4).alias("seq"), _at(5).alias("qual"), wrong.alias("nm"),
    )


def from_soap(lines: DataFrame) -> DataFrame:
    """name, sequence, qualities, hits, end, length, strand, contig, place 1-based, kind of mismatches."""
    end = _at(4)
    return _fields(lines).select(
        F.regexp_replace(_at(0), "/[12]$", "").alias("qname"), (F.when(_at(6) == "-", 16).otherwise(0) + F.when(end == "b", 128).when(end == "a", 64).otherwise(0)).alias("flag"),
        _at(7).alias("rname"), (_at(8, "int") - 1).alias("pos"), F.when(_at(3, "int") == 1, 30).otherwise(0).alias("mapq"), F.concat(_at(5), F.lit("M")).alias("cigar"),
        _at(1).alias("seq"), _at(2).alias("qual"), F.when(_at(9, "int") < 100, _at(9, "int")).otherwise(0).alias("nm"),
    )


def from_psl(lines: DataFrame) -> DataFrame:
    """The 21 columns of block alignments; between two blocks the query's space is inserted, the target's deleted, ends are clipped."""
    numbers = lambda i: F.transform(F.filter(F.split(_at(i), ","), lambda v: v != ""), lambda v: v.cast("int"))
    x = _fields(lines).where(F.size("__f") >= 21).select(
        _at(9).alias("qname"), _at(8).alias("strand"), _at(13).alias("rname"), _at(15, "int").alias("pos"), _at(10, "int").alias("size"), _at(1, "int").alias("nm"), (_at(5, "int") + _at(7, "int")).alias("gaps"),
        numbers(18).alias("n"), numbers(19).alias("q"), numbers(20).alias("t"),
    )
    text = lambda n, op: F.when(n > 0, F.concat(n.cast("string"), F.lit(op))).otherwise("")
    last = F.size("n") - 1

    def block(i: Column) -> Column:
        n, q, t = (F.get(c, i) for c in ("n", "q", "t"))
        gap = lambda c, own: F.coalesce(F.get(c, i + 1) - own - n, F.lit(0))
        return F.concat(text(n, "M"), text(gap("q", q), "I"), text(gap("t", t), "D"))

    body = F.array_join(F.transform(F.sequence(F.lit(0), last), block), "")
    cigar = F.concat(text(F.get("q", F.lit(0)), "H"), body, text(F.col("size") - F.get("q", last) - F.get("n", last), "H"))
    return x.select("qname", F.when(F.col("strand").startswith("-"), 16).otherwise(0).alias("flag"), "rname", "pos", F.lit(255).alias("mapq"), cigar.alias("cigar"), F.lit("*").alias("seq"), F.lit("*").alias("qual"), (F.col("nm") + F.col("gaps")).alias("nm"))


def from_novo(lines: DataFrame) -> DataFrame:
    """name, side, sequence, qualities, status, score, quality, contig, place 1-based, strand; only reads with one place count as sure."""
    side, back = _at(1), _at(9) == "R"
    placed = _at(4).isin("U", "R")
    seq, qual = _at(2), _at(3)
    return _fields(lines).where(~F.col("value").startswith("#")).select(
        F.regexp_replace(F.regexp_replace(_at(0), "^[@>]", ""), "/[12]$", "").alias("qname"),
        (F.when(~placed, 4).when(back, 16).otherwise(0) + F.when(side == "L", 65).when(side == "R", 129).otherwise(0)).alias("flag"),
        F.when(placed, F.regexp_replace(_at(7), "^>", "")).otherwise("*").alias("rname"), F.when(placed, _at(8, "int") - 1).otherwise(-1).alias("pos"), F.when(_at(4) == "U", F.coalesce(_at(6, "int"), F.lit(0))).otherwise(0).alias("mapq"),
        F.when(placed, F.concat(F.length(seq).cast("string"), F.lit("M"))).otherwise("*").alias("cigar"), F.when(placed & back, reverse_complement(seq)).otherwise(seq).alias("seq"), F.when(placed & back, F.reverse(qual)).otherwise(qual).alias("qual"),
        F.size(F.filter(F.split(F.coalesce(_at(13), F.lit("")), " "), lambda m: m.contains(">"))).alias("nm"),
    )


def read_groups(runs: DataFrame, experiments: DataFrame, samples: DataFrame) -> DataFrame:
    """Lines @RG (value) of archive records: ``runs`` (value: run XML) refer to ``experiments`` (value), which name the library; the sample is the alias of ``samples`` (value).

    One document a row; several elements in a document are several rows."""
    attribute = lambda c, element, name: F.regexp_extract(c, rf'(?is)<{element}\b[^>]*\b{name}="([^"]+)"', 1)
    parts = lambda df, element: df.select(F.explode(F.regexp_extract_all("value", F.lit(rf"(?is)(<{element}\b.*?</{element}>)"), F.lit(1))).alias("x"))
    r = parts(runs, "RUN").select(attribute("x", "RUN", "accession").alias("run"), attribute("x", "EXPERIMENT_REF", "accession").alias("exp"))
    e = parts(experiments, "EXPERIMENT").select(attribute("x", "EXPERIMENT", "accession").alias("exp"), F.trim(F.regexp_extract("x", r"(?is)<LIBRARY_NAME>\s*(\S+)\s*</LIBRARY_NAME>", 1)).alias("lib"), attribute("x", "SAMPLE_DESCRIPTOR", "refname").alias("sample"))
    s = parts(samples, "SAMPLE").select(attribute("x", "SAMPLE", "accession").alias("acc"), attribute("x", "SAMPLE", "alias").alias("alias"))
    x = r.join(e, "exp", "left").join(s, F.col("sample") == F.col("acc"), "left")
    name = lambda c, d: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(d))
    return x.select(F.concat(F.lit("@RG\tID:"), "run", F.lit("\tSM:"), name("alias", "UNKNOWN"), F.lit("\tLB:"), name("lib", "")).alias("value"))


def from_hapmap(genotypes: DataFrame, positions: DataFrame) -> DataFrame:
    """(chrom, pos, id, ref, alt, gt array) of genotype rows (rs, alleles ``A/C``, calls array of two letters) at the places of known
    sites (rs, chrom, pos 1-based, ref). Sites with other than two single-base alleles, without the reference base or with a call of a third base
    are left out; ``NN`` is ``./.``."""
    x = genotypes.where(F.length("alleles") == 3).join(positions, "rs")
    a, b = F.substring("alleles", 1, 1), F.substring("alleles", 3, 1)
    x = x.withColumn("__alt", F.when(a == F.col("ref"), b).when(b == F.col("ref"), a)).where("__alt is not null")
    code = lambda c: F.when(c == F.col("ref"), "0").when(c == F.col("__alt"), "1")
    gt = F.transform("calls", lambda g: F.when(g == "NN", "./.").otherwise(F.concat(code(F.substring(g, 1, 1)), F.lit("/"), code(F.substring(g, 2, 1)))))
    x = x.withColumn("gt", gt).where(~F.exists("gt", lambda g: g.isNull()))
    return x.select("chrom", "pos", F.col("rs").alias("id"), "ref", F.col("__alt").alias("alt"), "gt")


def from_ucsc(lines: DataFrame) -> DataFrame:
    """(chrom, pos 1-based, id, ref, alt, info) of known-site lines (bin, chrom, start, end, name, score, strand, reference, reference, observed
    alleles by ``/``, molecule, class, validated, average). Observed alleles of the other strand are turned round. Where they aren't all single bases, all
    alleles stand behind a base N and the place is that of this base."""
    x = _fields(lines).select(*[_at(i).alias(f"f{i}") for i in range(14)])
    observed = F.when(F.col("f6") == "-", F.translate(F.reverse("f9"), "ACGTRYMKWSNacgtrymkwsn", "TGCAYRKMWSNtgcayrkmwsn")).otherwise(F.col("f9"))
    indel = ~F.col("f9").rlike("^[ACGT](/[ACGT])+$")
    form = lambda a: F.when(indel, F.concat(F.lit("N"), F.replace(a, F.lit("-"), F.lit("")))).otherwise(a)
    others = F.transform(F.filter(F.split(observed, "/"), lambda a: a != F.col("f7")), form)
    share = F.expr("try_cast(f13 as double)")
    info = F.concat(
        F.lit("molType="), "f10", F.lit(";class="), "f11", F.when(F.col("f12") == "unknown", "").otherwise(F.concat(F.lit(";valid="), "f12")), F.when(share > 0, F.concat(F.lit(";AF="), "f13")).otherwise("")
    )
    pos = F.expr("try_cast(f2 as int)") + F.when(indel, 0).otherwise(1)
    return x.select(F.col("f1").alias("chrom"), pos.alias("pos"), F.col("f4").alias("id"), form(F.col("f7")).alias("ref"), F.array_join(others, ",").alias("alt"), info.alias("info"))


# --- rows as lines ------------------------------------------------------------------------------


def render(df: DataFrame, mode: str, table: str = "table", separator: str = "|", null: str = "") -> DataFrame:
    """Lines (value) of the rows: ``list`` by separator, ``csv`` quoted where needed, ``tabs``, ``line`` one ``name = value`` a column, ``column`` padded to
    ten characters, ``html`` table rows, ``insert`` statements, ``tcl`` quoted strings, ``json``. Native expressions, one row in, one row out."""
    names = df.columns
    text = [F.col(f"`{c}`").cast("string") for c in names]
    plain = [F.coalesce(t, F.lit(null)) for t in text]
    quote = lambda t: F.concat(F.lit('"'), F.regexp_replace(t, '"', '""'), F.lit('"'))
    escape = lambda t: F.replace(F.replace(F.replace(F.replace(t, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    numeric = {f.name for f in df.schema if f.dataType.simpleString().split("(")[0] in ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")}
    wide = max(map(len, names), default=0)
    if mode == "list":
        value = F.concat_ws(separator, *plain)
    elif mode == "tabs":
        value = F.concat_ws("\t", *plain)
    elif mode == "csv":
        value = F.concat_ws(",", *[F.when(t.rlike("[\"',\\s]"), quote(t)).otherwise(t) for t in plain])
    elif mode == "line":
        value = F.concat_ws("\n", *[F.concat(F.lit(f"{c:>{wide}} = "), t) for c, t in zip(names, plain)])
    elif mode == "column":
        value = F.rtrim(F.concat_ws("  ", *[F.rpad(t, 10, " ") for t in plain]))
    elif mode == "html":
        value = F.concat(F.lit("<TR>"), *[F.concat(F.lit("<TD>"), escape(t), F.lit("</TD>\n")) for t in plain], F.lit("</TR>"))
    elif mode == "insert":
        one = [F.coalesce(t if c in numeric else F.concat(F.lit("'"), F.replace(t, F.lit("'"), F.lit("''")), F.lit("'")), F.lit("NULL")) for c, t in zip(names, text)]
        value = F.concat(F.lit(f"INSERT INTO {table} VALUES("), F.concat_ws(",", *one), F.lit(");"))
    elif mode == "tcl":
        value = F.concat_ws(" ", *[F.concat(F.lit('"'), F.regexp_replace(t, r'(["\\])', r"\\$1"), F.lit('"')) for t in plain])
    elif mode == "json":
        value = F.to_json(F.struct(*[F.col(f"`{c}`") for c in names]))
    else:
        raise ValueError(f"no mode {mode}")
    return df.select(value.alias("value"))
