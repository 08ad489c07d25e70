"""Alignment records, regions, sequences and likelihoods derived from the harness tables.

Every derivation is a list of expressions that Spark and DuckDB read alike, over whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from readloom.session import table

#: (name, expression) over lineitem: one alignment per row
ALN = [
    ("ord", "(((l_orderkey * 8 + l_linenumber) * 100000 + l_partkey) * 2000 + l_suppkey) * 64 + cast(l_quantity as bigint)"),
    ("qname", "concat('r', cast(l_orderkey as string))"),
    (
        "flag",
        "cast(1 + case when l_linenumber % 2 = 1 then 64 else 128 end + case when l_returnflag = 'R' then 16 else 0 end"
        " + case when l_linestatus = 'F' then 2 else 0 end + case when l_discount >= 0.095 then 1024 else 0 end"
        " + case when l_partkey % 17 = 0 then 4 else 0 end + case when l_partkey % 19 = 0 then 8 else 0 end"
        " + case when l_partkey % 23 = 0 then 512 else 0 end + case when l_suppkey % 2 = 0 then 32 else 0 end as int)",
    ),
    ("tid", "cast(case when l_partkey % 97 = 0 then -1 else (l_suppkey - 1) % 25 end as int)"),
    ("pos", "cast(l_partkey * 37 + l_linenumber * 11 as int)"),
    ("mapq", "cast(l_quantity as int)"),
    (
        "cigar",
        "case cast(l_partkey % 6 as int) when 0 then '50M' when 1 then '20M2I28M' when 2 then '10S40M' when 3 then '30M5D20M'"
        " when 4 then '25M100N25M' else '20=2X28=' end",
    ),
    ("mtid", "cast(case when l_partkey % 97 = 0 then -1 else (l_suppkey - 1 + case when l_linenumber % 3 = 0 then 1 else 0 end) % 25 end as int)"),
    ("mpos", "cast(l_partkey * 37 + l_linenumber * 11 + 100 + l_orderkey % 400 as int)"),
    ("isize", "cast((l_orderkey * 7 + l_linenumber) % 900 - 300 as int)"),
    ("sum_qual", "cast((l_partkey * 13 + l_linenumber * 7) % 1000 as int)"),
    ("rg", "case cast(l_orderkey % 3 as int) when 0 then 'rgA' when 1 then 'rgB' else null end"),
    ("file", "cast(l_suppkey % 2 as int)"),
]
ALN_SQL = "select " + ", ".join(f"{e} as {n}" for n, e in ALN) + " from lineitem"

#: regions over part: half-open, many overlapping
REGION = [("tid", "cast(p_partkey % 25 as int)"), ("start", "cast(p_partkey * 37 as int)"), ("stop", "cast(p_partkey * 37 + p_size * 10 as int)"), ("part", "p_partkey")]
REGION_SQL = "select " + ", ".join(f"{e} as {n}" for n, e in REGION) + " from part"

_FROM = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
_TO = "ACCCGTGAGTACGTACGTATCGTACGACCCGTGAGTACGTACGTATCGTACG"
#: a nucleotide sequence per document, of the whole text
SEQ_SPARK = f"regexp_replace(translate(text, '{_FROM}', '{_TO}'), '[^ACGT]', 'N')"
SEQ_DUCK = f"regexp_replace(translate(text, '{_FROM}', '{_TO}'), '[^ACGT]', 'N', 'g')"
SEQ_SQL = f"select doc_id, {SEQ_DUCK} as seq from documents where text is not null"

#: genotype likelihoods: 20 samples of 3 numbers per vector
PL_SPARK = "transform(slice(embedding, 1, 60), x -> cast(least(255, abs(floor(cast(x as double) * 1000))) as int))"
PL_SQL = "select vec_id, list_transform(embedding[1:60], lambda x: cast(least(255, abs(floor(cast(x as double) * 1000))) as int)) as pl from embeddings"


def alignments(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").selectExpr(*[f"{e} as {n}" for n, e in ALN])


def regions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").selectExpr(*[f"{e} as {n}" for n, e in REGION])


def sequences(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").selectExpr("doc_id", f"{SEQ_SPARK} as seq")


def likelihoods(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").selectExpr("vec_id", f"{PL_SPARK} as pl")
