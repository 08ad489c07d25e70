"""The streams take many small files as one batch; a batch costs seconds of its own."""

from pathlib import Path

from oracle import same, tables

import __spark_entry__ as entry
from readloom.session import shared_dir
from readloom.streaming import running as S


def places(spark) -> set[Path]:
    return set(Path(shared_dir(spark).removeprefix("file://")).glob("stream-*/out/batch=*"))


def test_mapping_counts_of_many_files(spark, tmp_path):
    spark.read.parquet("/root/testdata/sf0.001/mappings.parquet").repartition(9).write.parquet(f"{tmp_path}/mappings.parquet")
    before = places(spark)
    df = entry.queries()["stream_mapping_counts"](spark, str(tmp_path))
    assert len(places(spark) - before) == 1
    same(df, tables(str(tmp_path)), entry.oracle_sql()["stream_mapping_counts"])


def test_last_state_of_a_key(spark, tmp_path):
    spark.read.parquet("/root/testdata/sf0.001/mappings.parquet").repartition(3).write.parquet(f"{tmp_path}/mappings.parquet")
    before = places(spark)
    stream = S.mapping_counts_stream(S.stream_table(spark, str(tmp_path), "mappings", 1))
    df = S.run_to_table(stream, "update", ["id_seq"])
    assert len(places(spark) - before) == 3
    same(df, tables(str(tmp_path)), entry.oracle_sql()["stream_mapping_counts"])


def test_depth_of_small_files(spark, tmp_path):
    spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").limit(500).write.parquet(f"{tmp_path}/lineitem.parquet")
    before = places(spark)
    df = entry.queries()["stream_depth"](spark, str(tmp_path))
    made = places(spark) - before
    assert len(made) == 1  # 4 files of blocks and one of ends
    runs = spark.read.parquet(*map(str, made))
    assert "end" in runs.columns and runs.count() < df.count()
    same(df, tables(str(tmp_path)), entry.oracle_sql()["stream_depth"])


def test_runs_in_batches_have_the_whole_depth(spark):
    blocks = spark.createDataFrame([(t, b * 7 % 301, b * 7 % 301 + b % 40) for t in (0, 1) for b in range(400)] + [(1, 5, 300)], "tid int, beg int, end int")
    runs = S.run_to_table(S.depth_runs_stream(S.position_ordered(blocks, 5)), "append")
    want: dict = {}
    for t, b, e in blocks.collect():
        for p in range(b, e):
            want[t, p] = want.get((t, p), 0) + 1
    got = [((r["tid"], r["pos"]), r["depth"]) for r in S.positions_of(runs).collect()]
    assert len(got) == len(want) and dict(got) == want
