import pytest
from pyspark.sql import functions as F

from readloom.functions.cigar import ref_blocks
from readloom.operators import aggregates as A
from readloom.plans.derive import alignments
from readloom.plans.stream_queries import stream_depth
from readloom.streaming import running as S


@pytest.mark.parametrize("files", [1, 4])
def test_whole_depth_of_an_unordered_table(spark, tmp_path, files):
    table = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").limit(2000)
    table.repartition(files).write.parquet(f"{tmp_path}/lineitem.parquet")
    d = str(tmp_path)
    got = {(r["tid"], r["pos"]): r["depth"] for r in stream_depth(spark, d).collect()}
    blocks = alignments(spark, d).where("tid >= 0").select("tid", F.inline(ref_blocks("pos", "cigar")))
    assert got == {(r["tid"], p): r["depth"] for r in A.depth_runs(blocks, "tid").collect() for p in range(r["beg"], r["end"])}


def test_position_ordered(spark):
    blocks = spark.createDataFrame([(t, b, b + 5) for t in (0, 1) for b in range(500, 0, -7)], "tid int, beg int, end int")
    seen = []
    stream = S.position_ordered(blocks, 4)
    q = stream.writeStream.foreachBatch(lambda x, i: seen.append([tuple(r) for r in x.collect()])).trigger(availableNow=True).start()
    q.awaitTermination()
    assert len(seen) == 5 and sorted(sum(seen[:4], [])) == sorted(map(tuple, blocks.collect()))
    assert all(max(b for _, b, _ in x) <= min(b for _, b, _ in y) for x, y in zip(seen, seen[1:]))
    assert sorted(seen[4]) == [(t, S.END_OF_CONTIG, S.END_OF_CONTIG) for t in (0, 1)]
