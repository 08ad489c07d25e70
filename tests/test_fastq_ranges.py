import random

import pytest

from readloom.sources.fastq import read_fastq


def write(path, records, width=None):
    rng = random.Random(1)
    with open(path, "w") as f:
        for name, seq, qual in records:
            w = width or len(seq) or 1
            parts = lambda s: "\n".join(s[i : i + w] for i in range(0, len(s), w))  # noqa: B023, E731
            f.write(f"@{name} x{rng.random()}\n{parts(seq)}\n+\n{parts(qual)}\n")


def make(n):
    rng = random.Random(2)
    out = []
    for i in range(n):
        k = rng.randrange(1, 60)
        # qualities that begin with the signs of headers and separators
        out.append((f"r{i}", "".join(rng.choice("ACGTN") for _ in range(k)), rng.choice("@+I") + "".join(rng.choice("@+!IJ5") for _ in range(k - 1))))
    return out


@pytest.mark.parametrize("width", [None, 7])
@pytest.mark.parametrize("split", [97, 1000, 1 << 20])
def test_ranges_give_every_record_once(spark, tmp_path, split, width):
    records = make(400)
    write(tmp_path / "a.fq", records, width)
    got = [tuple(r) for r in read_fastq(spark, f"file://{tmp_path}/a.fq", split=split, wrapped=width is not None).collect()]
    assert sorted(got) == sorted(records)


def test_cut_off_and_empty(spark, tmp_path):
    (tmp_path / "a.fq").write_text("@r1\nACGT\n+\nIIII\n@r2\nACGT\n+\nII\n")
    assert [tuple(r) for r in read_fastq(spark, str(tmp_path / "a.fq"), mode="permissive").collect()] == [("r1", "ACGT", "IIII"), ("r2", None, None)]
    with pytest.raises(Exception, match="incomplete record"):
        read_fastq(spark, str(tmp_path / "a.fq")).collect()
    (tmp_path / "b.fq").write_text("")
    assert read_fastq(spark, str(tmp_path / "b.fq")).count() == 0
    (tmp_path / "c.fq").write_text("@r1\nACGT\n+\nIIII\n\n\n")
    assert read_fastq(spark, str(tmp_path / "c.fq")).count() == 1
