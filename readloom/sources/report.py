"""Report and coverage sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.operators import aggregates as A
from readloom.sources.files import place


def coverage_lines(coverage: DataFrame) -> DataFrame:
    """chrom, pos and depth by tabs."""
    return coverage.select(F.concat_ws("\t", F.col("chrom").cast("string"), F.col("pos").cast("string"), F.col("depth").cast("string")).alias("value"))


def write_coverage(coverage: DataFrame, path: str) -> None:
    coverage_lines(coverage).write.mode("overwrite").text(path)


def qc_report(alignments: DataFrame, matches: DataFrame, runs: DataFrame) -> DataFrame:
    """(name, value) of the report: three one-row aggregates side by side, turned into rows."""
    basic, pairs, cover = A.qc_basic_stats(alignments), A.mean_pair_distance(matches), A.coverage_summary(runs)
    parts = [x.select(F.explode(F.create_map(*[y for c in x.columns for y in (F.lit(c), F.col(c).cast("double"))])).alias("name", "value")) for x in (basic, pairs, cover)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _write(path: str, text: str) -> None:
    fs, p = place(path)
    fs.create_dir(p.rsplit("/", 1)[0], recursive=True)
    with fs.open_output_stream(p) as f:
        f.write(text.encode())


def write_histogram(histogram: DataFrame, path: str) -> None:
    """A histogram (at most a dozen rows) as one tab-separated file."""
    rows = histogram.orderBy("bin").collect()
    _write(path, "".join("\t".join(map(str, r)) + "\n" for r in rows))


def write_html(report: DataFrame, histograms: dict[str, DataFrame], path: str) -> None:
    """A page with the report's values and the histograms as tables and bars; all of it is a few rows."""
    values = "".join(f"<tr><td>{r['name']}</td><td>{r['value']:g}</td></tr>" for r in report.collect())
    body = f"<h1>Alignment quality</h1><table>{values}</table>"
    for title, h in histograms.items():
        rows = h.orderBy("bin").collect()
        most = max((v for r in rows for v in tuple(r)[1:]), default=0) or 1
        head = "".join(f"<th>{c}</th>" for c in h.columns)
        lines = "".join("<tr>" + "".join(f"<td>{v}<div style='background:#69c;height:4px;width:{100 * v // most if i else 0}px'></div></td>" for i, v in enumerate(r)) + "</tr>" for r in rows)
        body += f"<h2>{title}</h2><table><tr>{head}</tr>{lines}</table>"
    _write(path, f"<!doctype html><meta charset=utf-8><title>Quality</title>{body}")
