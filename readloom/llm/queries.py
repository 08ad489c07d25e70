"""Queries of the training-data problems and, where SQL can say it, their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.functions.keys import read_key, read_key_sql
from readloom.llm import frequent, leakage, mixture, quantiles, repetition, seen
from readloom.plans.registry import Registry
from readloom.session import materialize, table

R = Registry()

# --- 1: has this key been seen before -----------------------------------------------------------

SEEN_TABLES = (("mappings", "map_no"), ("qc_hash_list_item", "item_no"))


def seen_answers(spark: SparkSession, d: str, name: str, order: str, **options) -> DataFrame:
    key = read_key("id_seq")
    return seen.seen_before(table(spark, d, name), key, order, table(spark, d, "known_reads"), key, **options)


_SEEN_SQL = f"""
    k as (select distinct {read_key_sql('id_seq')} as key from known_reads),
    a as (select 'mappings' as rec_table, map_no as rec_no, {read_key_sql('id_seq')} as key from mappings
      union all select 'qc_hash_list_item', item_no, {read_key_sql('id_seq')} from qc_hash_list_item),
    m as (select *, min(rec_no) over (partition by rec_table, key) as first_no from a where key is not null),
    s as (select rec_table, rec_no, rec_no > first_no or key in (select key from k) as seen from m)
"""


@R.add("p1_found", f"with {_SEEN_SQL} select rec_table, rec_no from s where seen")
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Rows of mappings and qc_hash_list_item whose key is known or stands in an earlier row."""
    parts = [
        seen_answers(spark, d, name, order).where("seen").select(F.lit(name).alias("rec_table"), F.col(order).alias("rec_no"))
        for name, order in SEEN_TABLES
    ]
    return parts[0].unionByName(parts[1])


def seen_rates(spark: SparkSession, d: str, **options) -> DataFrame:
    key, parts = read_key("id_seq"), []
    for name, order in SEEN_TABLES:
        rates = seen.error_rates(seen_answers(spark, d, name, order, **options), table(spark, d, name), key, order, table(spark, d, "known_reads"), key)
        parts.append(rates.select(F.lit(name).alias("rec_table"), *rates.columns))
    return parts[0].unionByName(parts[1])


_RATES_SQL = f"""with {_SEEN_SQL}
    select rec_table, count(*) as n_answers, cast(sum(case when seen then 1 else 0 end) as bigint) as n_seen,
      cast(0 as bigint) as wrong_seen, cast(0 as bigint) as wrong_new, cast(0 as double) as wrong_rate from s group by 1"""


@R.add("p1_error_rates", _RATES_SQL)
def p1_error_rates(spark: SparkSession, d: str) -> DataFrame:
    """The measured rate of wrong answers of p1_found, against the exact answer."""
    return seen_rates(spark, d)


@R.add("p1_sealed_rates", _RATES_SQL)
def p1_sealed_rates(spark: SparkSession, d: str) -> DataFrame:
    """The same with a current batch of 512 keys, so that nearly every answer comes from sealed sets."""
    return seen_rates(spark, d, batch_keys=512, max_batch=1 << 14)


@R.add("p1_short_fingerprints", f"with {_SEEN_SQL} select rec_table, count(*) as n_answers, true as some_wrong, true as none_missed, true as as_expected from s group by 1")
def p1_short_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    """The same with fingerprints of 8 bits: a new key that meets n sealed sets is taken for a seen one with a
    chance of n / 256, and the measured rate shows it. A task seals 512 keys, then twice as many each time, at most 14 sets."""
    x = seen_rates(spark, d, batch_keys=512, max_batch=1 << 22, fp_bits=8)
    n_new = F.col("n_answers") - F.col("n_seen") + F.col("wrong_seen")
    expected = F.col("wrong_seen").between(F.floor(n_new * 0.5 / 256), n_new * 14 / 256)
    return x.select("rec_table", "n_answers", (F.col("wrong_seen") > 0).alias("some_wrong"), (F.col("wrong_new") == 0).alias("none_missed"), expected.alias("as_expected"))


@R.add("p1_store", f"with {_SEEN_SQL} select rec_no from s where seen and rec_table = 'mappings'")
def p1_store(spark: SparkSession, d: str) -> DataFrame:
    """mappings as two deliveries: the first is decided against a written store of the known reads and then sealed
    into it, the second against the store alone, which holds no key."""
    x, key = table(spark, d, "mappings"), read_key("id_seq")
    store = materialize(seen.seal_keys(table(spark, d, "known_reads"), key, buckets=64), "store")
    half = x.agg(F.floor((F.min("map_no") + F.max("map_no")) / 2)).first()[0]
    first, second = x.where(F.col("map_no") <= half), x.where(F.col("map_no") > half)
    whole = materialize(store.unionByName(seen.seal_keys(first, key, buckets=64)), "store")
    parts = [seen.seen_before(y, key, "map_no", store=s) for y, s in ((first, store), (second, whole))]
    return parts[0].unionByName(parts[1]).where("seen").select(F.col("map_no").alias("rec_no"))


# --- 4: percentiles with a bounded error --------------------------------------------------------

ERROR = 0.01
PS = {"p05": 0.05, "p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99}


def _percentile_sql(source: str, groups: str) -> str:
    """The same sketch and the same estimate, in SQL over ``source`` (groups, v)."""
    g = quantiles.gamma_of(ERROR)
    picks = ", ".join(
        f"round(min(case when upto > floor({p} * (tot - 1)) then {{'a': sgn, 'b': sgn * bucket, 'v': sgn * ({2 / (g + 1)!r} * pow({g!r}, bucket))}} end).v, 6) as {n}"
        for n, p in PS.items()
    )
    return f"""
    with v as ({source}),
    k as (select {groups}, cast(sign(v) as int) as sgn, case when v = 0 then 0 else cast(ceil(ln(abs(cast(v as double))) / ln({g!r})) as int) end as bucket
      from v where v is not null),
    s as (select {groups}, sgn, bucket, count(*) as n from k group by all),
    u as (select *, sum(n) over (partition by {groups} order by sgn, sgn * bucket rows unbounded preceding) as upto,
      sum(n) over (partition by {groups}) as tot from s)
    select {groups}, cast(max(tot) as bigint) as n_values, {picks} from u group by {groups}
    """


def _rounded(x: DataFrame) -> DataFrame:
    return x.select(*[F.round(c, 6).alias(c) if c in PS else F.col(c) for c in x.columns])


#: one row per alignment: rows written again carry the same values and count once
_ALN_SQL = "select batch_id, aln_no, max(run_id) as run_id, max(map_quality_p) as q, max(alignment_length_p) as l from bam_qc_batch group by 1, 2"


def _alignments(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "bam_qc_batch")
    return x.groupBy("batch_id", "aln_no").agg(
        F.max("run_id").alias("run_id"), F.max("map_quality_p").alias("map_quality_p"), F.max("alignment_length_p").alias("alignment_length_p")
    )


@R.add("p4_map_quality", _percentile_sql(f"select run_id, q as v from ({_ALN_SQL}) where q between 0 and 254", "run_id"))
def p4_map_quality(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles of mapping quality per run; 255 and -1 stand for no quality."""
    x = _alignments(spark, d).where("map_quality_p between 0 and 254")
    return _rounded(quantiles.percentiles(quantiles.sketch(x, ["run_id"], "map_quality_p", ERROR), ["run_id"], PS, ERROR))


@R.add("p4_alignment_length", _percentile_sql(f"select run_id, l as v from ({_ALN_SQL}) where l > 0", "run_id"))
def p4_alignment_length(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles of alignment length per run; lengths below 1 stand for none."""
    x = _alignments(spark, d).where("alignment_length_p > 0")
    return _rounded(quantiles.percentiles(quantiles.sketch(x, ["run_id"], "alignment_length_p", ERROR), ["run_id"], PS, ERROR))


#: a distance of 0 is no distance, one of 2**31 or more is a negative number misread
_DISTANCE = "mean_paired_end_distance between 1 and 2147483647"
_DISTANCE_SQL = f"""select lower(trim(centre)) as centre, report_day, mean_paired_end_distance as v
    from bam_qc_report where {_DISTANCE}"""


def _distance_sketch(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "bam_qc_report").where(_DISTANCE).withColumn("centre", F.lower(F.btrim("centre")))
    return quantiles.sketch(x, ["centre", "report_day"], "mean_paired_end_distance", ERROR)


@R.add("p4_pair_distance", _percentile_sql(_DISTANCE_SQL, "centre, report_day"))
def p4_pair_distance(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles of the mean pair distance per centre and day."""
    return _rounded(quantiles.percentiles(_distance_sketch(spark, d), ["centre", "report_day"], PS, ERROR))


@R.add("p4_pair_distance_all_days", _percentile_sql(_DISTANCE_SQL, "centre"))
def p4_pair_distance_all_days(spark: SparkSession, d: str) -> DataFrame:
    """The sketches of all days of a centre, combined."""
    whole = quantiles.merge(_distance_sketch(spark, d), ["centre"])
    return _rounded(quantiles.percentiles(whole, ["centre"], PS, ERROR))


# --- 5: most frequent items ---------------------------------------------------------------------


_TOP_SQL = f"""with c as (select {read_key_sql('id_seq')} as id_seq, count(*) as n_rows from mappings where {read_key_sql('id_seq')} is not null group by 1),
    r as (select *, rank() over (order by n_rows desc) as rk from c)"""


@R.add("p5_found", f"{_TOP_SQL} select id_seq from r where rk <= 20")
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Keys with the 20 largest numbers of rows in mappings."""
    return frequent.most_frequent(table(spark, d, "mappings"), read_key("id_seq"), 20).select(F.col("item").alias("id_seq"))


@R.add("p5_counts", f"{_TOP_SQL} select id_seq, n_rows, true as inside, true as complete from r where rk <= 20")
def p5_counts(spark: SparkSession, d: str) -> DataFrame:
    """The same keys with their exact numbers of rows, whether those lie in the guaranteed interval, and whether no key is missing."""
    x = frequent.most_frequent(table(spark, d, "mappings"), read_key("id_seq"), 20)
    return x.select(F.col("item").alias("id_seq"), "n_rows", F.col("n_rows").between(F.col("at_least"), F.col("at_most")).alias("inside"), "complete")


@R.add(
    "p5_intervals",
    f"""{_TOP_SQL} select id_seq, n_rows, true as not_above, true as not_below, true as narrow from r where rk <= 20""",
)
def p5_intervals(spark: SparkSession, d: str) -> DataFrame:
    """One pass without a second count, in buckets of 500 rows so that every task prunes: the guaranteed interval of the
    20 most frequent keys holds the true count and is at most rows / width wide."""
    x, width = table(spark, d, "mappings"), 500
    key = read_key("id_seq")
    top = frequent.most_frequent(x, key, 20).select("item", "n_rows")
    y = top.join(frequent.lossy_counts(x, key, width), "item")
    bound = x.agg((F.count(F.lit(1)) / width).alias("b")).scalar()
    return y.select(
        F.col("item").alias("id_seq"), "n_rows", (F.col("at_least") <= F.col("n_rows")).alias("not_above"), (F.col("at_most") >= F.col("n_rows")).alias("not_below"),
        (F.col("at_most") - F.col("at_least") <= bound).alias("narrow"),
    )


@R.add("p5_at_least")
def p5_at_least(spark: SparkSession, d: str) -> DataFrame:
    """The report of one pass: the 20 best keys by guaranteed count, with the interval of each."""
    x = frequent.most_frequent(table(spark, d, "mappings"), read_key("id_seq"), 20, exact=False)
    return x.select(F.col("item").alias("id_seq"), "at_least", "at_most", "complete")


# --- 6: evaluation texts in training text -------------------------------------------------------

PASSAGE = 12
_WORDS_SQL = "list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> '')"


@R.add(
    "p6_found",
    f"""
    with d as (select doc_id, {_WORDS_SQL} as w from documents where text is not null),
    dg as (select distinct doc_id, array_to_string(w[i:i + 11], ' ') as g from (select doc_id, w, unnest(range(1, len(w) - 10)) as i from d)),
    e as (select item_id, {_WORDS_SQL} as w from eval_items),
    eg as (select distinct item_id, array_to_string(w[i:i + 11], ' ') as g from (select item_id, w, unnest(range(1, len(w) - 10)) as i from e))
    select distinct doc_id, item_id from dg join eg using (g)
    """,
)
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents and eval items that share at least 12 consecutive words."""
    x = leakage.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"), window=PASSAGE)
    return x.where("edits = 0").select("doc_id", "item_id")


_SPAN_SQL = "array_to_string(w[{0}:{1}], ' ')"


@R.add(
    "p6_leaks",
    f"""
    with d as (select doc_id, {_WORDS_SQL} as w from documents where text is not null),
    e as (select item_id, {_WORDS_SQL} as w from eval_items),
    ds as (select doc_id, w, unnest(range(1, len(w) - 9)) as a from d),
    ep as (select item_id, w, unnest(range(1, len(w) - 10)) as a from e),
    k as (select unnest(range(0, 13)) as k),
    -- a passage without its word k, a stretch of 11, 12 (without word k) or 13 words (without word k)
    e12 as (select distinct item_id, array_to_string(w[a:a + 11], ' ') as g from ep),
    e11 as (select distinct item_id, k, concat_ws(' ', {_SPAN_SQL.format('a', 'a + k - 1')}, {_SPAN_SQL.format('a + k + 1', 'a + 11')}) as g from ep, k where k between 1 and 10),
    d12 as (select doc_id, array_to_string(w[a:a + 11], ' ') as g from ds where a + 11 <= len(w)),
    d12x as (select doc_id, k, concat_ws(' ', {_SPAN_SQL.format('a', 'a + k - 1')}, {_SPAN_SQL.format('a + k + 1', 'a + 11')}) as g from ds, k where a + 11 <= len(w) and k between 1 and 10),
    d13x as (select doc_id, concat_ws(' ', {_SPAN_SQL.format('a', 'a + k - 1')}, {_SPAN_SQL.format('a + k + 1', 'a + 12')}) as g from ds, k where a + 12 <= len(w) and k between 1 and 11),
    d11 as (select doc_id, array_to_string(w[a:a + 10], ' ') as g from ds),
    e11all as (select item_id, g from e11 union select item_id, array_to_string(w[a + 1:a + 11], ' ') from ep union select item_id, array_to_string(w[a:a + 10], ' ') from ep),
    f as (
      select doc_id, item_id, true as exact from d12 join e12 using (g)
      union all select doc_id, item_id, false from d12x join e11 using (k, g)
      union all select doc_id, item_id, false from d13x join e12 using (g)
      union all select doc_id, item_id, false from d11 join e11all using (g))
    select doc_id, item_id, bool_or(exact) as exact from f group by 1, 2
    """,
)
def p6_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Documents and items that share 12 consecutive words or 12 words but for one that is changed, left out or put in."""
    x = leakage.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"), window=PASSAGE, whole_edits=None)
    return x.select("doc_id", "item_id", (F.col("edits") == 0).alias("exact"))


@R.add("p6_whole")
def p6_whole(spark: SparkSession, d: str) -> DataFrame:
    """Items that stand in a document whole but for edits of a tenth of their words, and where."""
    x = leakage.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"), window=PASSAGE, whole_edits=0.1)
    return x.where("whole_edits is not null").select("doc_id", "item_id", "whole_edits", "n_passages", "first_word", "last_word")


@R.add(
    "p6_recall",
    f"""
    with n as (select len({_WORDS_SQL}) as n from eval_items), w(width) as (values (12), (18), (27), (40), (60), (90), (135)),
    c as (select distinct (select max(width) from w where width <= n) as width, true as whole from n union select 12, false)
    select width, whole, edit, true as reached from c, (values ('changed'), ('left out'), ('put in'), ('mixed')) v(edit)
    """,
)
def p6_recall(spark: SparkSession, d: str) -> DataFrame:
    """Whether the measured recall is what was asked for, by class of windows and kind of edit."""
    x = leakage.leak_recall(table(spark, d, "eval_items"), window=PASSAGE, recall=0.95)
    return x.select("width", (F.col("kind") > 0).alias("whole"), "edit", (F.col("recall") >= 0.95).alias("reached"))


# --- 7: mixing sources --------------------------------------------------------------------------


@R.add("p7_mixture")
def p7_mixture(spark: SparkSession, d: str) -> DataFrame:
    """The token blocks of the mixture, by shard and place."""
    return mixture.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


@R.add("p7_shares")
def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and actual shares of each source."""
    return mixture.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


@R.add("p7_checks", "select source, target_share, max_repeats, true as kept_to_cap, true as near_target, true as whole from mix_targets")
def p7_checks(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of the rows of the mixture: no block is used more often than its source may be, every source
    is within a block of its target share, and every block has as many tokens as it says."""
    targets = table(spark, d, "mix_targets")
    m = mixture.mix(table(spark, d, "documents"), targets)[0]
    whole = (F.size("tokens") == F.col("n_tokens")) & (F.aggregate("doc_tokens", F.lit(0), lambda a, x: a + x) == F.col("n_tokens"))
    blocks = m.groupBy("source", "block").agg(F.count(F.lit(1)).alias("uses"), F.sum(F.size("tokens")).alias("n"), F.min(whole).alias("whole"))
    per = blocks.groupBy("source").agg(F.max("uses").alias("uses"), F.sum("n").alias("n"), F.min("whole").alias("whole"))
    total = per.agg(F.sum("n").alias("n")).scalar()
    near = F.abs(F.col("n") - F.col("target_share") * total) <= 128
    return targets.join(per, "source").select("source", "target_share", "max_repeats", (F.col("uses") <= F.col("max_repeats")).alias("kept_to_cap"), near.alias("near_target"), "whole")


# --- 8: repetition inside a document ------------------------------------------------------------

_REPEAT_SQL = f"""
    with d as (select doc_id, {_WORDS_SQL} as w from documents where text is not null),
    g as (select doc_id, i, array_to_string(w[i:i + 5], ' ') as g from (select doc_id, w, unnest(range(1, len(w) - 4)) as i from d)),
    f as (select *, min(i) over (partition by doc_id, g) as first_i from g),
    r as (select doc_id, count(distinct p) as n from (select doc_id, unnest(range(i, i + 6)) as p from f where i > first_i) group by 1),
    s as (select d.doc_id, cast(len(w) as bigint) as n_words, coalesce(r.n, 0) as n_repeated from d left join r using (doc_id))
"""


@R.add("p8_found", f"{_REPEAT_SQL} select doc_id from s where n_words > 0 and n_repeated / n_words >= 0.3")
def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents of which at least 0.30 is repeated."""
    return repetition.repeating_documents(table(spark, d, "documents"), 0.3).select("doc_id")


@R.add("p8_shares", f"{_REPEAT_SQL} select doc_id, n_words, n_repeated from s where n_words > 0")
def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """Words and repeated words of every document with words."""
    return repetition.repetition(table(spark, d, "documents")).where("n_words > 0").select("doc_id", "n_words", "n_repeated")


@R.add("p8_labels")
def p8_labels(spark: SparkSession, d: str) -> DataFrame:
    """Everything the labeller says of every document."""
    return repetition.repetition(table(spark, d, "documents"))


@R.add("p8_retained")
def p8_retained(spark: SparkSession, d: str) -> DataFrame:
    """Documents of which at least 0.7 of the words stand in lines the CRF takes for content."""
    return repetition.retained(table(spark, d, "documents")).select("doc_id", "content_share")


@R.add("p8_quality", "select planted, true as precise, true as complete from (values ('sentence'), ('phrase'), ('passage')) v(planted)")
def p8_quality(spark: SparkSession, d: str) -> DataFrame:
    """Whether precision and recall of the CRF are at least 0.95 on held-out documents with planted repetition."""
    x = repetition.label_quality(table(spark, d, "documents"))
    return x.select("planted", (F.col("precision") >= 0.95).alias("precise"), (F.col("recall") >= 0.95).alias("complete"))
