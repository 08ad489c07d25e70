"""Mixing sources to target weights.

Every source is one long row of tokens: its documents stand in the order of a hash of id and text, so
neither the files nor the number of tasks decide where a document stands. Texts are tokenised once; the
tokens of each (source, hash bucket) are counted, running sums give every bucket its first position,
and the row is cut at the multiples of the block length. So the blocks of a source are the same on any
cluster, all of one length but the last, and no token is lost.

The total is the largest at which every source can give its share without passing its cap, or the one
asked for; then sources at their cap give all they have and the others share the rest. Output shards draw their
number of blocks of each source from a multinomial with these shares, conditioned on the totals of the sources, so
the shares come out exactly: the draw walks a binary tree over the shards and splits the counts of a
node by a multivariate hypergeometric draw that depends on seed and node only. A shard thus knows its
counts and the number of each source's slots before it without asking any other shard. Slot s of a source
is use s // N of block perm(s % N), where N is the number of its blocks and perm a keyed pseudorandom
permutation (a Feistel network walked until it stays below N), another one for each use. So no
token of a document is used more than max_repeats times. Slots and blocks are joined by (source,
index), which is unique on the side of the blocks: a large source is many keys.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from readloom.session import materialize

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the published split pattern of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CODED = "src int, bucket bigint, k1 bigint, k2 bigint, doc_id bigint, n int, tokens array<int>"
PIECES = "src int, block bigint, at int, n_tokens int, tokens array<int>, doc_ids array<bigint>, doc_tokens array<int>"
SLOTS = "shard bigint, place int, src int, use int, block bigint, n_tokens int"
_BUCKET_ROWS = 4096
_KEY, _ROUND, _ALL = 0x9E3779B97F4A7C15, 0xD1B54A32D192ED03, 0xFFFFFFFFFFFFFFFF


@lru_cache(maxsize=2)
def encoding(path: str, pattern: str = PATTERN):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def _code(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path)
        for b in batches:
            coded = [np.array(enc.encode_ordinary(t), np.int32) for t in b.column("text").to_pylist()]
            n = np.array([len(c) for c in coded], np.int32)
            ends = pa.array(np.concatenate([np.zeros(1, np.int64), np.cumsum(n)]).astype(np.int32))
            tokens = pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.zeros(0, np.int32), *coded])))
            names = ["src", "bucket", "k1", "k2", "doc_id"]
            out = pa.RecordBatch.from_arrays([*map(b.column, names), pa.array(n), tokens], [*names, "n", "tokens"])
            yield out.filter(pa.array(n > 0))

    return run


def cut(at: int, sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Documents of these sizes from position ``at`` on, cut at multiples of ``length``.

    (edges of the pieces, edges of the segments, document of each segment, first segment of each piece);
    edges count from 0, a segment is what a piece holds of one document.
    """
    ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes, dtype=np.int64)])
    total = int(ends[-1])
    pieces = np.unique(np.concatenate([[0], np.arange(length - at % length, total, length), [total]])).astype(np.int64)
    edges = np.union1d(pieces, ends)
    return pieces, edges, np.searchsorted(ends, edges[:-1], "right") - 1, np.searchsorted(edges, pieces)


def _cut(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = 0
        for b in batches:
            if not b.num_rows:
                continue
            src, bucket, start = (b.column(c).to_numpy(zero_copy_only=False) for c in ("src", "bucket", "start"))
            heads = b.column("kind").to_numpy() == 0
            lists = b.column("tokens")
            offsets = lists.offsets.to_numpy().astype(np.int64)
            tokens = lists.values.to_numpy(zero_copy_only=False)
            runs = np.flatnonzero(np.concatenate([[True], (src[1:] != src[:-1]) | (bucket[1:] != bucket[:-1])]))
            made: list[tuple] = []
            for lo, hi in zip(runs, np.append(runs[1:], b.num_rows)):
                if heads[lo]:
                    at, lo = int(start[lo]), lo + 1
                if lo == hi:
                    continue
                pieces, edges, doc, first = cut(at, np.diff(offsets[lo : hi + 1]), length)
                where = at + pieces[:-1]
                made.append((np.full(len(where), src[lo], np.int32), where // length, (where % length).astype(np.int32), np.diff(pieces).astype(np.int32), tokens[offsets[lo] : offsets[hi]], doc + lo, np.diff(edges), np.diff(first)))
                at += int(pieces[-1])
            if not made:
                continue
            s, block, place, n, t, doc, size, segments = (np.concatenate(x) for x in zip(*made))
            ends = lambda c: pa.array(np.concatenate([np.zeros(1, np.int64), np.cumsum(c, dtype=np.int64)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(s), pa.array(block), pa.array(place), pa.array(n), pa.ListArray.from_arrays(ends(n), pa.array(t)),
                    pa.ListArray.from_arrays(ends(segments), b.column("doc_id").take(pa.array(doc))),
                    pa.ListArray.from_arrays(ends(segments), pa.array(size.astype(np.int32))),
                ],
                ["src", "block", "at", "n_tokens", "tokens", "doc_ids", "doc_tokens"],
            )

    return run


def running_starts(df: DataFrame, key: str, order: str, value: str, span: int = 1024) -> DataFrame:
    """(key, order, start): the sum of ``value`` in the key's rows before, added up in two levels so that
    no task sees more than ``span`` rows or one row for each ``span`` of them."""
    x = df.withColumn("__group", F.shiftright(order, span.bit_length() - 1))
    before = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    groups = x.groupBy(key, "__group").agg(F.sum(value).alias("__n"))
    groups = groups.select(key, "__group", F.coalesce(F.sum("__n").over(before(key).orderBy("__group")), F.lit(0)).alias("__base"))
    inner = F.coalesce(F.sum(value).over(before(key, "__group").orderBy(order)), F.lit(0))
    return x.withColumn("__in", inner).join(groups, [key, "__group"]).select(key, order, (F.col("__base") + F.col("__in")).cast("bigint").alias("start"))


def token_blocks(docs: DataFrame, sources: list[str], source: Column, doc_id: str, text: str, tokenizer: str, length: int) -> tuple[DataFrame, np.ndarray]:
    """(src, block, n_tokens, tokens, doc_ids, doc_tokens) of the named sources, and the tokens of each source."""
    number = F.create_map(*[x for i, s in enumerate(sources) for x in (F.lit(s), F.lit(i))])
    x = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"), number[source].alias("src"))
    x = x.where("src is not null and text is not null")
    bits = max(0, int(x.count() // _BUCKET_ROWS).bit_length())
    most = F.lit((1 << 63) - 1)
    x = x.withColumn("k1", F.xxhash64("doc_id", "text").bitwiseAND(most)).withColumn("k2", F.xxhash64(F.lit(1), "text"))
    x = x.withColumn("bucket", F.shiftright("k1", 63 - bits) if bits else F.lit(0).cast("bigint"))
    coded = materialize(x.mapInArrow(_code(tokenizer), CODED), "tokens")
    counts = coded.groupBy("src", "bucket").agg(F.sum("n").alias("n"))
    tokens = np.zeros(len(sources), np.int64)
    for r in counts.groupBy("src").agg(F.sum("n").alias("n")).collect():
        tokens[r["src"]] = r["n"]
    heads = running_starts(counts, "src", "bucket", "n").withColumn("kind", F.lit(0))
    rows = coded.withColumn("kind", F.lit(1)).unionByName(heads, allowMissingColumns=True)
    # one shuffle of the tokens; a bucket has few documents whatever the size of its source
    rows = rows.repartition("src", "bucket").sortWithinPartitions("src", "bucket", "kind", "k1", "doc_id", "k2")
    pieces = materialize(rows.select("src", "bucket", "kind", "start", "doc_id", "tokens").mapInArrow(_cut(length), PIECES), "pieces")
    whole = pieces.where(F.col("n_tokens") == length).drop("at")
    parts = pieces.where(F.col("n_tokens") < length).groupBy("src", "block").agg(
        F.sum("n_tokens").cast("int").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("at", "tokens", "doc_ids", "doc_tokens"))).alias("p")
    )
    joined = parts.select("src", "block", "n_tokens", *[F.flatten(F.col(f"p.{c}")).alias(c) for c in ("tokens", "doc_ids", "doc_tokens")])
    return whole.unionByName(joined), tokens


def _mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permuted(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A permutation of range(size) for each key, evaluated at index; all arrays have one length."""
    x, size = index.astype(np.uint64).copy(), size.astype(np.uint64)
    half = np.array([max(1, (int(n - 1).bit_length() + 1) // 2) for n in np.unique(size)], np.uint64)
    half = half[np.searchsorted(np.unique(size), size)]
    mask = (np.uint64(1) << half) - np.uint64(1)
    todo = np.arange(len(x))
    while len(todo):
        k, h, m = key[todo].astype(np.uint64), half[todo], mask[todo]
        left, right = x[todo] >> h, x[todo] & m
        for r in range(4):
            f = _mix64(right + k * np.uint64(_KEY) + np.uint64((r + 1) * _ROUND & _ALL))
            left, right = right, left ^ (f & m)
        x[todo] = (left << h) | right
        todo = todo[x[todo] >= size[todo]]
    return x.astype(np.int64)


def wanted_tokens(shares: np.ndarray, caps: np.ndarray, total: float | None = None) -> np.ndarray:
    """Tokens each source shall give. Without ``total`` the most at which every source with tokens has its
    share; beyond that sources at their cap give all of it and the others the rest by their shares."""
    live = (shares > 0) & (caps > 0)
    out = np.zeros(len(shares))
    if not live.any():
        return out
    p = np.where(live, shares, 0.0) / shares[live].sum()
    if total is None:
        return p * (caps[live] / p[live]).min()
    total = min(float(total), float(caps[live].sum()))
    open_ = live.copy()
    while open_.any():
        rest = max(total - out[live & ~open_].sum(), 0.0)
        out[open_] = rest * p[open_] / p[open_].sum()
        over = open_ & (out > caps * (1 + 1e-12))
        if not over.any():
            break
        out[over] = caps[over]
        open_ &= ~over
    return out


def place_of(index: int, size: int, key: int) -> int:
    """The place at which the permutation of ``permuted`` has ``index``."""
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask, x = (1 << half) - 1, index
    while True:
        left, right = x >> half, x & mask
        for r in reversed(range(4)):
            f = _mix64(np.array([left], np.uint64) + np.array([key], np.uint64) * np.uint64(_KEY) + np.uint64((r + 1) * _ROUND & _ALL))
            left, right = right ^ (int(f[0]) & mask), left
        x = (left << half) | right
        if x < size:
            return x


def slot_key(seed: int, src, use):
    return seed * 1_000_003 + src * 10_007 + use


def slot_tokens(n: int, src: int, tokens: int, length: int, seed: int) -> int:
    """Tokens in the first ``n`` slots of a source, whose last block is short."""
    blocks = -(-tokens // length)
    uses, rest = divmod(n, blocks)
    short = rest and place_of(blocks - 1, blocks, slot_key(seed, src, uses)) < rest
    return uses * tokens + rest * length - (blocks * length - tokens if short else 0)


def slot_totals(wanted: np.ndarray, tokens: np.ndarray, repeats: np.ndarray, length: int, seed: int) -> np.ndarray:
    """Slots of each source: as many as come nearest to the tokens wanted of it."""
    out = np.zeros(len(tokens), np.int64)
    for s, (w, t, r) in enumerate(zip(wanted.tolist(), tokens.tolist(), repeats.tolist())):
        if w > 0 and t:
            blocks = -(-t // length)
            about = int(w / t * blocks)
            out[s] = min(range(max(0, about - 2), min(blocks * r, about + 3) + 1), key=lambda n: abs(slot_tokens(n, s, t, length, seed) - w))
    return out


def split(counts: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """How many of ``n`` draws without replacement fall on each source. Beyond 10**8 of a kind the normal
    approximation stands for the hypergeometric draw, rounded and kept within what is possible."""
    out = np.zeros(len(counts), np.int64)
    pool = int(counts.sum())
    for s, c in enumerate(counts.tolist()):
        least, most = max(0, n - (pool - c)), min(c, n)
        if least == most:
            x = least
        elif pool < 10**8:
            x = int(rng.hypergeometric(c, pool - c, n))
        else:
            p = c / pool
            x = min(most, max(least, round(rng.normal(n * p, (n * p * (1 - p) * ((pool - n) / (pool - 1))) ** 0.5))))
        out[s], n, pool = x, n - x, pool - c
    return out


def shard_counts(lo: int, hi: int, totals: np.ndarray, shard_blocks: int, seed: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, slots of each source in it, slots of each source before it) for the shards lo to hi - 1."""
    size = int(totals.sum())
    todo = [(0, -(-size // shard_blocks), totals, np.zeros_like(totals))]
    while todo:
        a, b, counts, before = todo.pop()
        if b <= lo or a >= hi:
            continue
        if b - a == 1:
            yield a, counts, before
            continue
        m = (a + b) // 2
        left = split(counts, min(m * shard_blocks, size) - a * shard_blocks, np.random.default_rng([seed, a, b]))
        todo += [(m, b, counts - left, before + left), (a, m, left, before)]


def draw_slots(spark: SparkSession, totals: np.ndarray, tokens: np.ndarray, length: int, shard_blocks: int, seed: int) -> DataFrame:
    """(shard, place, src, use, block, n_tokens): the block in every place of every shard."""
    blocks = -(-tokens // length)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("id").to_numpy()
            for k in range(0, len(ids), 64):
                part = ids[k : k + 64]
                rows = []
                for shard, counts, before in shard_counts(int(part.min()), int(part.max()) + 1, totals, shard_blocks, seed):
                    src = np.repeat(np.arange(len(counts)), counts)
                    slot = np.arange(len(src)) - np.repeat(np.cumsum(counts) - counts - before, counts)
                    rows.append((np.full(len(src), shard), np.random.default_rng([seed, shard]).permutation(len(src)).astype(np.int32), src, slot))
                shard, place, src, slot = (np.concatenate(x) for x in zip(*rows))
                n = blocks[src]
                use = slot // n
                block = permuted(slot % n, n, slot_key(seed, src, use))
                size = np.where(block == n - 1, tokens[src] - (n - 1) * length, length)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard), pa.array(place), pa.array(src.astype(np.int32)), pa.array(use.astype(np.int32)), pa.array(block), pa.array(size.astype(np.int32))],
                    ["shard", "place", "src", "use", "block", "n_tokens"],
                )

    return spark.range(-(-int(totals.sum()) // shard_blocks)).mapInArrow(draw, SLOTS)


def mix(
    docs: DataFrame,
    targets: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    tokenizer: str = TOKENIZER,
    block_tokens: int = 128,
    shard_blocks: int = 1024,
    total_tokens: int | None = None,
    seed: int = 17,
    max_sources: int = 10_000,
) -> tuple[DataFrame, DataFrame]:
    """(mixture, shares).

    ``targets``: (source, target_share, max_repeats). Sources of documents are compared lower-cased
    and without surrounding blanks; null sources and sources without a target take no part.
    mixture: (shard, place, source, use, block, n_tokens, tokens, doc_ids, doc_tokens), a row per slot;
    ``place`` is its pseudorandom place in the shard. shares: one row per target with what is there,
    what is used and the actual share of tokens, which differs from the target by less than a block
    a source. A null text or one without tokens gives nothing; a source without tokens gets a share of
    0 and the others are scaled up; documents repeated under one id count as documents of their own; without
    any tokens the mixture is empty. ``total_tokens`` asks for a total; above the most at which all shares can be
    met, sources at their cap fall short and the others take their place. Same rows, same seed: same mixture,
    however the rows are spread over files and tasks. ``tokenizer`` is a file every executor can read.
    """
    spark = docs.sparkSession
    rows = targets.limit(max_sources + 1).collect()
    if len(rows) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    rows = sorted((r for r in rows if r["source"] is not None), key=lambda r: r["source"])
    names = [r["source"].strip().lower() for r in rows]
    if not names:
        raise ValueError("no target")
    share = np.array([r["target_share"] or 0.0 for r in rows])
    repeats = np.array([r["max_repeats"] or 0 for r in rows], np.int64)

    blocks, tokens = token_blocks(docs, names, F.lower(F.btrim(F.col(source))), doc_id, text, tokenizer, block_tokens)
    totals = slot_totals(wanted_tokens(share, (tokens * repeats).astype(float), total_tokens), tokens, repeats, block_tokens, seed)
    slots = draw_slots(spark, totals, tokens, block_tokens, shard_blocks, seed)
    label = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("src") + 1)
    # both sides grow with the data: never broadcast
    placed = slots.drop("n_tokens").hint("merge").join(blocks.hint("merge"), ["src", "block"])
    mixture = placed.select("shard", "place", label.alias("source"), "use", "block", "n_tokens", "tokens", "doc_ids", "doc_tokens")

    used = slots.groupBy("src").agg(F.count(F.lit(1)).alias("blocks_used"), F.sum("n_tokens").cast("bigint").alias("tokens_used"), (F.max("use") + 1).alias("most_uses"))
    wanted = spark.createDataFrame(
        [(i, n, float(s), int(r), int(-(-t // block_tokens)), int(t)) for i, (n, s, r, t) in enumerate(zip(names, share, repeats, tokens))],
        "src int, source string, target_share double, max_repeats int, blocks_there bigint, tokens_there bigint",
    )
    total = used.agg(F.sum("tokens_used").alias("t")).scalar()
    shares = wanted.join(used, "src", "left").na.fill(0).withColumn("actual_share", F.coalesce(F.col("tokens_used") / total, F.lit(0.0))).drop("src")
    return mixture, shares
