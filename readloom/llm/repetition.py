"""Repetition inside a document.

A word is repeated if it lies in a run of ``run`` consecutive words that also begins at an earlier
word of the same text (the two may overlap); that share is counted exactly. What is worth keeping is decided line
by line: a linear-chain CRF sees how much of a line is repeated in runs of 3, 6 and 12 words, whether the line
stands earlier as a whole, how varied and long it is, where it stands and what its neighbours are like, and
Viterbi decoding marks it as content or boilerplate. The share of words in content lines decides retention.

The CRF is fitted on a bounded sample of documents into which repetition of known extent is planted: sentences said
again, phrases in a loop, passages pasted a second time. The labels say what was planted, not what the features
measure; half of the documents are held out, and precision and recall are measured on them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.llm.crf import ChainCRF
from readloom.llm.leakage import passage_starts
from readloom.llm.words import flat, line_word_hashes

_P = np.uint64(0x9E3779B97F4A7C15)
RUNS = (3, 6, 12)
PLANTED = ("sentence", "phrase", "passage")
#: a line has at most so many words, longer ones are cut
LINE_WORDS = 24
SAMPLE_LINES, SAMPLE_WORDS = 64, 64
OUT = "doc_id bigint, n_words bigint, n_repeated bigint, repeated_share double, n_lines bigint, n_boilerplate bigint, content_share double, suspect boolean"


def repeated_words(words: np.ndarray, offsets: np.ndarray, run: int) -> np.ndarray:
    """For each word, whether it lies in a run that begins earlier in its text as well."""
    starts, row = passage_starts(offsets, run)
    mark = np.zeros(len(words) + 1, np.int32)
    if len(starts):
        g = row.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)
        for k in range(run):
            g = (g ^ words[starts + k]) * _P
            g ^= g >> np.uint64(29)
        order = np.argsort(g, kind="stable")
        same = np.flatnonzero(g[order[1:]] == g[order[:-1]])
        now, before = order[same + 1], order[same]
        ok = row[now] == row[before]
        for k in range(run):  # equal hashes are compared word by word
            ok &= words[starts[now] + k] == words[starts[before] + k]
        at = starts[now[ok]]
        np.add.at(mark, at, 1)
        np.subtract.at(mark, at + run, 1)
    return np.cumsum(mark[:-1]) > 0


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def _cut_lines(line_at: np.ndarray, doc_lines: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The same lines with the long ones cut into parts of at most ``most`` words."""
    n = np.diff(line_at)
    parts = np.maximum(-(-n // most), 1)
    line = np.repeat(np.arange(len(n)), parts)
    step = np.arange(len(line)) - np.repeat(np.cumsum(parts) - parts, parts)
    at = np.append(line_at[line] + step * most, line_at[-1])
    return at, np.concatenate([[0], np.cumsum(parts)])[doc_lines]


def line_features(words: np.ndarray, line_at: np.ndarray, repeated: dict[int, np.ndarray], doc_lines: np.ndarray) -> np.ndarray:
    """Binary features of each line."""
    n = np.diff(line_at)
    least = np.maximum(n, 1)
    doc = np.repeat(np.arange(len(doc_lines) - 1), np.diff(doc_lines))
    line = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((words, line))
    fresh = np.ones(len(words), bool)
    fresh[order[1:]] = (words[order[1:]] != words[order[:-1]]) | (line[order[1:]] != line[order[:-1]])
    variety = _sums(fresh, line_at) / least
    place = (np.arange(len(n)) - doc_lines[doc]) / np.maximum(np.diff(doc_lines)[doc] - 1, 1)
    # a line that stands earlier as a whole: the words' hashes summed with their places
    mixed = (words ^ (np.arange(len(words), dtype=np.uint64) - line_at[line].astype(np.uint64)) * _P) * np.uint64(0xD1B54A32D192ED03)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed ^ (mixed >> np.uint64(31)), dtype=np.uint64)])
    whole = total[line_at[1:]] - total[line_at[:-1]]
    by = np.lexsort((np.arange(len(n)), whole, doc))
    again = np.zeros(len(n), bool)
    again[by[1:]] = (whole[by[1:]] == whole[by[:-1]]) & (doc[by[1:]] == doc[by[:-1]])
    share = {r: _sums(m, line_at) / least for r, m in repeated.items()}
    columns = [np.ones(len(n), bool), n < 6, n >= 20, variety < 0.6, again, place < 0.34, place > 0.66]
    for s in share.values():
        columns += [s > 0, s >= 0.3, s >= 0.6, s == 1]
    middle = share[RUNS[1]] >= 0.3
    inner = doc[1:] == doc[:-1]
    columns += [np.concatenate([[False], middle[:-1] & inner])[: len(n)], np.concatenate([middle[1:] & inner, [False]])[: len(n)]]
    return np.stack(columns, 1).astype(float)


def _columns(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """words, start of each line among the words, of each text among the lines, among the words."""
    lines, doc_lines = flat(column)
    values, line_at = flat(lines)
    doc_at = line_at[doc_lines]
    line_at, doc_lines = _cut_lines(line_at, doc_lines, LINE_WORDS)
    return values.view(np.uint64), line_at, doc_lines, doc_at


def plant(lines: list[np.ndarray], kind: str | None, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, start of each line, whether each word is a planted copy) of a document with repetition planted at a line break."""
    copies: list[np.ndarray] = []
    last = len(lines) - 1  # the line behind which the copies may stand, so that they come after what they copy
    if kind == "sentence":
        long = [i for i, x in enumerate(lines) if len(x) >= 4] or list(range(len(lines)))
        last = long[rng.integers(len(long))]
        for _ in range(rng.integers(1, 12)):
            copy = lines[last].copy()
            if rng.random() < 0.5:  # numbered or slightly changed
                copy[rng.integers(len(copy))] = rng.integers(1, 2**62)
            copies.append(copy)
    elif kind == "phrase":
        last = int(rng.integers(len(lines)))
        size = min(int(rng.integers(1, 9)), len(lines[last]))
        at = int(rng.integers(len(lines[last]) - size + 1))
        copies.append(np.tile(lines[last][at : at + size], int(rng.integers(1 + 12 // size, 20 + 60 // size))))
    elif kind == "passage":
        a = int(rng.integers(len(lines)))
        some = lines[a : a + int(rng.integers(1, 9))]
        last, copies = a + len(some) - 1, some * int(rng.integers(1, 3))
    at = int(rng.integers(last + 1, len(lines) + 1))
    parts = lines[:at] + copies + lines[at:]
    flags = [np.zeros(sum(map(len, lines[:at])), bool), np.ones(sum(map(len, copies)), bool), np.zeros(sum(map(len, lines[at:])), bool)]
    words = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    return words, np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64), np.concatenate(flags)


def planted_set(texts: list[list[np.ndarray]], kinds: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(features, labels, start of each document's lines, exact repeated share of each document) of planted documents.

    A line is boilerplate if at least 0.3 of its words were planted.
    """
    words, lines, docs, planted = [], [np.zeros(1, np.int64)], [0], []
    for i, (text, kind) in enumerate(zip(texts, kinds)):
        w, at, flag = plant(text, kind, np.random.default_rng([11, i, PLANTED.index(kind) if kind else 9]))
        lines.append(lines[-1][-1] + at[1:])
        docs.append(docs[-1] + len(at) - 1)
        words.append(w)
        planted.append(flag)
    w, flag = np.concatenate(words), np.concatenate(planted)
    line_at, doc_lines = _cut_lines(np.concatenate(lines), np.array(docs), LINE_WORDS)
    doc_at = line_at[doc_lines]
    repeated = {r: repeated_words(w, doc_at, r) for r in RUNS}
    y = _sums(flag, line_at) >= 0.3 * np.maximum(np.diff(line_at), 1)
    share = _sums(repeated[RUNS[1]], doc_at) / np.maximum(np.diff(doc_at), 1)
    return line_features(w, line_at, repeated, doc_lines), y.astype(np.int64), doc_lines, share


class Labeller:
    """The fitted CRF, a copy that leans to boilerplate for finding suspects, and what was measured on held-out documents."""

    def __init__(self, lines: pa.Array, least: float = 0.3) -> None:
        texts = []
        for document in lines.to_numpy(zero_copy_only=False) if len(lines) else []:
            text = [np.asarray(x).astype(np.int64).view(np.uint64) for x in document if len(x)]
            if text:
                texts.append(text)
        # what repeats itself as it is would be taken for content: no base for planting
        words = np.concatenate([np.concatenate(t) for t in texts]) if texts else np.zeros(0, np.uint64)
        ends = np.concatenate([[0], np.cumsum([sum(map(len, t)) for t in texts])]).astype(np.int64)
        own = _sums(repeated_words(words, ends, RUNS[1]), ends) if texts else np.zeros(0)
        texts = [t for t, r, n in zip(texts, own, np.diff(ends)) if r < least * n]
        kinds: list[str | None] = [(None, *PLANTED)[i // 2 % 4] for i in range(len(texts))]
        some = lambda k: [x[k::2] for x in (texts, kinds)]
        self.quality: list[tuple] = []
        if len(texts) < 2:
            # nothing to learn from: a line is boilerplate if half of it is repeated
            w = np.zeros(7 + 4 * len(RUNS) + 2)
            w[0], w[7 + 4 + 1] = -1.0, 2.0
            self.model = self.leaning = ChainCRF(w, np.zeros((2, 2)))
            return
        self.model = ChainCRF.fit(*planted_set(*some(0))[:3])
        held_texts, held_kinds = some(1)
        x, y, docs, share = planted_set(held_texts, held_kinds)
        for kind in PLANTED:
            mine = np.repeat(np.array([k in (kind, None) for k in held_kinds]), np.diff(docs))
            label = self.model.viterbi(x, docs)
            hit = int((label[mine] * y[mine]).sum())
            self.quality.append((kind, int(mine.sum()), int(y[mine].sum()), hit / max(int(label[mine].sum()), 1), hit / max(int(y[mine].sum()), 1)))
        lean = 0.0
        while lean < 12 and (_sums(self.model.leaning(lean).viterbi(x, docs), docs)[share >= least] == 0).any():
            lean += 1
        self.leaning = self.model.leaning(lean + 3)


def labeller(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", fit_rows: int = 2000, least: float = 0.3) -> Labeller:
    """Fitted on the ``fit_rows`` documents with the least hash of their id, of each at most 64 lines of at
    most 64 words: that bounds what the driver sees. Ids come first, then the lines of those ids."""
    x = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    ids = x.where("doc_id is not null and text is not null").select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    ids = [r[0] for r in ids.collect()]
    if not ids:
        return Labeller(pa.array([], pa.list_(pa.list_(pa.int64()))), least)
    lines = F.transform(F.slice(line_word_hashes(F.col("text")), 1, SAMPLE_LINES), lambda x: F.slice(x, 1, SAMPLE_WORDS))
    some = x.where(F.col("doc_id").isin(ids) & F.col("text").isNotNull()).select("doc_id", lines.alias("lines")).orderBy(F.xxhash64("doc_id"), "doc_id", "lines").limit(fit_rows)
    return Labeller(some.toArrow().column("lines").combine_chunks(), least)


def _measure(model: Labeller, run: int):
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            words, line_at, doc_lines, doc_at = _columns(b.column("lines"))
            repeated = {r: repeated_words(words, doc_at, r) for r in dict.fromkeys((*RUNS, run))}
            x = line_features(words, line_at, {r: repeated[r] for r in RUNS}, doc_lines)
            label = model.model.viterbi(x, doc_lines)
            suspect = _sums(model.leaning.viterbi(x, doc_lines), doc_lines) > 0
            n, r = np.diff(doc_at), _sums(repeated[run], doc_at)
            content = _sums((label == 0) * np.diff(line_at), doc_lines)
            least = np.maximum(n, 1)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *map(pa.array, (n, r, r / least, np.diff(doc_lines), _sums(label, doc_lines), np.where(n > 0, content / least, 1.0), suspect))],
                ["doc_id", "n_words", "n_repeated", "repeated_share", "n_lines", "n_boilerplate", "content_share", "suspect"],
            )

    return measure


def repetition(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", run: int = 6, fit_rows: int = 2000, least: float = 0.3) -> DataFrame:
    """One row per row of ``docs``: words, repeated words and their share (exact), lines, lines the CRF marks as
    boilerplate, the share of words in content lines, and whether the leaning CRF suspects any line
    (it leans so far that no held-out document with a repeated share of ``least`` escapes).

    The CRF is fitted on ``fit_rows`` documents; everything else covers every document in one pass without
    a shuffle. A null, empty or wordless text has no words, a repeated share of 0 and a content share of 1. Repeated
    rows give repeated rows, a null id stays null, an empty table gives no rows. Texts are processed whole, lines of more than 24 words in
    parts. Other columns are not read.
    """
    model = labeller(docs, doc_id, text, fit_rows, least)
    x = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), line_word_hashes(F.col(text)).alias("lines"))
    return x.mapInArrow(_measure(model, run), OUT)


def repeating_documents(docs: DataFrame, least: float = 0.3, **options) -> DataFrame:
    """Documents the leaning CRF suspects, of which an exact count then keeps those whose repeated share is
    at least ``least``. The lean is the least at which no held-out document of that share escapes, and three more in log odds."""
    return repetition(docs, least=least, **options).where(F.col("suspect") & (F.col("repeated_share") >= least))


def retained(docs: DataFrame, least_content: float = 0.7, **options) -> DataFrame:
    """Documents of which at least ``least_content`` of the words stand in lines the CRF takes for content."""
    return repetition(docs, **options).where(F.col("content_share") >= least_content)


def label_quality(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", fit_rows: int = 2000) -> DataFrame:
    """Precision and recall of the CRF on held-out planted documents: (planted, n_lines, n_planted, precision, recall)."""
    return docs.sparkSession.createDataFrame(labeller(docs, doc_id, text, fit_rows).quality, "planted string, n_lines int, n_planted int, `precision` double, recall double")
