"""Words of texts as 64-bit hashes, computed by native expressions.

A word is a longest run of letters and digits (Unicode L and N) of the lower-cased text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

BREAK = r"[^\p{L}\p{N}]+"
#: A line ends at a line break or behind a sentence.
LINE_BREAK = r"[\n\r.!?;…]+"


def word_hashes(text: Column) -> Column:
    """array<bigint>, one hash a word; a null text has no words."""
    words = F.filter(F.split(F.lower(text), BREAK), lambda w: w != "")
    return F.coalesce(F.transform(words, lambda w: F.xxhash64(w)), F.array().cast("array<bigint>"))


def line_word_hashes(text: Column) -> Column:
    """array<array<bigint>>: the same words in the same order, by line; lines without words are left out."""
    lines = F.transform(
        F.split(F.lower(text), LINE_BREAK),
        lambda line: F.transform(F.filter(F.split(line, BREAK), lambda w: w != ""), lambda w: F.xxhash64(w)),
    )
    return F.coalesce(F.filter(lines, lambda x: F.size(x) > 0), F.array().cast("array<array<bigint>>"))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets (rows + 1 of them, the first 0) of a list column."""
    offsets = column.offsets.to_numpy().astype(np.int64)
    values = column.values
    if hasattr(values, "to_numpy") and not pa.types.is_list(values.type):
        values = values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
    else:
        values = values.slice(offsets[0], offsets[-1] - offsets[0])
    return values, offsets - offsets[0]
