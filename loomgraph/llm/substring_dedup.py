"""Repeated passages of words, found with super-k-mers.

Consecutive windows of words with one minimiser travel as one packed string to the bucket of that minimiser. There the
words get exact numbers and windows of 1, 2, 4, ... words are named by sorting pairs of names, up to the full window:
equal names are equal word sequences, and their number is the count.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from loomgraph.llm.repeats import AT_ONCE, HOT, Plan, WordUnits, pieces, removed, repeated_stretches, unzipped
from loomgraph.llm.textarrays import Words

WINDOW = 35
GRAM = 4


def window_names(data: np.ndarray, offsets: np.ndarray, window: int) -> tuple[np.ndarray, Words]:
    """A number for the ``window`` words from each word on; the same number only for the same words."""
    words = Words(data, offsets)
    body = data.tobytes()
    strings = [body[a:b] for a, b in zip(words.start.tolist(), words.end.tolist())]
    names = pd.factorize(np.array(strings, dtype=object))[0].astype(np.int64)

    def paired(left: np.ndarray, shift: int) -> np.ndarray:
        right = np.full(len(left), -1, np.int64)  # beyond the end
        right[: max(len(left) - shift, 0)] = left[shift:]
        _, out = np.unique(left * (len(left) + 1) + right + 1, return_inverse=True)
        return out.astype(np.int64)

    length = 1
    while 2 * length <= window:
        names, length = paired(names, length), 2 * length
    return (paired(names, window - length) if length < window else names), words


def occur_again(window: int):
    def again(data: np.ndarray, offsets: np.ndarray, n: np.ndarray, copies: np.ndarray) -> np.ndarray:
        names, words = window_names(data, offsets, window)
        row = np.repeat(np.arange(len(n)), n)
        place = words.first[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        own = names[place]
        return np.bincount(own, weights=copies[row], minlength=1)[own] > 1

    return again


def substring_report(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    gram: int = GRAM,
    hot: int = HOT,
    at_once: int = AT_ONCE,
) -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_removed, kept_sha256 (and the kept words as ``kept_text``).

    A word is removed if a window of ``window`` words over it starts anywhere else too, in the same text or another;
    windows are judged on the input. A null or empty text has no words. Equal texts and repeated rows are copies of
    each other, so all of their windows repeat. Other columns are ignored; an empty table gives no rows.
    """
    plan = Plan(WordUnits, window, min(gram, window), occur_again(window), hot, at_once)
    rows = repeated_stretches(docs, id_col, text_col, plan).select("doc", "text", "copies", "stretches")
    schema = T.StructType(
        [
            T.StructField(id_col, rows.schema["doc"].dataType),
            T.StructField("n_words", T.LongType()),
            T.StructField("n_removed", T.LongType()),
            T.StructField("kept_sha256", T.StringType()),
            T.StructField("kept_text", T.StringType()),
        ]
    )

    def run(batches):
        for batch in batches:
            for a, b, data, offsets in pieces(unzipped(batch.column(1))):
                units = WordUnits(data, offsets)
                copies = batch.column(2).slice(a, b - a).fill_null(1).to_numpy()
                gone = removed(units, batch.column(3).slice(a, b - a), copies, window)
                kept = ~gone
                inside = np.zeros(len(data) + 1, np.int64)
                inside[units.words.start[kept]] = 1
                inside[units.words.end[kept]] -= 1
                flat, begin, end = Words(np.where(np.cumsum(inside[:-1]) > 0, data, 0x20).astype(np.uint8), offsets).joined()
                per_text = np.add.reduceat(np.r_[kept, 0], units.first[:-1]) if b > a else np.zeros(0, np.int64)
                per_text = np.where(np.diff(units.first) > 0, per_text, 0)
                last = np.cumsum(per_text)
                body = flat.tobytes()
                texts = [
                    body[begin[x] : end[y - 1]] if y > x else b""
                    for x, y in zip((last - per_text).tolist(), last.tolist())
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        pa.array(np.diff(units.first).astype(np.int64)),
                        pa.array((np.diff(units.first) - per_text).astype(np.int64)),
                        pa.array([hashlib.sha256(t).hexdigest() for t in texts]),
                        pa.array([t.decode() for t in texts], pa.string()),
                    ],
                    names=schema.names,
                )

    return rows.mapInArrow(run, schema)
