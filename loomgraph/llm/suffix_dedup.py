"""Repeated passages of bytes, found with suffix arrays.

Runs of windows that may repeat meet in the bucket of their anchor (see ``repeats``). There the different strings of a
bucket are laid out in a row and their suffixes sorted by two-stage sorting; neighbours whose common prefix is as long as
a window are equal windows.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from loomgraph.llm.repeats import AT_ONCE, HOT, ByteUnits, Plan, pieces, removed, repeated_stretches, unzipped
from loomgraph.llm.suffix_array import Suffixes
from loomgraph.llm.textarrays import sums_by

WINDOW = 400
GRAM = 64
#: Between the strings of a bucket; no UTF-8 text holds it, and no window reaches over it.
APART = 0xFF


def occur_again(window: int):
    def again(data: np.ndarray, offsets: np.ndarray, n: np.ndarray, copies: np.ndarray) -> np.ndarray:
        size = np.diff(offsets)
        at = np.cumsum(size + 1) - (size + 1)
        text = np.full(int((size + 1).sum()), APART, np.uint8)
        within = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        text[np.repeat(at, size) + within] = data[np.repeat(offsets[:-1], size) + within]
        begins = np.repeat(at, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        weight = np.zeros(len(text), np.float64)
        weight[begins] = np.repeat(copies, n)

        for kind in itertools.count():
            suffixes = Suffixes(text, window, kind)
            order = suffixes.array(weight > 0)
            prefix, in_order = suffixes.common_prefixes(order)
            if in_order:  # else two strings had one hash, and another hash function sorts them
                break
        family = np.cumsum(prefix < window) - 1
        found = np.zeros(len(text), bool)
        found[order] = np.bincount(family, weights=weight[order], minlength=1)[family] > 1
        return found[begins]

    return again


def suffix_report(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    gram: int = GRAM,
    hot: int = HOT,
    at_once: int = AT_ONCE,
) -> DataFrame:
    """One row per row of ``docs``: id, n_bytes, n_removed, n_spans, kept_sha256 (and the kept bytes as ``kept``).

    A byte is removed if a string of ``window`` bytes over it also starts anywhere else, in the same text or another;
    overlaps count, and strings are judged on the input. A null text is empty. Equal texts and repeated rows are copies
    of each other, so all of their strings repeat. Other columns are ignored; an empty table gives no rows.
    """
    plan = Plan(ByteUnits, window, min(gram, window), occur_again(window), hot, at_once)
    rows = repeated_stretches(docs, id_col, text_col, plan).select("doc", "text", "copies", "stretches")
    schema = T.StructType(
        [
            T.StructField(id_col, rows.schema["doc"].dataType),
            T.StructField("n_bytes", T.LongType()),
            T.StructField("n_removed", T.LongType()),
            T.StructField("n_spans", T.LongType()),
            T.StructField("kept_sha256", T.StringType()),
            T.StructField("kept", T.BinaryType()),
        ]
    )

    def run(batches):
        for batch in batches:
            for a, b, data, offsets in pieces(unzipped(batch.column(1))):
                copies = batch.column(2).slice(a, b - a).fill_null(1).to_numpy()
                gone = removed(ByteUnits(data, offsets), batch.column(3).slice(a, b - a), copies, window)
                begins = gone.copy()
                begins[1:] &= ~gone[:-1]
                edge = offsets[:-1][np.diff(offsets) > 0]
                begins[edge] = gone[edge]
                n_removed = sums_by(gone, offsets)
                kept = data[~gone].tobytes()
                last = np.cumsum(np.diff(offsets) - n_removed).tolist()
                texts = [kept[x:y] for x, y in zip([0, *last], last)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        pa.array(np.diff(offsets)),
                        pa.array(n_removed),
                        pa.array(sums_by(begins, offsets)),
                        pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()),
                        pa.array(texts, pa.binary()),
                    ],
                    names=schema.names,
                )

    return rows.mapInArrow(run, schema)
