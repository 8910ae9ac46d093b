"""Quality rules by repetition coverage.

Words, lines and n-grams of several lengths are hashed with rolling polynomials over the whole bytes of a text, and the
characters inside repeated n-grams and lines are measured. Each Arrow batch is worked on in pieces of about a megabyte,
so memory depends on the longest text only; there is no shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from loomgraph.llm.textarrays import Words, mix, prefix_hash, ranges, repeated, slices, sums_by, text_bytes, windows

PIECE = 1 << 20
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Largest share of a text's word characters inside n-grams that occur twice or more in it, by n.
MAX_COVERED = {5: 0.40, 6: 0.38, 7: 0.36, 8: 0.34, 9: 0.32, 10: 0.30}
#: Largest share of a text's word characters in lines equal to an earlier line.
MAX_LINE_SHARE = 0.30
#: Most symbols per word character; a table's cell marks stay below it.
MAX_SYMBOL_SHARE = 0.25

SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
# lines end at \n only
NEWLINE = np.zeros(256, bool)
NEWLINE[0x0A] = True

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SHARES = tuple(f"covered_{n}" for n in MAX_COVERED) + ("dup_line_share",)


def measure(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The counts and shares of each text of a piece."""
    n = len(offsets) - 1
    sums = prefix_hash(data + np.uint64(1))
    words = Words(data, offsets)
    letters = np.zeros(len(data) + 1, np.int64)  # code points so far: bytes that do not continue one
    np.cumsum((data & 0xC0) != 0x80, out=letters[1:])
    chars = letters[words.end] - letters[words.start]
    out = {
        "n_words": words.count.astype(np.int64),
        "word_chars": sums_by(chars, words.first),
        "n_symbols": sums_by(SYMBOL[data], offsets),
    }
    hashes = ranges(sums, words.start, words.end)
    text_of = words.of_text()
    salt = mix(np.arange(1, n + 1, dtype=np.uint64))
    rolling = prefix_hash(hashes)

    def covered(length: int) -> np.ndarray:
        """Words inside windows of the length that occur twice or more in their text."""
        grams = windows(rolling, length)
        whole = text_of[: len(grams)] == text_of[length - 1 : length - 1 + len(grams)]
        at = np.flatnonzero(whole)
        hit = at[repeated(grams[at] ^ salt[text_of[at]])]
        step = np.zeros(len(hashes) + 1, np.int64)
        step[hit] += 1
        np.subtract.at(step, hit + length, 1)
        return np.cumsum(step[:-1]) > 0

    total = np.maximum(out["word_chars"], 1)
    out["n_repeat_words"] = sums_by(covered(3), words.first)
    for length in MAX_COVERED:
        out[f"covered_{length}"] = sums_by(np.where(covered(length), chars, 0), words.first) / total

    lines = Words(data, offsets, NEWLINE)
    word_before = np.searchsorted(words.start, np.stack([lines.start, lines.end]))
    with_word = word_before[1] > word_before[0]
    start, end = lines.start[with_word], lines.end[with_word]
    line_text = lines.of_text()[with_word]
    keys = ranges(sums, start, end) ^ salt[line_text]
    order = np.argsort(keys, kind="stable")
    later = np.zeros(len(keys), bool)
    later[order[1:]] = keys[order[1:]] == keys[order[:-1]]
    first = np.searchsorted(line_text, np.arange(n + 1))
    out["n_dup_lines"] = sums_by(later, first)
    run = np.zeros(len(chars) + 1, np.int64)
    np.cumsum(chars, out=run[1:])
    line_chars = (run[word_before[1]] - run[word_before[0]])[with_word]
    out["dup_line_share"] = sums_by(np.where(later, line_chars, 0), first) / total
    out["base_failed"] = (out["n_words"] < MIN_WORDS) | (
        100 * out["n_repeat_words"] > MAX_REPEAT_PERCENT * out["n_words"]
    )
    good = ~out["base_failed"] & (out["dup_line_share"] <= MAX_LINE_SHARE)
    good &= out["n_symbols"] <= MAX_SYMBOL_SHARE * out["word_chars"]
    for length, most in MAX_COVERED.items():
        good &= out[f"covered_{length}"] <= most
    out["kept"] = good
    return out


def measure_column(column: pa.Array) -> dict[str, np.ndarray]:
    data, offsets = text_bytes(column)
    parts = [
        measure(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in slices(offsets, PIECE)
    ] or [measure(data, offsets)]
    return {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}


def quality_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: its id, counts, shares, ``base_failed`` and ``kept``.

    A null text has no words and fails. Null and repeated ids are kept as they are; other columns are ignored; an
    empty table gives no rows.
    """
    src = docs.select(docs[id_col].alias(id_col), docs[text_col].cast("string").alias("__text"))
    schema = T.StructType(
        [src.schema[id_col]]
        + [T.StructField(c, T.LongType()) for c in COUNTS]
        + [T.StructField(c, T.BooleanType()) for c in ("base_failed", "kept")]
        + [T.StructField(c, T.DoubleType()) for c in SHARES]
    )
    names = [f.name for f in schema][1:]

    def run(batches):
        for batch in batches:
            found = measure_column(batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(found[c]) for c in names)], names=[id_col, *names]
            )

    return src.mapInArrow(run, schema)


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text passes every rule, all columns as they are."""
    place = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(measure_column(batch.column(place))["kept"]))

    return docs.mapInArrow(run, docs.schema)
