"""Fill-in-the-middle rearrangement of texts by memoized content-defined chunks.

A rolling hash over the last bytes cuts texts where the content says so, so equal passages fall into equal chunks wherever
they stand. A worker keeps a summary of each chunk it has met, looked up by the chunk's bytes themselves: code points, ends
of lines, and what the chunk contributes to a marker at its edges. A document's summary is the combination of those of its
chunks, and a cut after so many lines is found by the running counts of lines over the chunks, then inside one chunk.
The work is a pass over the rows without a shuffle; the memo is emptied when it holds ``MEMO_BYTES``.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Sequence
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.llm.textarrays import prefix_hash, slices, text_bytes, windows

PIECE = 1 << 20
#: Bytes that the rolling hash sees.
ROLLING = 32
#: A chunk has 2**CHUNK_BITS bytes on average.
CHUNK_BITS = 10
#: Bytes of chunks that a worker's memo holds at most; bounds memory only, results do not depend on it.
MEMO_BYTES = 32 << 20
#: Bytes that a summary takes besides its chunk, and for each line.
SUMMARY_BYTES, LINE_BYTES = 600, 16

# fixed values: the marks before prefix, suffix and middle
MARKS = ("<P>", "<S>", "<M>")
SEED = "7"
#: Of a hundred texts, how many are rearranged, and how many of those put the suffix first.
RATE, SUFFIX_FIRST = 100, 50


@dataclass(slots=True)
class Summary:
    """What is known of a stretch of text: enough to combine it with the stretch behind it."""

    chars: int
    lines: int  # ends of lines
    marked: bool  # holds a mark
    head: bytes  # first and last bytes, one fewer than a mark's
    tail: bytes


@dataclass(slots=True)
class Chunk(Summary):
    ends: np.ndarray  # bytes up to and with each end of a line
    chars_to: np.ndarray  # code points up to there


def joined(a: Summary, b: Summary, marks: Sequence[bytes]) -> Summary:
    """Summary of ``a`` followed by ``b``."""
    edge = max(map(len, marks)) - 1
    seam = a.tail + b.head
    return Summary(
        a.chars + b.chars,
        a.lines + b.lines,
        a.marked or b.marked or any(m in seam for m in marks),
        a.head if len(a.head) == edge else (a.head + b.head)[:edge],
        b.tail if len(b.tail) == edge else (a.tail + b.tail)[-edge:],
    )


def chunk_ends(data: np.ndarray, offsets: np.ndarray, bits: int = CHUNK_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Ends of all chunks and, per text, the range of its chunks. Every text ends a chunk; an empty one has none."""
    cut = np.zeros(len(data) + 1, bool)
    rolling = windows(prefix_hash(data + np.uint64(1)), ROLLING)
    at = np.flatnonzero((rolling & np.uint64((1 << bits) - 1)) == 0) + ROLLING
    text = np.searchsorted(offsets, at, "left") - 1
    cut[at[at - offsets[text] >= ROLLING]] = True  # what the hash saw lies in one text
    cut[offsets[1:][np.diff(offsets) > 0]] = True
    ends = np.flatnonzero(cut)
    return ends, np.searchsorted(ends, offsets, "right")


class Memo:
    """Summaries of the chunks a worker has met."""

    def __init__(self, marks: Sequence[bytes], most: int = MEMO_BYTES):
        self.marks, self.most = marks, most
        self.edge = max(map(len, marks)) - 1
        self.known: dict[bytes, Chunk] = {}
        self.bytes = self.asked = self.met = 0

    def of(self, body: bytes) -> Chunk:
        found = self.known.get(body)  # equal hashes are compared byte by byte
        self.asked += 1
        if found is not None:
            self.met += 1
            return found
        raw = np.frombuffer(body, np.uint8)
        ends = np.flatnonzero(raw == 0x0A) + 1
        chars = np.cumsum((raw & 0xC0) != 0x80)
        found = Chunk(
            int(chars[-1]), len(ends), any(m in body for m in self.marks), body[: self.edge], body[-self.edge :], ends, chars[ends - 1]
        )
        self.bytes += len(body) + SUMMARY_BYTES + LINE_BYTES * len(ends)
        if self.bytes > self.most:
            self.known.clear()
            self.bytes = len(body) + SUMMARY_BYTES + LINE_BYTES * len(ends)
        self.known[body] = found
        return found


def draws(seed: str, id_text: str) -> list[int]:
    """Four numbers of a document, from the digest of the seed and its id."""
    digest = hashlib.sha256(f"{seed}:{id_text}".encode()).hexdigest()
    return [int(digest[k : k + 8], 16) for k in (0, 8, 16, 24)]


class Rearranger:
    """Rearranges the texts of a piece with one memo."""

    def __init__(self, seed: str, rate: int, suffix_first: int, marks: Sequence[str], bits: int = CHUNK_BITS):
        self.seed, self.rate, self.suffix_first, self.bits = seed, rate, suffix_first, bits
        self.marks = [m.encode() for m in marks]
        self.memo = Memo(self.marks)

    def text(self, id_text: str, body: bytes, chunks: list[Chunk], starts: list[int]) -> tuple:
        """(lines, form, code points of prefix and of middle, output) of one text."""
        if not chunks:
            return 0, "plain", None, None, b""
        whole: Summary = chunks[0]
        for c in chunks[1:]:
            whole = joined(whole, c, self.marks)
        n = whole.lines + (body[-1] != 0x0A)
        h1, h2, h3, h4 = draws(self.seed, id_text)
        if whole.marked or h3 % 100 >= self.rate:
            return n, "plain", None, None, body
        lines = list(accumulate(c.lines for c in chunks))
        chars = list(accumulate((c.chars for c in chunks), initial=0))

        def cut(units: int) -> tuple[int, int]:
            """Bytes and code points before the cut behind so many lines."""
            if units == 0:
                return 0, 0
            if units > whole.lines:
                return len(body), whole.chars
            k = bisect_left(lines, units)
            at = units - 1 - (lines[k] - chunks[k].lines)
            return starts[k] + int(chunks[k].ends[at]), chars[k] + int(chunks[k].chars_to[at])

        (a, a_chars), (b, b_chars) = map(cut, sorted((h1 % (n + 1), h2 % (n + 1))))
        prefix, middle, suffix = body[:a], body[a:b], body[b:]
        p, s, m = self.marks
        if h4 % 100 < self.suffix_first:
            return n, "spm", a_chars, b_chars - a_chars, b"".join((s, suffix, p, prefix, m, middle))
        return n, "psm", a_chars, b_chars - a_chars, b"".join((p, prefix, s, suffix, m, middle))

    def piece(self, ids: list[str], data: np.ndarray, offsets: np.ndarray) -> list[tuple]:
        ends, first = chunk_ends(data, offsets, self.bits)
        body, bounds, first, at = data.tobytes(), [0, *ends.tolist()], first.tolist(), offsets.tolist()
        out = []
        for k, id_text in enumerate(ids):
            own = range(first[k], first[k + 1])
            chunks = [self.memo.of(body[bounds[j] : bounds[j + 1]]) for j in own]
            out.append(self.text(id_text, body[at[k] : at[k + 1]], chunks, [bounds[j] - at[k] for j in own]))
        return out


def rearranged(
    docs: DataFrame,
    seed: str = SEED,
    rate: int = RATE,
    suffix_first: int = SUFFIX_FIRST,
    marks: Sequence[str] = MARKS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: its id, number of lines ``n``, ``form`` (plain, psm or spm), ``prefix_chars`` and
    ``middle_chars`` (code points; null if plain) and the rearranged text ``output``.

    A text is plain if it is empty or null, holds a mark, or is not among the ``rate`` of a hundred. A null id draws as
    ``null``; rows with one id draw alike. Other columns are ignored; an empty table gives no rows. ``marks`` must not be
    able to overlap each other or themselves.
    """
    src = docs.select(
        docs[id_col].alias("id"),
        F.coalesce(docs[id_col].cast("string"), F.lit("null")).alias("name"),
        docs[text_col].cast("string").alias("body"),
    )
    schema = T.StructType(
        [
            T.StructField(id_col, src.schema["id"].dataType),
            T.StructField("n", T.LongType()),
            T.StructField("form", T.StringType()),
            T.StructField("prefix_chars", T.LongType()),
            T.StructField("middle_chars", T.LongType()),
            T.StructField("output", T.StringType()),
        ]
    )

    def run(batches):
        own = Rearranger(seed, rate, suffix_first, marks)
        for batch in batches:
            names = batch.column(1).to_pylist()
            data, offsets = text_bytes(batch.column(2))
            for a, b in slices(offsets, PIECE):
                rows = own.piece(names[a:b], data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                n, form, prefix, middle, output = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        pa.array(n, pa.int64()),
                        pa.array(form, pa.string()),
                        pa.array(prefix, pa.int64()),
                        pa.array(middle, pa.int64()),
                        pa.array(output, pa.binary()).cast(pa.string()),
                    ],
                    names=schema.names,
                )

    return src.mapInArrow(run, schema)


def restored(output: Column, form: Column, marks: Sequence[str] = MARKS) -> Column:
    """The text that was rearranged. Marks occur in an output only where they were put."""
    parts = F.split(output, "|".join(rf"\Q{m}\E" for m in marks), -1)
    psm = F.concat(parts[1], parts[3], parts[2])
    spm = F.concat(parts[2], parts[3], parts[1])
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def rearrangement_digest(rows: DataFrame, id_col: str = "doc_id", marks: Sequence[str] = MARKS) -> DataFrame:
    """``rearranged`` rows with SHA-256 of the output and of the text restored from it in place of the output."""
    back = restored(F.col("output"), F.col("form"), marks)
    return rows.select(
        id_col, "n", "form", "prefix_chars", "middle_chars",
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(back.cast("binary"), 256).alias("restored_sha256"),
    )
