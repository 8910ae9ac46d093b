"""Token ids as ORC files.

Documents are dealt out by ranges of their id and sorted, so that files and stripes hold disjoint id ranges in ascending
order. Ids of tokens are integers in ORC's run-length encoding; row indexes and a Bloom filter on the document id let a
reader skip stripes, and each stripe can be read by a task of its own. Texts are encoded with the tokenizers library:
white space is never part of a token of the vocabularies this is for, so each distinct word is encoded once per worker.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.llm.textarrays import slices, text_bytes

END_ID = 1
PIECE = 2 << 20
#: Rows of an Arrow batch, in and out.
BATCH_ROWS = 1000
#: Words that a worker keeps with their ids; others are encoded once per piece. Bounds the worker's memory only.
KEPT_WORDS = 600_000
ORC_OPTIONS = {
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
    "orc.row.index.stride": "1000",
    "orc.stripe.size": str(8 << 20),
}
# letters whose lower case and composed form are one character, with ASCII marks behind them
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?]*)").fullmatch
_workers: dict[str, WordEncoder] = {}


class Places(dict):
    """Numbers words in the order in which they are first asked for."""

    def __missing__(self, word: bytes) -> int:
        place = self[word] = len(self)
        return place


class WordEncoder:
    """Ids of words that hold no white space; a text's ids are those of its words in turn."""

    def __init__(self, definition: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_str(definition)
        self.model = self.tokenizer.model  # each access to the attribute makes an object
        self.bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.plain = self._splits_at_marks()
        self.place = Places()
        self.flat = np.zeros(0, np.int32)  # ids of the kept words in a row, and how many each has
        self.size = np.zeros(0, np.int64)

    def _splits_at_marks(self) -> bool:
        """May letters and the marks behind them be encoded apart, past normalisation? Asked of the vocabulary itself."""
        try:
            return all(
                self._apart(_PLAIN(w)) == self.tokenizer.encode(w, add_special_tokens=False).ids
                for w in ("Word", "word,", "Ärger...", "été?!", "niño;", "ÀÿX:")
            )
        except Exception:  # noqa: BLE001  another kind of model
            return False

    def _part(self, part: str) -> list[int]:
        if not part.isascii():
            part = self.bytes.pre_tokenize_str(part)[0][0]
        return [t.id for t in self.model.tokenize(part)]

    def _apart(self, found: re.Match) -> list[int]:
        ids = self._part(found[1].lower())
        return ids + self._part(found[2]) if found[2] else ids

    def encode(self, words: list[bytes]) -> list[list[int]]:
        out: list[list[int] | None] = [None] * len(words)
        whole = []
        parts: dict[str, list[int]] = {}
        tokenize = self.model.tokenize
        for k, word in enumerate(words):
            text = word.decode()
            if self.plain and word.isalpha() and word.islower():  # of ASCII letters only
                if text not in parts:
                    parts[text] = [t.id for t in tokenize(text)]
                out[k] = parts[text]
                continue
            found = _PLAIN(text) if self.plain else None
            if found:
                letters, marks = found[1].lower(), found[2]
                for part in (letters, marks) if marks else (letters,):
                    if part not in parts:
                        parts[part] = self._part(part)
                out[k] = parts[letters] + parts[marks] if marks else parts[letters]
            else:
                whole.append(k)
        encoded = self.tokenizer.encode_batch_fast([words[k].decode() for k in whole], add_special_tokens=False)
        for k, e in zip(whole, encoded):
            out[k] = e.ids
        return out

    def ids_of(self, data: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, each with the end id, and the number of ids of each text."""
        body = data.tobytes()
        # bytes.split() takes the six separators of Words
        words: list[bytes] = []
        count = np.zeros(len(offsets) - 1, np.int64)
        for k, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
            own = body[a:b].split()
            count[k] = len(own)
            words += own
        kept = len(self.size)
        code = np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))
        encoded = self.encode(list(islice(self.place, kept, None)))
        # an end id behind the last word of each text
        size = np.r_[self.size, np.array([len(e) for e in encoded], np.int64)]
        flat = np.r_[self.flat, np.array(list(chain.from_iterable(encoded)), np.int32), np.int32(end_id)]
        starts = np.zeros(len(size) + 1, np.int64)
        np.cumsum(size, out=starts[1:])
        ends = np.cumsum(count) + np.arange(len(count))
        order = np.full(len(code) + len(count), len(size), np.int64)
        inner = np.ones(len(order), bool)
        inner[ends] = False
        order[inner] = code
        known, size = size, np.append(size, 1)[order]
        begin = starts[order]
        total = np.cumsum(size)
        at = np.arange(int(total[-1]) if len(total) else 0) + np.repeat(begin - (total - size), size)
        n_ids = np.diff(np.r_[0, total[ends]]) if len(ends) else np.zeros(0, np.int64)
        while len(self.place) > max(kept, KEPT_WORDS):
            self.place.popitem()  # the latest
        self.size = known[: len(self.place)]
        self.flat = flat[: starts[len(self.place)]]
        return flat[at], n_ids


def encoder(definition: str) -> WordEncoder:
    """This worker's encoder for a tokenizer definition."""
    name = hashlib.md5(definition.encode()).hexdigest()
    if name not in _workers:
        _workers.clear()
        _workers[name] = WordEncoder(definition)
    return _workers[name]


def write_tokens(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    end_id: int = END_ID,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> None:
    """Write every text's ids, in ascending order of the document id, as ORC files below ``path``.

    Columns: doc_id, part and row (the file's number in that order, and the place in it), n_tokens, ids. ``tokenizer``
    is the path of a definition of the tokenizers library. A null text is empty and has the end id only; null document
    ids come first; rows with equal ids follow each other in the order of their texts' digests; an empty table gives
    no rows. Other columns are not written.
    """
    with open(tokenizer, encoding="utf-8") as file:
        definition = file.read()
    text = docs[text_col].cast("string")
    src = docs.select(docs[id_col].alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("tie"))
    kind = src.schema["doc_id"].dataType
    schema = T.StructType(
        [
            T.StructField("doc_id", kind),
            T.StructField("part", T.IntegerType()),
            T.StructField("row", T.LongType()),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("ids", T.ArrayType(T.IntegerType())),
        ]
    )

    def run(batches):
        own, part, row = encoder(definition), TaskContext.get().partitionId(), 0
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            for a, b in slices(offsets, PIECE):
                ids, count = own.ids_of(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], end_id)
                bounds = np.zeros(b - a + 1, np.int32)
                np.cumsum(count, out=bounds[1:])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        pa.array(np.full(b - a, part, np.int32)),
                        pa.array(np.arange(row, row + b - a)),
                        pa.array(count),
                        pa.ListArray.from_arrays(pa.array(bounds), pa.array(ids)),
                    ],
                    names=["doc_id", "part", "row", "n_tokens", "ids"],
                )
                row += b - a

    dealt = src.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    spark, name = docs.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(BATCH_ROWS))  # smaller batches for this write only
    try:
        dealt.mapInArrow(run, schema).write.options(**ORC_OPTIONS).orc(path)
    finally:
        spark.conf.set(name, before)


def read_tokens(spark: SparkSession, path: str, doc_ids: list | None = None) -> DataFrame:
    """The written rows; with ``doc_ids`` those documents only, skipping files and stripes by statistics and Bloom
    filter."""
    rows = spark.read.orc(path)
    return rows if doc_ids is None else rows.where(F.col("doc_id").isin(doc_ids))


def token_digest(rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of rows that ``read_tokens`` returned for a whole folder.

    ``start`` counts the ids of all documents before: a running sum inside each file plus the sum of the files before,
    of which one row each meets in one window.
    """
    src = rows.select("doc_id", "part", "row", "ids")
    schema = T.StructType(
        [*src.schema.fields[:3], T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())]
    )

    def run(batches):
        for batch in batches:
            lists = batch.column(3)
            body = lists.values.to_numpy(zero_copy_only=False).astype("<u4")
            at = lists.offsets.to_numpy()
            view = memoryview(body).cast("B")
            crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(np.diff(at).astype(np.int64)), pa.array(np.array(crc, np.int64))],
                names=["doc_id", "part", "row", "n_tokens", "ids_crc32"],
            )

    found = src.mapInArrow(run, schema)
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    sizes = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    offsets = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = W.partitionBy("part").orderBy("row").rowsBetween(W.unboundedPreceding, -1)
    placed = found.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    return placed.join(offsets, "part").select(
        F.col("doc_id").alias(id_col), (F.col("offset") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32"
    )
