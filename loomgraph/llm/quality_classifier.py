"""Quality classifier with supervised subword embeddings.

A document is the average of learned vectors of its words, of the character n-grams inside them and of how far back each
word was seen before, all hashed into one table; a linear layer and softmax make a score of it. Table and layer are trained
by stochastic gradient descent in numpy: the labelled sample is dealt into shards, each trains a copy of its own for a
round, and the copies are averaged, by blocks of the table, before the next. The model has a fixed size and is handed to
the tasks. Average and layer are both linear, so a whole text is scored by summing one number per feature, in one pass
without a shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.llm.repeats import pieces
from loomgraph.llm.textarrays import mix, prefix_hash, ranges, windows
from loomgraph.session import materialize

#: Rows of the table, by the low bits of a feature's hash.
BUCKET_BITS = 17
DIM = 16
#: Lengths of the character n-grams of a word, whose ends count as a character.
GRAMS = (3, 4, 5)
#: Labelled documents that are trained on at most, those with the smallest digests of their ids.
SAMPLE = 4096
SHARDS, ROUNDS, EPOCHS = 8, 3, 4
RATE = 0.3
#: Rows of the table that are averaged by one task.
BLOCK = 1 << 13

# fixed values: the separators of words are space and U+0009 to U+000D
_SPACE = np.zeros(0x110000, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


@dataclass
class Model:
    table: np.ndarray = field(default_factory=lambda: first_table())  # (buckets, DIM)
    layer: np.ndarray = field(default_factory=lambda: first_layer())
    bias: np.ndarray = field(default_factory=lambda: np.zeros(2, np.float32))

    def logits(self) -> np.ndarray:
        """What a feature adds to the odds of label 1, before the average."""
        return (self.table @ (self.layer[1] - self.layer[0])).astype(np.float64)

    def scores(self, bags: Bags) -> np.ndarray:
        """Probability of label 1 of each text; a text without features has the odds of the bias."""
        own = self.logits()
        z = bags.average(own[bags.bucket]) + float(self.bias[1] - self.bias[0])
        return np.where(z >= 0, 1 / (1 + np.exp(-np.abs(z))), np.exp(-np.abs(z)) / (1 + np.exp(-np.abs(z))))


def first_table() -> np.ndarray:
    """Small numbers, the same in every run."""
    return np.random.default_rng(1).uniform(-0.01, 0.01, (1 << BUCKET_BITS, DIM)).astype(np.float32)


def first_layer() -> np.ndarray:
    """Opposite directions of length 1 for the two labels."""
    one = np.random.default_rng(2).choice([-1, 1], DIM) / np.sqrt(DIM)
    return np.stack([-one, one]).astype(np.float32)


@dataclass
class Bags:
    """Features of some texts: buckets in a row, and the range of each text."""

    bucket: np.ndarray
    first: np.ndarray

    def average(self, values: np.ndarray) -> np.ndarray:
        run = np.zeros(len(values) + 1)
        np.cumsum(values, out=run[1:])
        n = np.diff(self.first)
        return (run[self.first[1:]] - run[self.first[:-1]]) / np.maximum(n, 1)


def features(data: np.ndarray, offsets: np.ndarray) -> Bags:
    """Buckets of all words and n-grams of the texts, repeats included."""
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    begins = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=begins[1:])
    at = begins[offsets]  # offsets in code points
    # one mark stands before, between and behind the words; a text begins and ends with one
    n = len(offsets) - 1
    cell = np.zeros(len(points) + n + 1, np.uint64)
    place = np.arange(len(points)) + np.repeat(np.arange(1, n + 1), np.diff(at))
    cell[place] = np.where(_SPACE[points], 0, points + 1)
    edge = cell == 0
    text = np.cumsum(np.bincount(at[1:] + np.arange(1, n + 1), minlength=len(cell))) if n else np.zeros(len(cell), np.int64)
    sums = prefix_hash(cell + np.uint64(1))
    marks = np.zeros(len(cell) + 1, np.int64)
    np.cumsum(edge, out=marks[1:])
    start = np.flatnonzero(edge[:-1] & ~edge[1:]) + 1
    end = np.flatnonzero(~edge[:-1] & edge[1:]) + 1
    own, owns = ranges(sums, start, end), text[start]
    found, owner = [own], [owns]
    # how far back the same word was seen, in powers of two, is a further feature of a word
    order = np.lexsort((own, owns))
    back = np.diff(order)
    same = (own[order][1:] == own[order][:-1]) & (owns[order][1:] == owns[order][:-1])
    found.append(mix(np.frexp(back[same])[1].astype(np.uint64) + np.uint64(1 << 40)))
    owner.append(owns[order][1:][same])
    for size in GRAMS:
        if len(cell) < size:
            continue
        count = len(cell) - size + 1
        inner = marks[size - 1 : size - 1 + count] == marks[1 : 1 + count]  # marks at the ends only
        own = np.flatnonzero(inner)
        found.append(windows(sums, size)[own] + np.uint64(size))
        owner.append(text[own + 1])
    bucket = (np.concatenate(found) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
    owner = np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return Bags(bucket[order], np.searchsorted(owner[order], np.arange(n + 1)))


def train(model: Model, texts: Sequence[str], labels: np.ndarray, seed: int, epochs: int, rate: float) -> Model:
    """A copy of the model after some epochs of stochastic gradient descent over the texts, one text a step.

    The step of the vectors is divided by the squared norm of the text's shares, so that a long text, whose features
    have small shares, moves its average as far as a short one does.
    """
    table, layer, bias = model.table.copy(), model.layer.copy(), model.bias.copy()
    bags = []
    for text in texts:
        body = np.frombuffer(text.encode(), np.uint8)
        bucket, count = np.unique(features(body, np.array([0, len(body)])).bucket, return_counts=True)
        share = (count / max(count.sum(), 1)).astype(np.float32)
        bags.append((bucket, share, share / max(float(share @ share), 1e-12)))
    rng = np.random.default_rng(seed)
    steps, done = max(1, epochs * len(bags)), 0
    for _ in range(epochs):
        for k in rng.permutation(len(bags)):
            bucket, share, move = bags[k]
            now = np.float32(rate * (1 - done / steps))
            vector = share @ table[bucket]
            z = layer @ vector + bias
            wrong = np.exp(z - z.max())
            wrong /= wrong.sum()
            wrong[labels[k]] -= 1
            back = wrong @ layer
            layer -= now * np.outer(wrong, vector) / (1 + vector @ vector)
            bias -= now * wrong
            table[bucket] -= now * move[:, None] * back
            done += 1
    return Model(table, layer, bias)


def is_held_out(id_column: Column) -> Column:
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def training_sample(
    docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample: int
) -> DataFrame:
    """``(name, body, label)`` of at most ``sample`` labelled documents that are not held out.

    A document with several texts gives the first of them by order, one with several labels gives the larger.
    """
    usable = labels.where(~is_held_out(labels[id_col]) & labels[id_col].isNotNull() & labels[label_col].isin(0, 1))
    own = usable.groupBy(usable[id_col].cast("string").alias("name")).agg(F.max(label_col).cast("int").alias("label"))
    present = docs.where(docs[id_col].isNotNull()).select(docs[id_col].cast("string").alias("name"))
    chosen = own.join(present, "name", "left_semi").orderBy(F.md5("name"), "name").limit(sample)
    texts = docs.select(docs[id_col].cast("string").alias("name"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("body"))
    # the chosen names are written, so their size is known to the join
    chosen = materialize(chosen, "chosen")
    return texts.join(chosen, "name").groupBy("name", "label").agg(F.min("body").alias("body"))


def learn(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    sample: int = SAMPLE,
    shards: int = SHARDS,
    rounds: int = ROUNDS,
    epochs: int = EPOCHS,
    rate: float = RATE,
) -> Model:
    """A model of at most ``sample`` labelled documents that are not held out.

    A round trains a copy per shard; what reaches the driver is one averaged model of fixed size. Without labelled
    documents the model says 0.5 of every text.
    """
    chosen = training_sample(docs, labels, id_col, text_col, label_col, sample)
    shard = F.pmod(F.xxhash64("name", F.lit(7)), F.lit(shards)).cast("int")
    chosen = materialize(chosen.withColumn("shard", shard), "quality-sample")
    spark, model = docs.sparkSession, Model()
    for turn in range(rounds):
        sent = spark.sparkContext.broadcast(model)  # of fixed size
        copies = chosen.groupBy("shard").applyInArrow(_copy_of(sent, turn, epochs, rate * (1 - turn / rounds)), BLOCKS)
        found = copies.groupBy("block").applyInArrow(_mean, BLOCKS).toArrow().sort_by("block")
        values = [np.frombuffer(v, np.float32) for v in found.column("values").to_pylist()]
        if not values:
            return Model(np.zeros_like(model.table))
        rest = values[-1]
        model = Model(np.concatenate(values[:-1]).reshape(-1, DIM), rest[: 2 * DIM].reshape(2, DIM), rest[2 * DIM :])
    return model


#: Rows ``BLOCK`` by ``BLOCK`` of a table and, last, the layer.
BLOCKS = "block int, values binary"


def _copy_of(sent: Broadcast, turn: int, epochs: int, rate: float):
    """Trains one shard's copy."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("name")
        label = np.array(table.column("label").to_pylist(), np.int64)
        own = train(sent.value, table.column("body").to_pylist(), label, turn, epochs, rate)
        parts = [own.table[k : k + BLOCK].tobytes() for k in range(0, len(own.table), BLOCK)]
        parts.append(np.r_[own.layer.ravel(), own.bias].astype(np.float32).tobytes())
        return pa.table({"block": pa.array(range(len(parts)), pa.int32()), "values": pa.array(parts, pa.binary())})

    return run


def _mean(table: pa.Table) -> pa.Table:
    """The average of all copies of one block, in an order of their own."""
    total = sum(np.frombuffer(v, np.float32).astype(np.float64) for v in sorted(table.column("values").to_pylist()))
    out = (total / len(table)).astype(np.float32).tobytes()
    return pa.table({"block": table.column("block").slice(0, 1), "values": pa.array([out], pa.binary())})


def quality_scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, held_out, score, predicted)`` of every row of ``docs``.

    A null text counts as empty and gets the score of a text without features; a null id is held out or not as an empty
    one; repeated ids and rows are scored each. Other columns are ignored; an empty table gives no rows.
    """
    src = docs.select(docs[id_col].alias("id"), is_held_out(docs[id_col]).alias("held"), docs[text_col].cast("string").alias("body"))
    schema = T.StructType(
        [
            T.StructField(id_col, src.schema["id"].dataType),
            T.StructField("held_out", T.BooleanType()),
            T.StructField("score", T.DoubleType()),
            T.StructField("predicted", T.IntegerType()),
        ]
    )
    sent = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size

    def run(batches):
        for batch in batches:
            for a, b, data, offsets in pieces(batch.column(2)):
                score = sent.value.scores(features(data, offsets))
                yield pa.RecordBatch.from_arrays(
                    [*(c.slice(a, b - a) for c in batch.columns[:2]), pa.array(score), pa.array((score >= 0.5).astype(np.int32))],
                    names=schema.names,
                )

    return src.mapInArrow(run, schema)


def quality_report(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``quality_scores`` of every row of ``docs`` under a model learned from it and ``labels``."""
    return quality_scores(docs, learn(docs, labels, id_col, text_col, **options), id_col, text_col)
