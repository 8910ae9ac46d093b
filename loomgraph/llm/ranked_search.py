"""Ranked lexical search by NRA: no random access, impact-sorted lists read in order.

One scan of the documents counts terms and writes the postings of every term that some item has. Their scores need figures
of the whole corpus (documents, terms, documents per term) and are whole numbers, so a sum is the same in any order.
Documents are dealt into shards of bounded size; a task takes a shard and a block of items, sorts each term's postings by
impact, and reads the lists of an item in step. For every document met it holds an interval: what was read, and that plus
the next impact of each list that has not shown it. Reading goes on until no other document can enter or tie with the best
``k`` and the scores of those are final. The best of all shards meet by item.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.llm.repeats import pieces
from loomgraph.llm.textarrays import LOWER, Words, prefix_hash, ranges
from loomgraph.operators.scale import salted_join
from loomgraph.session import materialize

K = 10
#: Documents of a shard, about; a task holds the postings of one shard for one block of items.
SHARD_DOCS = 4096
#: Items of a block, about.
BLOCK_ITEMS = 512
#: Postings first read from each list; every further read is four times as deep.
FIRST_READ = 64
#: Bits of the filter that tells a scan which terms no item has. Others that pass it go in the join with the items' terms.
FILTER_BITS = 1 << 22
#: Documents a task numbers at most.
ROW_BITS = 36

# fixed values: terms are runs of digits, letters A-Z and a-z, and characters beyond ASCII
SEPARATOR = np.ones(256, bool)
SEPARATOR[list(range(0x30, 0x3A)) + list(range(0x41, 0x5B)) + list(range(0x61, 0x7B)) + list(range(0x80, 0x100))] = False
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWERED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def terms_of(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWERED), F.lit(TERM), 0)


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``(item, term)``, each once. Rows with one id, null too, are one item."""
    return items.select(items[id_col].alias("item"), F.explode(terms_of(items[text_col])).alias("term")).distinct()


def term_bits(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit keys of byte ranges and their places in the filter."""
    keys = ranges(prefix_hash(data + np.uint64(1)), start, end)
    return keys, (keys >> np.uint64(40)).astype(np.int64) & (FILTER_BITS - 1)


def term_filter(terms: DataFrame) -> np.ndarray:
    """Bitmap of fixed size of all terms: each task's share is reduced to set bytes, at most ``FILTER_BITS / 8`` of them."""

    def run(batches):
        bits = np.zeros(FILTER_BITS, bool)
        for batch in batches:
            for _, _, data, offsets in pieces(batch.column(0)):
                full = np.diff(offsets) > 0
                bits[term_bits(data, offsets[:-1][full], offsets[1:][full])[1]] = True
        packed = np.packbits(bits)
        at = np.flatnonzero(packed)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(packed[at].astype(np.int32))], names=["at", "byte"])

    found = terms.select("term").distinct().mapInArrow(run, "at int, byte int")
    out = np.zeros(FILTER_BITS // 8, np.uint8)
    table = found.groupBy("at").agg(F.bit_or("byte").alias("byte")).toArrow()
    out[table.column("at").to_numpy()] = table.column("byte").to_numpy().astype(np.uint8)
    return np.unpackbits(out).astype(bool)


def counted_terms(docs: DataFrame, wanted: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(row, doc, n, term, tf)`` for each document and each of its terms that passes the filter.

    ``row`` numbers the documents that have a term. A task adds a row with a null ``doc`` and ``term`` whose ``row`` and
    ``n`` are its number of such documents and of their terms.
    """
    src = docs.select(docs[id_col].alias("doc"), docs[text_col].cast("string").alias("body"))
    names = ["row", "doc", "n", "term", "tf"]
    kind = src.schema["doc"].dataType
    schema = T.StructType(
        [
            T.StructField("row", T.LongType()),
            T.StructField("doc", kind),
            T.StructField("n", T.LongType()),
            T.StructField("term", T.StringType()),
            T.StructField("tf", T.LongType()),
        ]
    )

    def run(batches):
        held, total, base = 0, 0, TaskContext.get().partitionId() << ROW_BITS
        arrow_kind = None
        for batch in batches:
            arrow_kind = batch.schema.field(0).type
            for first, last, data, offsets in pieces(batch.column(1)):
                data = LOWER[data]
                words = Words(data, offsets, SEPARATOR)
                keys, bits = term_bits(data, words.start, words.end)
                text = words.of_text()
                number = held + np.cumsum(words.count > 0) - 1
                held += int((words.count > 0).sum())
                total += int(words.count.sum())
                pick = np.flatnonzero(wanted[bits])
                if not len(pick):
                    continue
                # equal keys of a document are one term, which a look at the bytes confirms
                size = words.end - words.start
                order, new = _grouped(pick, keys[pick], text[pick])
                if _differ(data, words.start[order], size[order], new):
                    exact = _numbered(data, words.start[pick], words.end[pick])
                    order, new = _grouped(pick, exact, text[pick])
                lead = order[new]
                tf = np.diff(np.r_[np.flatnonzero(new), len(order)])
                body, at = _gathered(data, words.start[lead], size[lead])
                term = pa.StringArray.from_buffers(
                    len(lead), pa.py_buffer(np.r_[at, len(body)].astype(np.int32)), pa.py_buffer(body.tobytes())
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(base + number[text[lead]]),
                        batch.column(0).take(pa.array(first + text[lead])),
                        pa.array(words.count[text[lead]].astype(np.int64)),
                        term,
                        pa.array(tf.astype(np.int64)),
                    ],
                    names=names,
                )
        if arrow_kind is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array([held]), pa.nulls(1, arrow_kind), pa.array([total]), pa.array([None], pa.string()), pa.array([0])], names=names
            )

    return src.mapInArrow(run, schema)


def _gathered(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The byte ranges one behind another, and where each begins there."""
    begin = np.cumsum(size) - size
    within = np.arange(int(size.sum())) - np.repeat(begin, size)
    return data[np.repeat(start, size) + within], begin


def _grouped(pick: np.ndarray, keys: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words by text and key, and where a new pair begins."""
    by = np.lexsort((keys, text))
    new = np.ones(len(by), bool)
    new[1:] = (np.diff(keys[by]) != 0) | (np.diff(text[by]) != 0)
    return pick[by], new


def _differ(data: np.ndarray, start: np.ndarray, size: np.ndarray, new: np.ndarray) -> bool:
    """Does a word differ from the first of its group?"""
    lead = np.flatnonzero(new)[np.cumsum(new) - 1]
    if (size != size[lead]).any():
        return True
    flat, begin = _gathered(data, start, size)
    within = np.arange(len(flat)) - np.repeat(begin, size)
    return bool((flat != flat[np.repeat(begin[lead], size) + within]).any())


def _numbered(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A number for each different word, by its bytes; for pieces in which keys collide."""
    body, names = data.tobytes(), {}
    own = (body[a:b] for a, b in zip(start.tolist(), end.tolist()))
    return np.array([names.setdefault(w, len(names)) for w in own], np.int64)


class Lists:
    """A shard's postings: the lists of all terms, each by falling impact."""

    def __init__(self, term: np.ndarray, doc: np.ndarray, score: np.ndarray):
        order = np.lexsort((doc, -score, term))
        self.term, self.doc, self.score = term[order], doc[order], score[order]

    def of(self, terms: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(documents, impacts) of each term that has postings."""
        low, high = np.searchsorted(self.term, terms, "left"), np.searchsorted(self.term, terms, "right")
        return [(self.doc[a:b], self.score[a:b]) for a, b in zip(low.tolist(), high.tolist()) if b > a]


def best_by_intervals(
    lists: list[tuple[np.ndarray, np.ndarray]], n_docs: int, tie: np.ndarray, k: int = K, first_read: int = FIRST_READ
) -> tuple[np.ndarray, np.ndarray, int]:
    """The ``k`` documents with the highest sum above 0, equal ones by rising ``tie``; their sums; postings read.

    ``lists`` are (documents, falling impacts); documents are numbers below ``n_docs``. Lists are read in step and only
    forwards. A list is read on only while it can still change something: first membership, then the members' scores.
    """
    low = np.zeros(n_docs, np.int64)
    # what is still open of a document: the next impacts of the lists that have not shown it
    shown = np.zeros((len(lists), n_docs), bool)
    at = [0] * len(lists)
    bound = np.array([s[0] for _, s in lists], np.int64)
    step, read, members = first_read, 0, None
    while True:
        for j, (doc, score) in enumerate(lists):
            if bound[j] == 0 or members is not None and shown[j][members].all():
                continue
            own = slice(at[j], at[j] + step)
            low[doc[own]] += score[own]
            shown[j][doc[own]] = True
            read += len(doc[own])
            at[j] += step
            bound[j] = score[at[j]] if at[j] < len(score) else 0
        step *= 4
        met = np.flatnonzero(low > 0)
        open_to = bound @ ~shown[:, met] if len(met) else np.zeros(0, np.int64)
        high = low[met] + open_to
        if members is None:
            rest = int(bound.sum())  # a document not met at all
            if len(met) > k:
                kth = np.partition(low[met], len(met) - k)[len(met) - k]
                rival = high >= kth
                # all others are strictly below the k-th lower end, so they cannot even tie
                if rest >= kth and rest > 0:
                    continue
                if rival.sum() > k and (open_to[rival] > 0).any():
                    continue
                members = met[rival]
            elif rest > 0:
                continue
            else:
                members = met
        if not len(members) or not (bound @ ~shown[:, members]).any():
            break
    order = members[np.lexsort((tie[members], -low[members]))][:k]
    return order, low[order], read


def search(
    docs: DataFrame,
    items: DataFrame,
    k: int = K,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
    shard_docs: int = SHARD_DOCS,
    block_items: int = BLOCK_ITEMS,
) -> DataFrame:
    """The ``k`` best rows of ``docs`` for each item: its id, ``rank`` from 1, the document's id and its ``score``.

    Only scores above 0 count; equal ones go by rising document id, null last. Each row of ``docs`` is a document of its
    own, also where ids or texts repeat; rows of ``items`` with one id are one item with the terms of all. Null and empty
    texts have no terms; items without a term, an empty table of items or of documents give no rows. Other columns are
    ignored.
    """
    # the pairs of item and term are read several times: for the filter, the weights and the lists
    block = F.pmod(F.xxhash64(F.coalesce(F.col("item").cast("string"), F.lit("null"))), F.lit(1 << 30))
    pairs = materialize(item_terms(items, item_col, item_text), "item-terms")
    n_items = pairs.select("item").distinct().count()
    blocks = max(1, -(-n_items // block_items))
    pairs = pairs.withColumn("block", (block % blocks).cast("int"))
    counted = materialize(counted_terms(docs, term_filter(pairs), id_col, text_col), "terms")
    whole = counted.where("term IS NULL").agg(F.sum("row"), F.sum("n")).first()
    n_docs, n_terms = int(whole[0] or 0), int(whole[1] or 0)
    shards = max(1, -(-n_docs // shard_docs))

    found = counted.where("term IS NOT NULL")
    df = found.groupBy("term").agg(F.count("*").alias("df"))
    w = F.floor(1000 * F.log(F.lit(2.0 * n_docs + 2) / (2 * F.col("df") + 1).cast("double"))).cast("long")
    # a number stands for the term in the lists; it is drawn once and written
    weights = df.select("term", w.alias("w")).where("w > 0").withColumn("code", F.monotonically_increasing_id())
    weights = materialize(weights, "term-weights").join(pairs.select("term", "block").distinct(), "term")
    weights = materialize(weights, "term-blocks")
    m = f"(10L + (90L * n * {n_docs}L) div {max(n_terms, 1)}L)"
    score = F.col("w") * F.expr(f"(1000000000L * tf) div (1000L * tf + 8L * {m})")
    shard = F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int")
    postings = salted_join(found, weights, ["term"], F.col("row")).select(
        "block", shard.alias("shard"), "row", "doc", "code", score.alias("score")
    )
    # an item's lists go wherever its block meets a shard
    own = weights.select("term", "block", F.col("code").alias("asked"))
    every = pairs.join(own, ["term", "block"]).select(
        "block", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "item", "asked"
    )
    schema = T.StructType(
        [
            T.StructField("item", pairs.schema["item"].dataType),
            T.StructField("row", T.LongType()),
            T.StructField("doc", docs.schema[id_col].dataType),
            T.StructField("score", T.LongType()),
            T.StructField("n_read", T.LongType()),
        ]
    )

    def of_shard(postings: pa.Table, asked: pa.Table) -> pa.Table:
        return _best_of_shard(postings, asked, k)

    keys = ["block", "shard"]
    local = postings.groupBy(*keys).cogroup(every.groupBy(*keys)).applyInArrow(of_shard, schema)
    order = W.partitionBy("item").orderBy(F.desc("score"), F.col("doc").asc_nulls_last(), "row")
    best = local.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select(F.col("item").alias(item_col), "rank", F.col("doc").alias(id_col), "score")


def _best_of_shard(postings: pa.Table, asked: pa.Table, k: int) -> pa.Table:
    """The best documents of one shard for every item of one block."""
    names = ["item", "row", "doc", "score", "n_read"]
    kinds = [asked.schema.field("item").type, pa.int64(), postings.schema.field("doc").type, pa.int64(), pa.int64()]
    if not len(postings) or not len(asked):
        return pa.table([pa.array([], t) for t in kinds], names=names)
    rows, doc = np.unique(postings.column("row").to_numpy(), return_inverse=True)
    one = np.zeros(len(rows), np.int64)
    one[doc] = np.arange(len(doc))
    ids = postings.column("doc").take(pa.array(one))
    # equal scores go by id, then by row; nulls last
    tie = np.empty(len(rows), np.int64)
    tie[pc.sort_indices(pa.table([ids, pa.array(rows)], names=["a", "b"]), [("a", "ascending"), ("b", "ascending")]).to_numpy()] = np.arange(len(rows))
    lists = Lists(postings.column("code").to_numpy(), doc, postings.column("score").to_numpy())
    item = asked.column("item").combine_chunks().dictionary_encode()
    codes = asked.column("asked").to_numpy()
    number = item.indices.fill_null(len(item.dictionary)).to_numpy(zero_copy_only=False)
    order = np.argsort(number, kind="stable")
    edge = np.flatnonzero(np.r_[True, np.diff(number[order]) != 0, True])
    at_item, at_row, scores, n_read = [], [], [], []
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
        own = lists.of(np.sort(codes[order[a:b]]))
        if own:
            best, score, read = best_by_intervals(own, len(rows), tie, k)
            at_item.append(np.full(len(best), order[a]))
            at_row.append(best)
            scores.append(score)
            n_read.append(np.full(len(best), read))
    if not at_item:
        return pa.table([pa.array([], t) for t in kinds], names=names)
    at = np.concatenate(at_row)
    return pa.table(
        [
            asked.column("item").take(pa.array(np.concatenate(at_item))),
            pa.array(rows[at]),
            ids.take(pa.array(at)),
            pa.array(np.concatenate(scores)),
            pa.array(np.concatenate(n_read)),
        ],
        names=names,
    )
