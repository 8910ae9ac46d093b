"""A stored inverted index that follows its documents, and ranked search that skips what cannot rank.

The index is a versioned folder of segments. A refresh compares digests, tokenises new and changed documents only, and adds a
segment with their postings and the changes in document counts; what a document had before stays in its segment but is no
longer current. Postings of a term lie in blocks, one for each range of about ``RANGE_DOCS`` documents of a segment, with the
largest count and the smallest length in it. A search first scores the most promising blocks: the k-th best sum found there
is a floor for the final k-th score. All terms of a segment share its ranges, so the sum of their blocks' bounds limits every
document of a range, and ranges below the floor are never unpacked.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from loomgraph.functions.text import tokenize
from loomgraph.operators.retrieval import B, K1, count_terms, in_order, lucene_idf, query_terms
from loomgraph.operators.scale import salted_join, top_k
from loomgraph.session import materialize
from loomgraph.sources.versioned import VersionedFolder

RANGE_DOCS = 64
#: Ranges of each query that the first pass scores at least.
FIRST_RANGES = 10
#: Scores are rounded to six digits; bounds this much below the floor still count.
SLACK = 1e-5


def range_blocks(table: pa.Table) -> pa.Table:
    """The blocks of one range of a segment, from its documents."""
    table = table.combine_chunks()
    lists = table["terms"].combine_chunks()
    found = lists.flatten()
    row = np.repeat(np.arange(table.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
    names, code = in_order(found.field("term"))
    order = np.argsort(code, kind="stable")
    row, tf, begins = row[order], found.field("tf").to_numpy()[order], np.searchsorted(code[order], np.arange(len(names) + 1))
    size = table["len"].to_numpy()[row]
    postings = pa.StructArray.from_arrays([table["doc"].combine_chunks().take(pa.array(row)), pa.array(tf), pa.array(size)], ["doc", "tf", "len"])
    heads = begins[:-1]
    columns = {"term": names} | {n: pa.repeat(table[n][0], len(names)) for n in ("segment", "range")}
    columns["max_tf"] = pa.array(np.maximum.reduceat(tf, heads) if len(heads) else tf, pa.int64())
    columns["min_len"] = pa.array(np.minimum.reduceat(size, heads) if len(heads) else size, pa.int64())
    columns["n"] = pa.array(np.diff(begins), pa.int32())
    columns["postings"] = pa.ListArray.from_arrays(pa.array(begins, pa.int32()), postings)
    return pa.table(columns)


def range_scores(qid: str, schema: pa.Schema, avgdl: float, k1: float, b: float):
    """Scores of one range from its rows: blocks (term, p), current documents (doc) and what is asked (qid, term, w, floor)."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        asked, blocks = table.filter(pc.is_valid(table["w"])), table.filter(pc.is_valid(table["p"]))
        if not asked.num_rows or not blocks.num_rows:
            return schema.empty_table()
        queries = asked[qid].combine_chunks().dictionary_encode()
        query = queries.indices.to_numpy(zero_copy_only=False)
        at = pc.fill_null(pc.index_in(asked["term"], value_set=blocks["term"].combine_chunks()), -1).to_numpy()
        weight = np.zeros((blocks.num_rows, len(queries.dictionary)))
        np.add.at(weight, (at[at >= 0], query[at >= 0]), asked["w"].to_numpy()[at >= 0])
        floor = np.full(len(queries.dictionary), -np.inf)
        np.maximum.at(floor, query, pc.fill_null(asked["floor"], -np.inf).to_numpy())
        lists = blocks["p"].combine_chunks()
        found = lists.flatten()
        docs = found.field("doc").dictionary_encode()
        tf, size = found.field("tf").to_numpy().astype(np.float64), found.field("len").to_numpy()
        part = np.zeros((len(docs.dictionary), blocks.num_rows))
        block = np.repeat(np.arange(blocks.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
        part[docs.indices.to_numpy(zero_copy_only=False), block] = tf * (k1 + 1) / (tf + k1 * (1 - b + b * size / avgdl))
        score = part @ weight
        # postings of documents that have changed since are skipped
        current = pc.is_in(docs.dictionary, value_set=table["doc"].drop_null().combine_chunks()).to_numpy(zero_copy_only=False)
        i, j = np.nonzero((score > 0) & (score >= floor) & current[:, None])
        return pa.Table.from_arrays([queries.dictionary.take(pa.array(j)), docs.dictionary.take(pa.array(i)), pa.array(score[i, j])], names=schema.names)

    return run


class SearchIndex:
    """The index of the ``text_col`` of rows named by ``id_col``, stored below ``path``. Ids are unique and not null."""

    def __init__(self, spark: SparkSession, path: str, id_col: str = "doc_id", text_col: str = "text"):
        self.spark, self.folder, self.id_col, self.text_col = spark, VersionedFolder(spark, path), id_col, text_col

    # ---- stored tables

    def _id(self, state: dict) -> T.StructField:
        return T.StructField("doc", T.StructType.fromJson(state["id"]).fields[0].dataType)

    def _docs(self, state: dict) -> DataFrame:
        """(doc, segment, digest, len): the current documents."""
        schema = T.StructType([self._id(state), *T._parse_datatype_string("segment int, digest string, len long").fields])
        return self.folder.read(state["docs"], schema)

    def _forward(self, state: dict) -> DataFrame:
        """(doc, segment, len, terms): what each document had when its segment was written."""
        schema = T.StructType([self._id(state), *T._parse_datatype_string("segment int, len long, terms array<struct<term: string, tf: long>>").fields])
        return self.folder.read([s["forward"] for s in state["segments"]], schema)

    def _counts(self, state: dict) -> DataFrame:
        """(term, change): summed over all segments, the documents of a term."""
        return self.folder.read([s["counts"] for s in state["segments"]], T._parse_datatype_string("term string, change long"))

    def _block_schema(self, state: dict) -> T.StructType:
        posting = T.StructType([self._id(state), *T._parse_datatype_string("tf long, len long").fields])
        return T.StructType(
            [
                *T._parse_datatype_string("term string, segment int, range int, max_tf long, min_len long, n int").fields,
                T.StructField("postings", T.ArrayType(posting)),
            ]
        )

    def _blocks(self, state: dict) -> DataFrame:
        return self.folder.read([s["blocks"] for s in state["segments"]], self._block_schema(state))

    # ---- writing

    def refresh(self, docs: DataFrame) -> dict:
        """Bring the index to the rows of ``docs``; (tokenised, removed, n) of what was done. Nothing changed: no version."""
        base, state = self.folder.state()
        given = docs.select(F.col(self.id_col).alias("doc"), F.coalesce(F.col(self.text_col), F.lit("")).alias("text"))
        if not state:
            state = {"id": T.StructType([given.schema["doc"]]).jsonValue(), "docs": [], "segments": [], "n": 0, "total": 0}
        known = self._docs(state)
        digested = given.withColumn("digest", F.md5("text"))
        before = known.select("doc", F.col("digest").alias("old"))
        changed = digested.join(before, "doc", "left").where("old IS NULL OR old <> digest")
        number = len(state["segments"])
        tokens = changed.select("doc", "digest", tokenize(F.col("text")).alias("tokens"))
        # one row holds all of a document's tokens, so they are counted in it
        rows = count_terms(tokens.select("doc", F.lit(number).alias("segment"), "digest", F.size("tokens").cast("long").alias("len"), "tokens"))
        forward = self.folder.stage(rows, "forward")
        rows = self.folder.read([forward], rows.schema)
        removed = known.join(given.select("doc"), "doc", "left_anti").select("doc")
        n_new = rows.count()
        removed = materialize(removed, "removed")
        n_removed = removed.count()
        if not n_new and not n_removed:
            return {"tokenised": 0, "removed": 0, "n": state["n"]}

        stale = self._docs(state).join(rows.select("doc").union(removed), "doc", "left_semi").select("doc", "segment")
        stale = materialize(stale, "stale")
        lost = self._forward(state).join(stale, ["doc", "segment"], "left_semi")
        gone = lost.select(F.explode("terms.term").alias("term"), F.lit(-1).cast("long").alias("change"))
        kept = self._docs(state).join(stale.select("doc"), "doc", "left_anti")
        added = rows.select("doc", "segment", "digest", "len")
        # documents are narrow rows, so the list of them is written anew; texts and postings are not
        state["docs"] = [self.folder.stage(kept.unionByName(added), "docs")]
        state["segments"] = [*state["segments"], self._segment(rows, forward, number, n_new, gone)]
        whole = self._docs(state).agg(F.count(F.lit(1)), F.coalesce(F.sum("len"), F.lit(0))).first()
        state["n"], state["total"] = int(whole[0]), int(whole[1])
        self.folder.commit(base, state)
        return {"tokenised": n_new, "removed": n_removed, "n": state["n"]}

    def compact(self) -> None:
        """One segment in place of all, without what is no longer current; no text is read."""
        base, state = self.folder.state()
        if not state:
            return
        current = self._docs(state).select("doc", "segment", "digest")
        rows = self._forward(state).join(current, ["doc", "segment"]).withColumn("segment", F.lit(0))
        forward = self.folder.stage(rows, "forward")
        rows = self.folder.read([forward], rows.schema)
        docs = self.folder.stage(rows.select("doc", "segment", "digest", "len"), "docs")
        self.folder.commit(base, state | {"docs": [docs], "segments": [self._segment(rows, forward, 0, state["n"])]})

    @staticmethod
    def _range(ranges: Column) -> Column:
        return F.pmod(F.xxhash64("doc", F.lit(3)), ranges).cast("int")

    def _segment(self, rows: DataFrame, forward: str, number: int, n: int, gone: DataFrame | None = None) -> dict:
        """Write the postings of tokenised documents, and by how much documents per term change."""
        ranges = max(1, -(-n // RANGE_DOCS))
        segment = F.lit(number).alias("segment")
        place = self._range(F.lit(ranges)).alias("range")
        # a block holds the documents of one range at most; sorted, so that a reader skips row groups by their terms
        dealt = rows.select("doc", segment, "len", "terms", place).groupBy("segment", "range")
        blocks = dealt.applyInArrow(range_blocks, self._block_schema({"id": T.StructType([rows.schema["doc"]]).jsonValue()}))
        change = rows.select(F.explode("terms.term").alias("term"), F.lit(1).cast("long").alias("change"))
        change = change.union(gone) if gone is not None else change
        counts = change.groupBy("term").agg(F.sum("change").alias("change")).where("change <> 0")
        return {
            "forward": forward,
            "ranges": ranges,
            "blocks": self.folder.stage(blocks.sortWithinPartitions("term", "range"), "blocks"),
            "counts": self.folder.stage(counts, "counts"),
        }

    # ---- reading

    def _opened(self) -> dict:
        _, state = self.folder.state()
        if not state:
            raise ValueError("the index has no version yet; refresh it first")
        return state

    def postings(self) -> DataFrame:
        """(id, term, tf, len, df, n, avgdl) of all current documents, as an index built from nothing has them."""
        state = self._opened()
        found = self._forward(state).join(self._docs(state).select("doc", "segment"), ["doc", "segment"], "left_semi")
        found = found.select("doc", "len", F.explode("terms").alias("x")).select("doc", "x.term", "x.tf", "len")
        df = self._counts(state).groupBy("term").agg(F.sum("change").alias("df"))
        avgdl = state["total"] / state["n"] if state["n"] else None
        return salted_join(found, df, ["term"], F.col("doc")).select(
            F.col("doc").alias(self.id_col), "term", "tf", "len", "df", F.lit(state["n"]).cast("long").alias("n"), F.lit(avgdl).cast("double").alias("avgdl")
        )

    def search(self, queries: DataFrame, qid: str, q: str, k: int, k1: float = K1, b: float = B) -> tuple[DataFrame, DataFrame]:
        """(hits, reads): the best ``k`` documents per query, equal scores by id; and (qid, postings, read) per query, the
        postings of its terms and how many of them were unpacked."""
        state = self._opened()
        n, avgdl = float(state["n"]), state["total"] / state["n"] if state["total"] else 1.0

        def part(tf: Column, size: Column) -> Column:
            return F.col("w") * tf * (k1 + 1) / (tf + k1 * (1 - b + b * size / F.lit(avgdl)))

        asked = query_terms(queries, qid, q)
        df = self._counts(state).join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("change").alias("df"))
        w = (F.col("qtf") * lucene_idf(F.lit(n), F.col("df"))).alias("w")
        weights = materialize(asked.join(df.where("df > 0"), "term").select(qid, "term", w), "query-weights")
        # bounds come from the small columns of the blocks; their postings are not read
        bounds = self._blocks(state).select("term", "segment", "range", "n", "max_tf", "min_len")
        met = salted_join(bounds, weights, ["term"], F.struct("segment", "range"))
        ranges = met.groupBy(qid, "segment", "range").agg(F.sum(part(F.col("max_tf"), F.col("min_len"))).alias("most"), F.sum("n").alias("n"))
        ranges = materialize(ranges, "ranges")
        depth = max(FIRST_RANGES, k)
        first = materialize(top_k(ranges, [qid], [F.desc("most"), "segment", "range"], depth).drop("rank"), "first-ranges")

        terms = materialize(weights.select("term").distinct(), "query-terms")
        blocks = self._blocks(state).join(terms, "term", "left_semi").select("segment", "range", "term", F.col("postings").alias("p"))
        number = F.get(F.array(*[F.lit(s["ranges"]) for s in state["segments"]]), F.col("segment"))
        current = self._docs(state).select("segment", self._range(number).alias("range"), "doc")
        schema = T.StructType([weights.schema[qid], self._id(state), T.StructField("score", T.DoubleType())])
        run = range_scores(qid, to_arrow_schema(schema), avgdl, k1, b)

        def scores(of: DataFrame) -> DataFrame:
            """Scores in some ranges, not below the floor of their query. Only blocks, documents and questions travel, each to
            its range; what they have in common does not leave it."""
            held = blocks.unionByName(current, True).join(of.select("segment", "range").distinct(), ["segment", "range"], "left_semi")
            asks = of.select(qid, "segment", "range", "floor").join(weights, qid)
            found = held.unionByName(asks, True).groupBy("segment", "range").applyInArrow(run, schema)
            return found.withColumn("score", F.round("score", 6))

        best = materialize(scores(first.withColumn("floor", F.lit(None).cast("double"))), "first-scores")
        kth = top_k(best, [qid], [F.desc("score")], k).groupBy(qid).agg(F.count(F.lit(1)).alias("c"), F.min("score").alias("least"))
        floor = kth.where(F.col("c") == k).select(qid, (F.col("least") - SLACK).alias("floor"))
        rest = ranges.join(floor, qid, "left").where("floor IS NULL OR most >= floor")
        rest = materialize(rest.join(first.select(qid, "segment", "range"), [qid, "segment", "range"], "left_anti"), "further-ranges")
        hits = best.unionByName(scores(rest)).where("score > 0")
        hits = top_k(hits, [qid], [F.desc("score"), "doc"], k).select(qid, F.col("doc").alias(self.id_col), "score", "rank")
        read = first.select(qid, "n").union(rest.select(qid, "n")).groupBy(qid).agg(F.sum("n").alias("read"))
        total = ranges.groupBy(qid).agg(F.sum("n").alias("postings"))
        return hits, total.join(read, qid).select(qid, "postings", "read")
