"""Inverted index, BM25, keyword and vector top-k, rank fusion."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.functions.text import sentences, tokenize
from loomgraph.operators.nearest import InvertedFile, calibrated_probes, nearest_in_lists, nearest_k
from loomgraph.operators.scale import first_per_key, salted_join, top_k, unnest
from loomgraph.session import materialize

K1, B = 1.2, 0.75
RRF_K = 60
LIST_DEPTH = 20
SNIPPET = 200


def sentences_of(docs: DataFrame, id_col: str, text_col: str, min_length: int = 11) -> DataFrame:
    """One row per sentence, numbered from 1."""
    parts = unnest(docs, [id_col], sentences(F.col(text_col), min_length), "sentence", "ordinal")
    return parts.withColumn("ordinal", (F.col("ordinal") + 1).cast("long"))


def documents_with_phrase(
    docs: DataFrame, id_col: str, text_col: str, phrases: DataFrame, phrase_id: str, phrase_col: str, words: int
) -> DataFrame:
    """(phrase, document) pairs where the phrase's words occur in a row.

    Documents are cut into overlapping word runs of the phrase length and equi-joined; no
    document is compared with every phrase.
    """
    w = F.split(F.col(text_col), r"\s+")
    starts = F.sequence(F.lit(1), F.size("w") - words + 1)
    runs = F.when(F.size("w") >= words, F.transform(starts, lambda i: F.array_join(F.slice(F.col("w"), i, words), " ")))
    grams = unnest(docs.select(id_col, w.alias("w")), [id_col], runs, "g")
    wanted = phrases.select(F.col(phrase_id), F.col(phrase_col).alias("g")).where(F.size(F.split("g", " ")) == words)
    return salted_join(grams, wanted, ["g"], F.col(id_col)).select(phrase_id, id_col).distinct()


@dataclass
class TextIndex:
    """Postings (doc, term, tf, len, kept columns), term counts (term, df), one row of totals (n, avgdl)."""

    keys: list[str]
    postings: DataFrame
    terms: DataFrame
    totals: DataFrame


def text_index(
    docs: DataFrame, id_col: str, text_col: str, only_terms: DataFrame | None = None, keep: tuple[str, ...] = ()
) -> TextIndex:
    """Inverted index of a text column; ``keep`` columns ride along in the postings.

    With ``only_terms`` (column ``term``) other terms are dropped before anything is
    shuffled; totals still cover every document. All tokens of a document come from one row,
    so the partial counts are complete before the shuffle.
    """
    keys = [id_col, *keep]
    tokens = docs.select(*keys, tokenize(F.col(text_col)).alias("tokens"))
    totals = tokens.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("tokens").cast("long")).alias("total")).select(
        "n", (F.col("total") / F.col("n")).alias("avgdl")
    )
    sized = tokens.select(*keys, F.size("tokens").cast("long").alias("len"), "tokens")
    exploded = unnest(sized, [*keys, "len"], F.col("tokens"), "term")
    if only_terms is not None:
        exploded = salted_join(exploded, only_terms.select("term").distinct(), ["term"], F.col(id_col), "left_semi")
    postings = exploded.groupBy(*keys, "len", "term").agg(F.count(F.lit(1)).alias("tf"))
    # reading tf keeps this branch equal to the postings branch, so both share one exchange
    terms = postings.groupBy("term").agg(F.sum((F.col("tf") > 0).cast("long")).alias("df"))
    return TextIndex(keys, postings, terms, totals)


#: Rows whose tokens are counted together.
ROWS_AT_ONCE = 1000
TERMS = T.ArrayType(T.StructType([T.StructField("term", T.StringType()), T.StructField("tf", T.LongType())]))


def count_terms(docs: DataFrame) -> DataFrame:
    """``docs`` with (term, tf) of each row's ``tokens`` as ``terms``, in order. A row is counted by itself, so nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_AT_ONCE):
                rows = batch.slice(start, ROWS_AT_ONCE)
                tokens = rows.column("tokens")
                names, code = in_order(tokens.flatten())
                row = np.repeat(np.arange(len(tokens)), tokens.value_lengths().to_numpy(zero_copy_only=False))
                key, tf = np.unique(row * max(1, len(names)) + code, return_counts=True)
                row, code = np.divmod(key, max(1, len(names)))
                terms = pa.StructArray.from_arrays([names.take(pa.array(code)), pa.array(tf)], ["term", "tf"])
                offsets = pa.array(np.searchsorted(row, np.arange(len(tokens) + 1)), pa.int32())
                kept = {n: rows.column(n) for n in rows.schema.names if n != "tokens"}
                yield pa.RecordBatch.from_pydict(kept | {"terms": pa.ListArray.from_arrays(offsets, terms)})

    return docs.mapInArrow(run, T.StructType([*docs.drop("tokens").schema.fields, T.StructField("terms", TERMS)]))


def in_order(values: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The different values in order, and the place of each value among them."""
    known = values.dictionary_encode()
    order = pc.sort_indices(known.dictionary)
    place = np.empty(len(order), np.int64)
    place[order.to_numpy()] = np.arange(len(order))
    return known.dictionary.take(order), place[known.indices.to_numpy(zero_copy_only=False)]


def counted_index(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, term, tf, len, df, n, avgdl): every posting beside its term's and the table's counts.

    The texts are read twice. The first pass counts documents per term and, under the empty term, all documents and tokens; only
    sums leave its tasks. The second counts tokens inside their row; postings and counts are dealt by term and meet there. Counts
    are as many as the terms: by the size of their files, packed, Spark would take them for small and gather them in the driver.
    A term has one posting in a document, and Spark splits the tasks of frequent ones, so counts need no copies.
    """
    tokens = docs.select(id_col, tokenize(F.col(text_col)).alias("tokens"))
    sized = tokens.select(id_col, F.size("tokens").cast("long").alias("len"), "tokens")
    # no token is empty
    seen = unnest(sized, ["len"], F.array_distinct(F.array_append("tokens", F.lit(""))), "term")
    stats = materialize(seen.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("len").alias("total")), "term-counts")
    whole = stats.where("term = ''").first()
    n, total = (whole["df"], whole["total"]) if whole else (0, 0)
    postings = unnest(count_terms(sized), [id_col, "len"], F.col("terms"), "x").select(id_col, "x.term", "x.tf", "len")
    return postings.join(stats.select("term", "df").hint("merge"), "term").select(
        id_col, "term", "tf", "len", "df", F.lit(n).cast("long").alias("n"), F.round(F.lit(total / n if n else None).cast("double"), 6).alias("avgdl")
    )


def query_terms(queries: DataFrame, qid: str, text: str) -> DataFrame:
    """Query tokens with their repeat count."""
    return (
        unnest(queries, [qid], tokenize(F.col(text)), "term")
        .groupBy(qid, "term")
        .agg(F.count(F.lit(1)).alias("qtf"))
    )


def lucene_idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def okapi_idf(n: Column, df: Column) -> Column:
    return F.log((n - df + 0.5) / (df + 0.5))


def bm25_scores(index: TextIndex, queries: DataFrame, qid: str, text: str, k1: float = K1, b: float = B) -> DataFrame:
    """Score of every (query, document) pair with a common term; nothing else is touched.

    A frequent query term has postings in most documents, so the postings join is salted.
    """
    n = index.totals.select("n").scalar()
    avgdl = index.totals.select("avgdl").scalar()
    weighted = query_terms(queries, qid, text).join(index.terms, "term").select(
        qid, "term", (F.col("qtf") * lucene_idf(n, F.col("df"))).alias("w")
    )
    return _score(index, weighted, qid, avgdl, k1, b)


def bm25_okapi_scores(
    index: TextIndex, queries: DataFrame, qid: str, text: str, k1: float = 1.5, b: float = 0.75, floor: float = 0.25
) -> DataFrame:
    """Okapi variant: negative idf values become ``floor`` times the mean idf of all terms.

    ``index`` must hold every term, because the mean runs over the whole vocabulary.
    """
    n = index.totals.select("n").scalar()
    avgdl = index.totals.select("avgdl").scalar()
    idf = index.terms.select("term", okapi_idf(n, F.col("df")).alias("idf"))
    mean = idf.agg((F.sum("idf") / F.count(F.lit(1))).alias("m")).select("m").scalar()
    weighted = query_terms(queries, qid, text).join(idf, "term").select(
        qid, "term", (F.col("qtf") * F.when(F.col("idf") < 0, mean * floor).otherwise(F.col("idf"))).alias("w")
    )
    return _score(index, weighted, qid, avgdl, k1, b)


def _score(index: TextIndex, weighted: DataFrame, qid: str, avgdl: Column, k1: float, b: float) -> DataFrame:
    # written out, the weights have a known size: Spark broadcasts them when they are small and
    # otherwise joins on (term, salt)
    weights = materialize(weighted, "query-weights")
    tf = F.col("tf")
    part = F.col("w") * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("len") / avgdl))
    hits = salted_join(index.postings, weights, ["term"], F.col(index.keys[0]))
    return (
        hits.select(qid, *index.keys, part.alias("part"))
        .groupBy(qid, *index.keys)
        .agg(F.round(F.sum("part"), 6).alias("score"))
        .where("score > 0")
    )


#: Hits, one for each query, document and common term, that one task scores, about.
TASK_HITS = 1 << 20


def bm25_search_scores(
    docs: DataFrame, id_col: str, text_col: str, queries: DataFrame, qid: str, q: str, keep: tuple[str, ...] = (), k1: float = K1, b: float = B
) -> DataFrame:
    """Score of every (query, document) pair with a common term, from the texts themselves.

    The texts are read twice. The first pass counts: documents per query term and, under the empty term, all documents and
    tokens; only sums leave its tasks. The second deals the tokens that queries name by document, once; postings, hits and
    scores then need no further exchange. Tasks are as many as the hits ask for, so that none grows with the table.
    """
    keys = [id_col, *keep]
    asked = materialize(query_terms(queries, qid, q), "query-terms")
    tokens = docs.select(*keys, tokenize(F.col(text_col)).alias("tokens"))
    sized = tokens.select(*keys, F.size("tokens").cast("long").alias("len"), "tokens")
    # no token is empty
    seen = unnest(sized, [id_col, "len"], F.array_distinct(F.array_append("tokens", F.lit(""))), "term")
    wanted = asked.select("term").union(asked.sparkSession.range(1).select(F.lit("").alias("term"))).distinct()
    counted = salted_join(seen, wanted, ["term"], F.col(id_col), "left_semi")
    stats = materialize(counted.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("len").alias("total")), "term-counts")
    whole = stats.where("term = ''").first()
    n, total = (whole["df"], whole["total"]) if whole else (0, 0)
    w = (F.col("qtf") * lucene_idf(F.lit(n), F.col("df"))).alias("w")
    # written out, the weights have a known size: Spark broadcasts them when they are small and
    # otherwise joins on (term, salt)
    weights = materialize(asked.join(stats, "term").select(qid, "term", w, "df"), "query-weights")
    n_hits = weights.agg(F.sum("df")).first()[0] or 0
    tasks = max(docs.sparkSession.sparkContext.defaultParallelism, -(-n_hits // TASK_HITS))
    found = unnest(sized, [*keys, "len"], F.col("tokens"), "term")
    found = salted_join(found, weights.select("term").distinct(), ["term"], F.col(id_col), "left_semi").repartition(tasks, id_col)
    postings = found.groupBy(*keys, "len", "term").agg(F.count(F.lit(1)).alias("tf"))
    tf, avgdl = F.col("tf"), F.lit(total / n if n else 1.0)
    part = F.col("w") * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("len") / avgdl))
    hits = salted_join(postings, weights.select(qid, "term", "w"), ["term"], F.col(id_col))
    return hits.select(qid, *keys, part.alias("part")).groupBy(qid, *keys).agg(F.round(F.sum("part"), 6).alias("score")).where("score > 0")


def bm25_search(
    docs: DataFrame, id_col: str, text_col: str, queries: DataFrame, qid: str, q: str, k: int, newest: str | None = None
) -> DataFrame:
    """Best ``k`` documents per query; equal scores: newest first, then id."""
    keep = (newest,) if newest else ()
    order = [F.desc("score"), *[F.desc(c) for c in keep], F.col(id_col)]
    return top_k(bm25_search_scores(docs, id_col, text_col, queries, qid, q, keep), [qid], order, k)


def latest_n(docs: DataFrame, created: str, id_col: str, n: int) -> DataFrame:
    """Newest ``n`` rows with score 0: the answer to a blank query."""
    return docs.orderBy(F.desc(created), F.col(id_col)).limit(n).withColumn("score", F.lit(0.0))


def visible_documents(docs: DataFrame, space: str | None = None) -> DataFrame:
    """Active or stale documents, optionally of one space."""
    shown = docs.where(F.col("status").isin("ACTIVE", "STALE"))
    return shown if space is None else shown.where(F.col("space") == space)


def visible_chunks(chunks: DataFrame, docs: DataFrame, space: str | None = None) -> DataFrame:
    """Chunks of active or stale documents, optionally of one space."""
    return chunks.join(visible_documents(docs, space).select("doc_id"), "doc_id", "left_semi")


def vector_topk(
    chunks: DataFrame, queries: DataFrame, k: int = LIST_DEPTH, index: InvertedFile | None = None, recall: float = 0.9
) -> DataFrame:
    """Nearest ``k`` chunks per query vector by cosine distance.

    Exact by default. With an index of the chunks' vectors only as many of its lists are searched as find ``recall`` of the
    exact neighbours of a sample; chunks without a vector are then left out.
    """
    if index is None:
        return nearest_k(queries, "qid", "qvec", chunks, "chunk_id", "embedding", k, metric="cosine")
    return nearest_in_lists(index, queries, "qid", "qvec", k, calibrated_probes(index, k, recall))


def keyword_topk(chunks: DataFrame, queries: DataFrame, k: int = LIST_DEPTH) -> DataFrame:
    """Chunks in which every query term occurs, ranked by damped term frequency.

    Terms are counted inside their chunk's row, so its hits lie side by side and leave their task as one row for each query.
    """
    # written out, the terms have a known size: Spark broadcasts them when they are small
    terms = materialize(query_terms(queries, "qid", "q").select("qid", "term"), "query-terms")
    need = terms.groupBy("qid").agg(F.count(F.lit(1)).alias("need"))
    tokens = chunks.select("chunk_id", tokenize(F.col("text")).alias("tokens"))
    counted = count_terms(tokens.select("chunk_id", F.size("tokens").cast("long").alias("len"), "tokens"))
    postings = unnest(counted, ["chunk_id", "len"], F.col("terms"), "x").select("chunk_id", "x.term", "x.tf", "len")
    hits = salted_join(postings, terms, ["term"], F.col("chunk_id"))
    matched = (
        hits.groupBy("qid", "chunk_id")
        .agg(
            F.count(F.lit(1)).alias("have"),
            F.round(F.sum(F.log1p("tf") / F.log1p("len")), 6).alias("score"),
        )
        .join(need, "qid")
        .where("have = need")
    )
    return top_k(matched, ["qid"], [F.desc("score"), "chunk_id"], k).select("qid", "chunk_id", "score", "rank")


def proximity_topk(chunks: DataFrame, queries: DataFrame, k: int = LIST_DEPTH, span: int = 100) -> DataFrame:
    """Chunks in which every query term occurs, ranked by how near to each other the terms stand.

    Each two places of different terms at most ``span`` words apart bear evidence that falls with their distance; evidence
    adds up as 1 - prod(1 - e). A query of one term is ranked by its occurrences, the j-th counting 1/j**2. Chunks without
    near places score 0 and follow. Places come from one window of at most ``span`` words, not from pairs of a chunk.
    """
    terms = query_terms(queries, "qid", "q").select("qid", "term")
    need = terms.groupBy("qid").agg(F.count(F.lit(1)).alias("need"))
    words = unnest(chunks, ["chunk_id"], tokenize(F.col("text")), "term", "pos")
    hits = materialize(salted_join(words, terms, ["term"], F.col("chunk_id")).select("qid", "chunk_id", "pos", "term"), "places")
    whole = (
        hits.groupBy("qid", "chunk_id")
        .agg(F.size(F.collect_set("term")).alias("have"))
        .join(need, "qid")
        .where("have = need")
        .select("qid", "chunk_id", "need")
    )
    # written out, its size is known: where chunks with all terms are few, the places of the others are not dealt
    whole = materialize(whole, "whole-chunks")
    chunk = Window.partitionBy("qid", "chunk_id").orderBy("pos")
    before = F.collect_list(F.struct("pos", "term")).over(chunk.rangeBetween(-span, -1))

    def unlikely(total: Column, x: Column) -> Column:
        gap = F.col("pos") - x["pos"]
        evidence = 0.1 * F.sqrt(1 / (1.005 + 0.05 * F.exp(gap / 1.5 - 2)))
        return total + F.when(x["term"] != F.col("term"), F.log(1 - evidence)).otherwise(0.0)

    scored = (
        hits.join(whole, ["qid", "chunk_id"])
        .withColumn("before", before)
        .withColumn("nth", F.row_number().over(chunk))
        .withColumn("part", F.aggregate("before", F.lit(0.0), unlikely))
        .groupBy("qid", "chunk_id", "need")
        .agg(F.sum("part").alias("part"), F.sum(1 / (F.col("nth") * F.col("nth"))).alias("single"))
    )
    # the squares' reciprocals sum to pi**2 / 6
    score = F.when(F.col("need") == 1, 0.1 * F.col("single") / 1.64493406685).otherwise(1 - F.exp("part"))
    ranked = scored.select("qid", "chunk_id", F.round(score, 6).alias("score"))
    return top_k(ranked, ["qid"], [F.desc("score"), "chunk_id"], k).select("qid", "chunk_id", "score", "rank")


def rrf_fuse(*lists: DataFrame, k: int = RRF_K) -> DataFrame:
    """Reciprocal-rank fusion of ranked lists (qid, chunk_id, rank)."""
    both = lists[0].select("qid", "chunk_id", "rank")
    for other in lists[1:]:
        both = both.unionByName(other.select("qid", "chunk_id", "rank"))
    return both.groupBy("qid", "chunk_id").agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 6).alias("score"))


def hybrid_search(
    queries: DataFrame, chunks: DataFrame, docs: DataFrame, space: str | None = None, limit: int = 10, depth: int = LIST_DEPTH
) -> DataFrame:
    """Vector and keyword lists of ``depth`` rows fused, best chunk per document, first ``limit`` documents.

    ``queries``: qid, q, qvec. The limit is clamped to 1..50.
    """
    shown = visible_chunks(chunks, docs, space)
    return hybrid_of_shown(queries, shown, shown.where("embedding IS NOT NULL"), docs, limit, depth)


def hybrid_of_shown(
    queries: DataFrame, shown: DataFrame, vectors: DataFrame, docs: DataFrame, limit: int = 10, depth: int = LIST_DEPTH
) -> DataFrame:
    """``hybrid_search`` of visible chunks whose ``vectors`` (chunk_id, embedding) may lie in a table of their own."""
    fused = rrf_fuse(
        vector_topk(vectors, queries.select("qid", "qvec"), depth),
        keyword_topk(shown, queries.select("qid", "q"), depth),
    )
    # the fused list holds at most two list depths per query, so the joins below start from it; written out, it has a known
    # size, and the texts of the chunks need not be dealt to meet it
    fused = materialize(fused, "fused")
    located = fused.join(shown.select("chunk_id", "doc_id", "heading_path", "text"), "chunk_id")
    best = first_per_key(located, ["qid", "doc_id"], [F.desc("score"), "chunk_id"])
    hits = top_k(best, ["qid"], [F.desc("score"), "doc_id"], max(1, min(limit, 50)))
    return hits.join(docs.select("doc_id", "title", "status", "verified_at"), "doc_id").select(
        "qid", "rank", "doc_id", "chunk_id", "title", "heading_path",
        F.substring("text", 1, SNIPPET).alias("snippet"), "score", "status", "verified_at",
    )


def search_report(hits: DataFrame) -> DataFrame:
    """Hits with their verification state."""
    return hits.select(
        "qid", "rank", "doc_id", "title", "status", "verified_at", (F.col("status") == "STALE").alias("is_stale")
    )


def weighted_rank(
    ranked: DataFrame, weight: Column, event_at: Column, now: Column, tau_days: float = 180.0
) -> DataFrame:
    """Adds the score scaled by node weight, and by weight and recency.

    Unknown weight counts 0.7, unknown event time 0.8; age is never negative.
    """
    w = F.coalesce(weight, F.lit(0.7))
    age = F.greatest(F.floor((F.unix_micros(now.cast("timestamp")) - F.unix_micros(event_at.cast("timestamp"))) / 86400000000), F.lit(0))
    recency = F.when(event_at.isNull(), F.lit(0.8)).otherwise(F.exp(-age / F.lit(tau_days)))
    by_weight = F.col("score") * (0.4 + 0.6 * w)
    # products of rounded scores often end in a 5, where engines round apart; this form has one answer
    def six(c: Column) -> Column:
        return F.floor(c * 1e6 + 0.5) / 1e6

    return ranked.withColumn("score_weight", six(by_weight)).withColumn(
        "score_recency", six(by_weight * (0.5 + 0.5 * recency))
    )


def additive_rank(ranked: DataFrame, weight: Column, lam: float = 0.1) -> DataFrame:
    """Score plus ``lam`` times the node weight."""
    return ranked.withColumn("score_added", F.round(F.col("score") + lam * F.coalesce(weight, F.lit(0.7)), 6))


def expand_one_hop(
    triples: DataFrame, queries: DataFrame, qid: str, q: str, seeds: int = 6, total: int = 20
) -> DataFrame:
    """Best triples per query, filled up with triples that share an entity with one of them.

    Neighbours follow newest first with score 0 until ``total`` rows; seeds are never cut.
    ``triples``: triple_id, subject, object, event_at and a ``corpus`` text column.
    """
    top = bm25_search(triples, "triple_id", "corpus", queries, qid, q, seeds, newest="event_at")
    # a few rows per query, used four times below; written out, their size is known to the joins
    top = materialize(top.select(qid, "triple_id", "score", "rank"), "seeds")
    ends = triples.select("triple_id", "subject", "object")
    entities = (
        top.join(ends, "triple_id")
        .select(qid, F.explode(F.array("subject", "object")).alias("entity"))
        .distinct()
    )
    entities = materialize(entities, "seed-entities")
    named = entities.select("entity").distinct()
    found = None
    for side in ("subject", "object"):
        side_rows = triples.select("triple_id", "event_at", F.col(side).alias("entity"))
        # a hub entity may hold a large share of all triples, and belong to many queries
        hit = salted_join(side_rows, named, ["entity"], F.col("triple_id"), "left_semi")
        # at most total + seeds rows per query and side can survive, whichever the query, so cut before queries meet them
        hit = top_k(hit, ["entity"], [F.desc("event_at"), "triple_id"], total + seeds, "__r").drop("__r")
        found = hit if found is None else found.unionByName(hit)
    found = found.join(entities, "entity").select(qid, "triple_id", "event_at")
    neighbours = found.distinct().join(top.select(qid, "triple_id"), [qid, "triple_id"], "left_anti")
    n_seed = top.groupBy(qid).agg(F.count(F.lit(1)).alias("n_seed"))
    filled = (
        top_k(neighbours, [qid], [F.desc("event_at"), "triple_id"], total, "pos")
        .join(n_seed, qid)
        .where("pos + n_seed <= " + str(total))
        .select(qid, "triple_id", F.lit(0.0).alias("score"), (F.col("pos") + F.col("n_seed")).alias("rank"))
    )
    return top.select(qid, "triple_id", "score", "rank").unionByName(filled)


def render_facts(ranked: DataFrame, qid: str, line: Column) -> DataFrame:
    """One numbered list per query from its ranked rows (at most k rows per query)."""
    numbered = ranked.select(qid, "rank", F.concat(F.col("rank").cast("string"), F.lit(". "), line).alias("line"))
    rows = F.array_sort(F.collect_list(F.struct("rank", "line")))
    return numbered.groupBy(qid).agg(
        F.array_join(F.transform(rows, lambda s: s["line"]), "\n").alias("facts"),
        F.count(F.lit(1)).alias("n_facts"),
    )
