"""Line packing, sentences, decision markers and chunk bodies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.text import CORE_MARKERS, EXTENDED_MARKERS, is_blank, is_marked, marker, pack_lines, sentences
from loomgraph.operators.ingest import META_HEADING
from loomgraph.operators.scale import first_per_key, ordered_concat, prefix_scan, unnest
from loomgraph.operators.sections import block_bucket

# fixed values: labels dropped inside the meeting-details section, and the leading time code
META_LINE = r"^(작성자|참석자|녹음 시작|길이|출처)\s*:"
TIME_CODE = r"^\[\d[^\]]{0,39}\]\s*"
# fixed value: heading of the hint list
HINT = "\n\n[결정·의지 어미가 감지된 문장 — 결정 후보로 우선 검토]\n"


def paragraph_pack(docs: DataFrame, budget: int) -> DataFrame:
    """(doc_id, chunk, text): greedy line packing."""
    return unnest(docs, ["doc_id"], pack_lines(F.col("text"), budget), "text", "chunk").select(
        "doc_id", (F.col("chunk") + 1).cast("long").alias("chunk"), "text"
    )


def tag_sentences(rows: DataFrame, col: str = "sentence", core=CORE_MARKERS, extended=()) -> DataFrame:
    """Adds the decision marker of each sentence."""
    return rows.withColumn("marker", marker(F.col(col), core, extended))


def number_sentences(chunks: DataFrame, keys: list[str], text: str = "text", cap: int | None = None) -> DataFrame:
    """Sentences S001, S002 … of each chunk with their character offsets.

    Offsets come from a forward search, so repeated sentences get increasing offsets. ``cap``
    limits the sentences of a row. Ids are wider than three digits where needed.
    """
    body = F.col(text)
    kept = sentences(body, 2) if cap is None else F.slice(sentences(body, 2), 1, cap)
    zero = F.struct(
        F.lit(1).alias("cursor"),
        F.expr("cast(array() as array<struct<text:string,start:int>>)").alias("out"),
    )

    def step(acc: Column, s: Column) -> Column:
        at = F.call_function("locate", s, body, acc["cursor"])
        return F.struct(
            F.when(at > 0, at + F.length(s)).otherwise(acc["cursor"]).alias("cursor"),
            F.concat(acc["out"], F.array(F.struct(s.alias("text"), (at - 1).alias("start")))).alias("out"),
        )

    found = F.aggregate(kept, zero, step, lambda acc: acc["out"])
    rows = unnest(chunks, keys, found, "s", "n")
    start = F.col("s.start")
    return rows.select(
        *keys,
        F.format_string("S%03d", F.col("n") + 1).alias("sentence_id"),
        F.col("s.text").alias("sentence"),
        start.cast("long").alias("start"),
        F.when(start >= 0, start + F.length("s.text")).otherwise(-1).cast("long").alias("end"),
    )


def sentence_jobs(chunks: DataFrame, keys: list[str], text: str = "text", core=CORE_MARKERS, extended=EXTENDED_MARKERS) -> DataFrame:
    """Numbered sentences of each chunk as one text, marked ones with a star, with both counts. No shuffle."""

    def job(all_: Column) -> Column:
        return F.struct(
            F.array_join(F.transform(all_, lambda x: x["line"]), "\n").alias("body"),
            F.size(all_).cast("long").alias("n_sentences"),
            F.size(F.filter(all_, lambda x: x["marked"])).cast("long").alias("n_marked"),
        )

    numbered = F.transform(sentences(F.col(text), 2), lambda s, n: F.struct(s.alias("s"), n.alias("n"), is_marked(s, core, extended).alias("marked")))
    listed = F.transform(
        numbered,
        lambda x: F.struct(
            F.concat(F.format_string("S%03d", x["n"] + 1), F.when(x["marked"], " * ").otherwise("   "), x["s"]).alias("line"), x["marked"].alias("marked")
        ),
    )
    # at most one job a chunk, unnested: a filter on columns would be pushed below them and take the sentences apart twice
    jobs = F.transform(F.filter(F.array(listed), lambda all_: F.size(all_) > 0), job)
    return unnest(chunks, keys, jobs, "job").select(*keys, "job.*")


def gate_chunks(chunks: DataFrame, mode: str, text: str = "text", core=CORE_MARKERS, extended=EXTENDED_MARKERS) -> DataFrame:
    """Chunk bodies: ``off`` unchanged, ``filter`` only with a marked sentence, ``hint`` with a list of them."""
    if mode not in ("off", "filter", "hint"):
        raise ValueError(mode)
    body = F.col(text)
    if mode == "off":
        return chunks.withColumn("body", body)
    marked = F.filter(sentences(body), lambda s: is_marked(s, core, extended))
    rows = chunks.withColumn("__marked", marked)
    if mode == "filter":
        return rows.where(F.size("__marked") > 0).withColumn("body", body).drop("__marked")
    listed = F.array_join(F.transform(F.col("__marked"), lambda s: F.concat(F.lit("- "), s)), "\n")
    return rows.withColumn(
        "body", F.when(F.size("__marked") > 0, F.concat(body, F.lit(HINT), listed)).otherwise(body)
    ).drop("__marked")


def reconstruct_body(blocks: DataFrame, meta_heading: str = META_HEADING, meta_line: str = META_LINE) -> DataFrame:
    """Plain body per document from typed blocks (doc_id, position, type, text).

    Headings are dropped but set the section; a leading time code is cut; labelled lines are
    dropped inside the meeting-details section only.
    """
    para = F.col("type") == "PARAGRAPH"
    scanned = prefix_scan(
        blocks, ["doc_id"], ["position"], block_bucket(),
        lasts={"in_meta": F.when(~para, F.trim("text") == F.lit(meta_heading))},
    )
    line = F.regexp_replace("text", TIME_CODE, "")
    dropped = F.coalesce(F.col("in_meta"), F.lit(False)) & line.rlike(meta_line)
    kept = scanned.where(para & ~is_blank(line) & ~dropped).select("doc_id", "position", line.alias("line"))
    return ordered_concat(kept, ["doc_id"], ["position"], F.col("line"), "\n", "body", block_bucket())


def _head(col: str, chars: int | None) -> Column:
    return F.trim(col) if chars is None else F.trim(F.substring(col, 1, chars))


def merge_decisions(rows: DataFrame, order: list[str], chars: int | None = None) -> DataFrame:
    """First decision per document, trimmed topic and decision, the latter on its first ``chars`` characters if given."""
    keyed = rows.withColumn("__t", F.trim("topic")).withColumn("__d", _head("decision", chars))
    return first_per_key(keyed, ["document_id", "__t", "__d"], order).drop("__t", "__d")


def merge_tacit(rows: DataFrame, order: list[str], chars: int | None = None) -> DataFrame:
    """First tacit item per document and trimmed statement, on its first ``chars`` characters if given."""
    keyed = rows.withColumn("__s", _head("statement", chars))
    return first_per_key(keyed, ["document_id", "__s"], order).drop("__s")
