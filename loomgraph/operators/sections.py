"""Blocks, sections and chunks of documents."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from loomgraph.functions.text import WHITE, is_blank
from loomgraph.operators.scale import bucketed_row_number, ordered_concat, prefix_scan

NODE = "struct<type:string,content:array<struct<type:string,text:string>>>"
HEADINGS = ("HEADING1", "HEADING2", "HEADING3")
CHUNK_SIZE = 1500
# rows of one document handled together by the running-value scans
BLOCK_BUCKET = 20_000


def block_bucket(position: str = "position") -> Column:
    return F.floor(F.col(position) / BLOCK_BUCKET)


def block_text_shallow(content: Column) -> Column:
    """Concatenated ``content[*].text`` of a block node, one level deep."""
    node = F.from_json(content, NODE)
    texts = F.transform(node["content"], lambda n: F.coalesce(n["text"], F.lit("")))
    return F.coalesce(F.array_join(texts, ""), F.lit(""))


def json_text_collect(rows: DataFrame, keys: list[str], content: str, max_depth: int = 64) -> DataFrame:
    """Every string ``text`` field of a nested JSON document, depth first, own text first.

    Each round unnests one more level of the documents that still have one; a path of
    zero-padded ordinals keeps the depth-first order. Nesting beyond ``max_depth`` raises.
    """
    frontier = rows.select(*keys, F.lit("").alias("path"), F.parse_json(content).alias("node"))
    found = None
    for depth in range(max_depth):
        kind = F.expr("schema_of_variant(node)")
        texts = frontier.where(kind.startswith("OBJECT")).select(
            *keys, "path", F.expr("try_variant_get(node, '$.text', 'variant')").alias("t")
        )
        texts = texts.where(F.expr("schema_of_variant(t) = 'STRING'")).select(
            *keys, "path", F.expr("variant_get(t, '$', 'string')").alias("text")
        )
        found = texts if found is None else found.unionByName(texts)
        frontier = frontier.where(kind.startswith("OBJECT") | kind.startswith("ARRAY"))
        frontier = frontier.lateralJoin(
            rows.sparkSession.tvf.variant_explode_outer(F.col("node").outer()).select(
                F.col("pos"), F.col("value")
            )
        ).where("value IS NOT NULL").select(
            *keys, F.concat("path", F.lpad(F.col("pos").cast("string"), 8, "0"), F.lit("/")).alias("path"), F.col("value").alias("node")
        )
        if depth >= 2 and frontier.isEmpty():
            break
    else:
        raise ValueError(f"nesting deeper than {max_depth}")
    joined = ordered_concat(found, keys, ["path"], F.col("text"), "", "text")
    return rows.select(*keys).join(joined, keys, "left").withColumn("text", F.coalesce("text", F.lit("")))


def heading_sections(blocks: DataFrame, titles: DataFrame) -> DataFrame:
    """Sections with the path ``title > h1 > h2`` from ordered blocks.

    ``blocks``: doc_id, position, type, text. ``titles``: doc_id, title. Every heading closes
    the open section. The first path slot is the latest level-1 heading, or, while there is
    none, the first level-2 heading; the second slot is the latest level-2 heading after it.
    Level-3 headings leave the path unchanged. Blank sections are dropped.
    """
    kind, pos = F.col("type"), F.col("position")
    head = F.struct(pos.alias("p"), F.col("text").alias("t"))
    scanned = prefix_scan(
        blocks.select("doc_id", "position", "type", "text"),
        ["doc_id"],
        ["position"],
        block_bucket(),
        sums={"section": F.when(kind.isin(*HEADINGS), 1).otherwise(0)},
        lasts={"h1": F.when(kind == "HEADING1", head), "h2": F.when(kind == "HEADING2", head)},
        firsts={"f2": F.when(kind == "HEADING2", head)},
    )
    slot1 = F.coalesce("h1", "f2")
    below = F.when(F.col("h2.p") > slot1["p"], F.col("h2.t"))
    path = F.concat_ws(" > ", slot1["t"], below)
    body = scanned.where(~kind.isin(*HEADINGS) & ~is_blank(F.col("text"))).select(
        "doc_id", "section", "position", "text", path.alias("path"), slot1.isNotNull().alias("has_path")
    )
    merged = ordered_concat(
        body, ["doc_id", "section", "path", "has_path"], ["position"], F.col("text"), "\n", "text", block_bucket()
    )
    return merged.join(titles, "doc_id").select(
        "doc_id",
        F.col("section").cast("long").alias("section"),
        F.when(F.col("has_path"), F.concat("title", F.lit(" > "), "path")).otherwise(F.col("title")).alias("heading_path"),
        "text",
    )


def fixed_chunks(sections: DataFrame, size: int = CHUNK_SIZE) -> DataFrame:
    """Consecutive slices of ``size`` characters per section, numbered from 1 per document."""
    pieces = sections.withColumn(
        "start", F.explode(F.sequence(F.lit(1), F.length("text"), F.lit(size)))
    ).select(
        "doc_id", "section", "heading_path", "start", F.substr("text", F.col("start"), F.lit(size)).alias("text")
    )
    numbered = bucketed_row_number(
        pieces, F.floor(F.col("section") / BLOCK_BUCKET), ["section", "start"], "ordinal", partition=["doc_id"]
    )
    return numbered.select("doc_id", "section", "ordinal", "heading_path", "text")


#: Characters of chunks that a task hands on together, about.
CHARS_AT_ONCE = 4 << 20


def sections_in_order(title: str | None, types: list[str], texts: list[str]) -> Iterator[tuple[int, str | None, str]]:
    """(section, heading path, text) of one document's blocks, as ``heading_sections`` has them."""
    section, h1, h2, f2, body = 0, None, None, None, []

    def closed() -> Iterator[tuple[int, str | None, str]]:
        if body:
            slot = h1 or f2
            below = h2[1] if slot and h2 and h2[0] > slot[0] else None
            path = title
            if slot and title is not None:
                path = " > ".join([title, slot[1], *([below] if below is not None else [])])
            yield section, path, "\n".join(body)

    for at, (kind, text) in enumerate(zip(types, texts)):
        if kind not in HEADINGS:
            if text.strip(WHITE):
                body.append(text)
            continue
        yield from closed()
        section, body = section + 1, []
        if kind == "HEADING1":
            h1 = (at, text)
        elif kind == "HEADING2":
            h2 = (at, text)
            f2 = f2 or h2
    yield from closed()


def document_chunks(docs: DataFrame, size: int = CHUNK_SIZE) -> DataFrame:
    """``fixed_chunks`` of the ``heading_sections`` of documents that hold their blocks in one row: nothing is shuffled.

    ``docs``: doc_id, title, and the arrays types and texts in block order. A document without an id has no chunks.
    """
    rows = docs.where("doc_id IS NOT NULL AND texts IS NOT NULL").select("doc_id", "title", "types", "texts")
    schema = T.StructType(
        [rows.schema["doc_id"], *(T.StructField(n, T.LongType()) for n in ("section", "ordinal")), *(T.StructField(n, T.StringType()) for n in ("heading_path", "text"))]
    )
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, chars = [], 0
            ids = batch.column(0)
            for row, (title, types, texts) in enumerate(zip(*(batch.column(i) for i in (1, 2, 3)))):
                ordinal = 0
                for section, path, text in sections_in_order(title.as_py(), types.as_py(), texts.as_py()):
                    for start in range(0, len(text), size):
                        ordinal += 1
                        out.append((row, section, ordinal, path, text[start : start + size]))
                    chars += len(text)
                if chars >= CHARS_AT_ONCE:
                    yield packed(ids, out)
                    out, chars = [], 0
            if out:
                yield packed(ids, out)

    def packed(ids: pa.Array, out: list[tuple]) -> pa.RecordBatch:
        row, *columns = zip(*out)
        return pa.RecordBatch.from_arrays([ids.take(pa.array(row)), *(pa.array(c, f.type) for c, f in zip(columns, list(arrow)[1:]))], schema=arrow)

    return rows.mapInArrow(run, schema)


def chunk_diff(pieces: DataFrame, stored: DataFrame, status: DataFrame) -> DataFrame:
    """What to do with the chunks of each document.

    ``pieces``: doc_id, ordinal, heading_path, text. ``stored``: the same plus has_embedding.
    ``status``: doc_id, status. Actions: delete (draft, or nothing to index), keep, repath
    (same texts, other heading paths), embed.
    """
    old = stored.select(
        "doc_id",
        "ordinal",
        F.col("text").alias("old_text"),
        F.col("heading_path").alias("old_path"),
        "has_embedding",
    )
    pairs = pieces.select("doc_id", "ordinal", "heading_path", "text").join(old, ["doc_id", "ordinal"], "full_outer")
    per = pairs.groupBy("doc_id").agg(
        F.count("text").alias("n_new"),
        F.count("old_text").alias("n_old"),
        F.bool_and(F.col("text").eqNullSafe(F.col("old_text"))).alias("same_text"),
        F.bool_and(F.col("heading_path").eqNullSafe(F.col("old_path"))).alias("same_path"),
        F.bool_and(F.coalesce("has_embedding", F.lit(False))).alias("embedded"),
    )
    action = (
        F.when((F.col("status") == "DRAFT") | (F.coalesce("n_new", F.lit(0)) == 0), "delete")
        .when(F.col("same_text") & F.col("embedded") & F.col("same_path"), "keep")
        .when(F.col("same_text") & F.col("embedded"), "repath")
        .otherwise("embed")
    )
    return status.select("doc_id", "status").join(per, "doc_id", "left").select(
        "doc_id",
        action.alias("action"),
        F.coalesce("n_new", F.lit(0)).alias("n_new"),
        F.coalesce("n_old", F.lit(0)).alias("n_old"),
    )


def reuse_embeddings(actions: DataFrame, pieces: DataFrame, stored: DataFrame) -> DataFrame:
    """New chunk rows of documents that keep their vectors: pieces joined back to stored vectors."""
    kept = actions.where(F.col("action").isin("keep", "repath")).select("doc_id")
    vectors = stored.select("doc_id", "ordinal", "embedding")
    return pieces.join(kept, "doc_id", "left_semi").join(vectors, ["doc_id", "ordinal"])
