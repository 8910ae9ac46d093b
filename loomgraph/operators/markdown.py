"""Markdown text to typed blocks and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.functions.text import bind, is_blank
from loomgraph.operators.scale import ordered_concat, unnest
from loomgraph.operators.sections import block_bucket


def _is_table(line: Column) -> Column:
    t = F.trim(line)
    return t.startswith("|") & t.endswith("|")


def _cells(line: Column) -> Column:
    t = F.trim(line)
    inner = F.substr(t, F.lit(2), F.greatest(F.length(t) - 2, F.lit(0)))
    return F.transform(F.split(inner, r"\|"), lambda c: F.trim(c))


def _is_separator(line: Column) -> Column:
    return _is_table(line) & F.forall(_cells(line), lambda c: c.rlike("^:?-{3,}:?$"))


def markdown_to_blocks(docs: DataFrame) -> DataFrame:
    """(doc_id, position, type, text) from (doc_id, text).

    Fences alternate open and close, so a running count tells code from prose. A table runs
    from the first line followed by a separator line to the end of the run of table lines.
    The text of a table holds its rows with trimmed cells; of an image its address.
    """
    # bound, because an expression named inside the lambda would be computed again for every line
    zipped = bind(
        F.split("text", r"\r\n|\n|\r"),
        lambda lines: F.transform(
            lines, lambda s, i: F.struct(s.alias("line"), F.get(lines, i - 1).alias("prev"), F.get(lines, i + 1).alias("next"))
        ),
    )
    rows = unnest(docs, ["doc_id"], zipped, "x", "position").select(
        "doc_id", F.col("position").cast("long").alias("position"), "x.line", "x.prev", "x.next"
    )
    in_table = _is_table(F.col("line"))
    rows = rows.withColumn("run_start", in_table & ~F.coalesce(_is_table(F.col("prev")), F.lit(False))).withColumn(
        "opens", in_table & F.coalesce(_is_separator(F.col("next")), F.lit(False))
    )
    # all lines of a document come from one row, so windows per document add no hot group
    per_doc = W.partitionBy("doc_id").orderBy("position").rowsBetween(W.unboundedPreceding, W.currentRow)
    fence = F.col("line").startswith("```")
    scanned = rows.withColumn("fences", F.sum(fence.cast("int")).over(per_doc)).withColumn(
        "run", F.last(F.when(F.col("run_start"), F.col("position")), ignorenulls=True).over(per_doc)
    )
    code = F.col("fences") % 2 == 1
    table_at = F.min(F.when(~code & F.col("opens"), F.col("position"))).over(W.partitionBy("doc_id", "run"))
    marked = (
        scanned.withColumn("table_at", table_at)
        .withColumn("code", code)
        .withColumn("table", ~code & in_table & F.coalesce(F.col("position") >= F.col("table_at"), F.lit(False)))
    )
    line = F.col("line")
    kind = (
        F.when(F.col("code"), "CODE")
        .when(line.startswith("### "), "HEADING3")
        .when(line.startswith("## "), "HEADING2")
        .when(line.startswith("# "), "HEADING1")
        .when(line.startswith("- "), "BULLET_LIST")
        .when(line.rlike(r"^\d+\. "), "ORDERED_LIST")
        .when(F.col("table"), "TABLE")
        .when(line.startswith("> "), "QUOTE")
        .when(line.startswith("![") & line.contains("](") & line.endswith(")"), "IMAGE")
        .otherwise("PARAGRAPH")
    )
    text = (
        F.when(F.col("code"), line)
        .when(kind.isin("HEADING3", "HEADING2", "HEADING1", "BULLET_LIST", "QUOTE"), F.regexp_replace(line, r"^(#{1,3}|-|>) ", ""))
        .when(kind == "ORDERED_LIST", F.regexp_replace(line, r"^\d+\. ", ""))
        .when(kind == "TABLE", F.array_join(_cells(line), " | "))
        .when(kind == "IMAGE", F.regexp_extract(line, r"\]\((.*)\)$", 1))
        .otherwise(line)
    )
    at = F.when(F.col("code"), F.col("fences")).when(F.col("table"), F.col("run")).otherwise(F.col("position"))
    # the opening fence itself carries the block, so that an empty code block survives
    use = F.when(F.col("code"), F.lit(True)).otherwise(
        ~fence & ~is_blank(line) & ~(F.col("table") & (F.col("position") == F.col("table_at") + 1))
    )
    # array_join skips nulls, so the opening fence counts as a row but adds no text
    items = marked.where(use).select(
        "doc_id", "position", kind.alias("type"), at.alias("at"), F.when(~(F.col("code") & fence), text).alias("text")
    )
    rows_of = F.array_sort(F.collect_list(F.struct("position", "text")))
    blocks = items.groupBy("doc_id", "type", "at").agg(
        F.min("position").alias("first"),
        F.array_join(F.transform(rows_of, lambda r: r["text"]), "\n").alias("text"),
    )
    number = F.row_number().over(W.partitionBy("doc_id").orderBy("first"))
    return blocks.select("doc_id", (number - 1).cast("long").alias("position"), "type", "text")


def blocks_to_markdown(blocks: DataFrame, docs: DataFrame) -> DataFrame:
    """One markdown string per document from typed blocks (doc_id, position, type, text).

    ``docs``: doc_id, title, owner, status, verified_at as text, for the front-matter line.
    """
    text = F.col("text")
    rows = F.split("text", "\n")
    rule = F.array_join(F.transform(F.split(F.get(rows, F.lit(0)), r" \| "), lambda c: F.lit("---")), " | ")
    table = F.array_join(
        F.concat(
            F.array(F.concat(F.lit("| "), F.get(rows, F.lit(0)), F.lit(" |")), F.concat(F.lit("| "), rule, F.lit(" |"))),
            F.transform(F.slice(rows, F.lit(2), F.greatest(F.size(rows), F.lit(1))), lambda r: F.concat(F.lit("| "), r, F.lit(" |"))),
        ),
        "\n",
    )
    kind = F.col("type")
    # fixed values: line prefixes by block type
    prefix = {"HEADING1": "# ", "HEADING2": "## ", "HEADING3": "### ", "BULLET_LIST": "- ", "ORDERED_LIST": "1. ", "QUOTE": "> "}
    md = F.when(kind == "CODE", F.concat(F.lit("```\n"), text, F.lit("\n```"))).when(kind == "TABLE", table)
    md = md.when(kind == "IMAGE", F.concat(F.lit("![image]("), text, F.lit(")")))
    for name, lead in prefix.items():
        md = md.when(kind == name, F.concat(F.lit(lead), text))
    body = ordered_concat(
        blocks.select("doc_id", "position", md.otherwise(text).alias("md")),
        ["doc_id"], ["position"], F.col("md"), "\n\n", "body", block_bucket(),
    )
    head = F.concat(
        F.lit("---\ntitle: "), "title", F.lit(" | owner: "), "owner", F.lit(" | status: "), "status",
        F.lit(" | verifiedAt: "), F.coalesce("verified_at", F.lit("null")), F.lit("\n---\n\n"),
    )
    return docs.join(body, "doc_id").select(
        "doc_id", F.regexp_replace(F.concat(head, "body"), r"\s+$", "").alias("markdown")
    )
