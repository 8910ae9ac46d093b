"""Message archiving, idempotent imports and block layouts of imported documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.text import WHITE, is_blank, strip
from loomgraph.operators.scale import bucketed_row_number, first_per_key, top_k, unnest
from loomgraph.operators.sections import BLOCK_BUCKET
from loomgraph.session import materialize

# fixed values: section headings and line labels of imported documents
META_HEADING = "회의 정보"
TRANSCRIPT_HEADING = "전사 원문"
SUMMARY_HEADING = "Tiro 제공 요약"
EMPTY_DOCUMENT = "(빈 문서)"
TRUNCATED = "… (문서가 너무 길어 {n}문단에서 잘랐어요. 전체는 원본 링크에서 확인해 주세요.)"
EXTRACT_LABELS = {
    "summary": "요약",
    "decisions": "의사결정",
    "decision": "결정: ",
    "rationale": "근거: ",
    "alternatives": "검토했지만 채택하지 않은 대안: ",
    "owner": "담당: ",
    "condition": "적용 조건: ",
    "tacit": "조직의 암묵지",
    "source": "출처: ",
}


def archive_ingest(messages: DataFrame, channels: DataFrame, archive: DataFrame | None = None, order: str = "delivery") -> DataFrame:
    """New archive rows: opted-in channels, no blanks, first delivery of each (channel, ts).

    With ``archive``, keys already stored are left out, so a redelivery changes nothing.
    """
    on = channels.where("archive_enabled").select("channel_id")
    ok = messages.where(
        ~is_blank(F.col("channel_id")) & ~is_blank(F.col("ts")) & ~is_blank(F.col("user_id")) & ~is_blank(F.col("text"))
    ).join(on, "channel_id", "left_semi")
    if archive is not None:
        ok = ok.join(archive.select("channel_id", "ts"), ["channel_id", "ts"], "left_anti")
    root = F.when(is_blank(F.col("thread_ts")), F.col("ts")).otherwise(F.col("thread_ts"))
    return first_per_key(ok, ["channel_id", "ts"], [order]).select(
        "channel_id", "ts", root.alias("thread_ts"), "user_id", "text", "created_at"
    )


def thread_flatten(parents: DataFrame, replies: DataFrame, limit: int | None = None) -> DataFrame:
    """Parents (the newest ``limit`` per channel if given) with their replies as flat messages.

    ``parents``: channel_id, ts, user_id, text, bot_id, subtype. ``replies``: the same plus
    parent_ts. Bot and system rows and rows without user or text are dropped.
    """
    kept = parents if limit is None else top_k(parents, ["channel_id"], [F.desc("ts")], limit, "__n").drop("__n")
    cols = ["channel_id", "ts", "user_id", "text", "bot_id", "subtype"]
    roots = kept.select(*cols, F.col("ts").alias("thread_ts"))
    under = replies.join(kept.select("channel_id", F.col("ts").alias("parent_ts")), ["channel_id", "parent_ts"], "left_semi")
    rows = roots.unionByName(
        under.where("ts <> parent_ts").select(*cols, F.col("parent_ts").alias("thread_ts"))
    )
    return rows.where(
        F.col("bot_id").isNull() & is_blank(F.col("subtype")) & ~is_blank(F.col("user_id")) & ~is_blank(F.col("text"))
    ).select("channel_id", "ts", "thread_ts", "user_id", "text")


def idempotent_import(incoming: DataFrame, ledger: DataFrame) -> DataFrame:
    """Outcome of each incoming item: skipped (in the ledger), failed (blank text), imported."""
    known = ledger.select("source", "ref").distinct().withColumn("known", F.lit(True))
    once = first_per_key(incoming, ["source", "ref"], ["item_id"])
    return once.join(known, ["source", "ref"], "left").withColumn(
        "outcome",
        F.when(F.col("known"), "skipped").when(is_blank(F.col("text")), "failed").otherwise("imported"),
    ).drop("known")


def outcome_counts(outcomes: DataFrame) -> DataFrame:
    """Job counters in one pass."""
    def n(value: str) -> Column:
        return F.count_if(F.col("outcome") == value)

    return outcomes.groupBy("source").agg(
        F.count(F.lit(1)).alias("found"),
        (n("imported") + n("failed")).alias("processed"),
        n("imported").alias("imported"),
        n("skipped").alias("skipped"),
        n("failed").alias("failed"),
    )


def sync_targets(ledgers: list[DataFrame], triples: DataFrame, force: bool = False) -> DataFrame:
    """Ledger documents that still lack triples; all of them with ``force``."""
    rows = ledgers[0]
    for other in ledgers[1:]:
        rows = rows.unionByName(other)
    rows = rows.select("source", "ref", "document_id")
    if force:
        return rows
    return rows.join(triples.select("document_id").distinct(), "document_id", "left_anti")


def paragraph_blocks(
    docs: DataFrame, max_paragraphs: int | None = None, placeholder: str | None = EMPTY_DOCUMENT, white: str = WHITE
) -> DataFrame:
    """(doc_id, position, text): trimmed non-blank paragraphs, a marker after the cap if there is one, or a placeholder.

    Without ``placeholder`` a document without paragraphs has no row; ``white`` are the characters that are trimmed.
    """
    parts = F.filter(F.transform(F.split("text", r"\n+"), lambda s: F.trim(s, F.lit(white))), lambda s: s != "")
    kept = F.when(F.size(parts) == 0, F.array() if placeholder is None else F.array(F.lit(placeholder)))
    if max_paragraphs is not None:
        cut = F.concat(F.slice(parts, 1, max_paragraphs), F.array(F.lit(TRUNCATED.format(n=max_paragraphs))))
        kept = kept.when(F.size(parts) > max_paragraphs, cut)
    kept = kept.otherwise(parts)
    return unnest(docs, ["doc_id"], kept, "text", "position").select(
        "doc_id", F.col("position").cast("long").alias("position"), "text"
    )


def _positions(rows: DataFrame, key: str) -> DataFrame:
    """Positions from 0 in (section, ord, sub) order, without one task per document."""
    numbered = bucketed_row_number(
        rows,
        F.col("section") * 1_000_000 + F.floor(F.col("ord") / BLOCK_BUCKET),
        ["section", "ord", "sub"],
        "__n",
        partition=[key],
    )
    return numbered.select(key, (F.col("__n") - 1).alias("position"), "type", "text")


def transcript_blocks(meetings: DataFrame, segments: DataFrame) -> DataFrame:
    """Blocks of a meeting: details, transcript lines with time range, optional summaries.

    ``meetings``: meeting_id plus authors, participants, started, seconds, url.
    ``segments``: meeting_id, ord, time_from, time_to, transcript, summary.
    """
    minutes = F.greatest(F.lit(1), F.floor(F.col("seconds") / 60.0 + 0.5)).cast("string")
    # fixed values: labels of the meeting detail lines
    lines = [
        ("작성자", F.col("authors")),
        ("참석자", F.col("participants")),
        ("녹음 시작", F.col("started")),
        ("길이", F.when(F.col("seconds").isNotNull(), F.concat(minutes, F.lit("분")))),
        ("출처", F.col("url")),
    ]

    def block(section: int, ord_: Column, kind: str, text: Column):
        return [
            "meeting_id",
            F.lit(section).cast("long").alias("section"),
            ord_.cast("long").alias("ord"),
            F.lit(0).alias("sub"),
            F.lit(kind).alias("type"),
            text.alias("text"),
        ]

    labelled = F.array(
        *[F.when(~is_blank(v), F.concat(F.lit(k + ": "), v)) for k, v in lines]
    )
    detail = unnest(meetings, ["meeting_id"], labelled, "text", "ord")
    span = (
        F.when(~is_blank(F.col("time_from")) & ~is_blank(F.col("time_to")), F.concat(F.lit("["), "time_from", F.lit(" - "), "time_to", F.lit("]")))
        .when(~is_blank(F.col("time_from")), F.concat(F.lit("["), "time_from", F.lit("]")))
        .otherwise("")
    )
    said = segments.where(~is_blank(F.col("transcript")))
    summed = segments.where(~is_blank(F.col("summary")))
    rows = (
        meetings.select(*block(0, F.lit(0), "HEADING2", F.lit(META_HEADING)))
        .unionByName(detail.select(*block(1, F.col("ord"), "PARAGRAPH", F.col("text"))))
        .unionByName(meetings.select(*block(2, F.lit(0), "HEADING2", F.lit(TRANSCRIPT_HEADING))))
        .unionByName(said.select(*block(3, F.col("ord"), "PARAGRAPH", F.concat(span, F.lit(" "), strip(F.col("transcript"))))))
        .unionByName(summed.select("meeting_id").distinct().select(*block(4, F.lit(0), "HEADING2", F.lit(SUMMARY_HEADING))))
        .unionByName(summed.select(*block(5, F.col("ord"), "PARAGRAPH", strip(F.col("summary")))))
    )
    return _positions(rows, "meeting_id")


def extract_blocks(extracts: DataFrame) -> DataFrame:
    """Readable blocks of an extraction struct (document_id, source_ref, extract)."""
    lab = EXTRACT_LABELS
    e = F.col("extract")

    def para(text: Column) -> Column:
        return F.struct(F.lit("PARAGRAPH").alias("type"), text.alias("text"))

    def head(text: str) -> Column:
        return F.struct(F.lit("HEADING2").alias("type"), F.lit(text).alias("text"))

    def opt(label: str, value: Column) -> Column:
        return F.when(~is_blank(value), para(F.concat(F.lit(label), value)))

    def decision(p: Column) -> Column:
        alts = F.array_join(p["alternatives"], ", ")
        return F.array(
            para(F.concat(F.lit(lab["decision"]), p["decision"])),
            opt(lab["rationale"], p["rationale"]),
            opt(lab["alternatives"], alts),
            opt(lab["owner"], p["owner"]),
            opt(lab["condition"], p["condition"]),
        )

    def tacit(t: Column) -> Column:
        first = F.array(para(F.concat(F.lit("["), t["kind"], F.lit("] "), t["statement"])))
        rest = F.transform(
            F.coalesce(t["triples"], F.array()),
            lambda x: para(F.concat(F.lit("  · "), x["subject"], F.lit(" — "), x["predicate"], F.lit(" — "), x["object"])),
        )
        return F.concat(first, rest)

    dec = F.coalesce(e["decisionPoints"], F.expr("slice(extract.decisionPoints, 1, 0)"))
    tac = F.coalesce(e["tacitKnowledge"], F.expr("slice(extract.tacitKnowledge, 1, 0)"))
    empty = F.expr("cast(array() as array<struct<type:string,text:string>>)")
    blocks = F.concat(
        F.array(head(lab["summary"])),
        F.coalesce(F.transform(e["summary"], para), empty),
        F.when(F.size(dec) > 0, F.array(head(lab["decisions"]))).otherwise(empty),
        F.coalesce(F.flatten(F.transform(dec, decision)), empty),
        F.when(F.size(tac) > 0, F.array(head(lab["tacit"]))).otherwise(empty),
        F.coalesce(F.flatten(F.transform(tac, tacit)), empty),
        F.array(para(F.concat(F.lit(lab["source"]), F.col("source_ref")))),
    )
    # one extraction is one row, so its blocks are numbered inside the row
    kept = F.filter(blocks, lambda b: b.isNotNull())
    return unnest(extracts, ["document_id"], kept, "b", "position").select(
        "document_id", F.col("position").cast("long").alias("position"), "b.type", "b.text"
    )


def block_type(node: Column) -> Column:
    """Block type of an editor node given as JSON."""
    kind = F.get_json_object(node, "$.type")
    level = F.get_json_object(node, "$.attrs.level").cast("int")
    # fixed values: editor node types
    names = {
        "bulletList": "BULLET_LIST",
        "orderedList": "ORDERED_LIST",
        "codeBlock": "CODE",
        "table": "TABLE",
        "blockquote": "QUOTE",
        "image": "IMAGE",
    }
    out = F.when((kind == "heading") & (level == 2), "HEADING2").when((kind == "heading") & (level == 3), "HEADING3")
    out = out.when(kind == "heading", "HEADING1")
    for name, value in names.items():
        out = out.when(kind == name, value)
    return out.otherwise("PARAGRAPH")


def channel_merge(listed: DataFrame, stored: DataFrame) -> DataFrame:
    """Listed channels and stored settings: stored flag, listed name, default off."""
    a = listed.select("channel_id", F.col("name").alias("listed_name"))
    b = stored.select("channel_id", F.col("name").alias("stored_name"), "archive_enabled")
    return a.join(b, "channel_id", "full_outer").select(
        "channel_id",
        F.coalesce("listed_name", "stored_name").alias("name"),
        F.coalesce("archive_enabled", F.lit(False)).alias("archive_enabled"),
    )


def folder_files(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """All documents below each root folder at any depth.

    ``nodes``: node, parent, is_folder. Folders are reached by doubling: jumps of 1, 2, 4 … levels are joined with
    themselves, so a chain of n folders takes about log2(n) rounds, and a round that reaches nothing new is the last, also
    where folders contain each other. Each round is written, so the plan stays flat.
    """
    jump = nodes.where("is_folder AND parent IS NOT NULL").select(F.col("parent").alias("a"), F.col("node").alias("b")).distinct()
    seen = roots.select(F.col("node").alias("root"), F.col("node").alias("folder")).distinct()
    jump, seen = materialize(jump, "folder-jumps"), materialize(seen, "folders")
    reached = seen.count()
    while True:
        far = seen.join(jump, seen["folder"] == jump["a"]).select("root", F.col("b").alias("folder"))
        seen = materialize(seen.unionByName(far).distinct(), "folders")
        before, reached = reached, seen.count()
        if reached == before:
            break
        then = jump.select(F.col("a").alias("b"), F.col("b").alias("c"))
        jump = materialize(jump.join(then, "b").select("a", F.col("c").alias("b")).distinct(), "folder-jumps")
    files = nodes.where("NOT is_folder").select("node", F.col("parent").alias("folder"))
    return seen.join(files, "folder").select("root", "node").distinct()


def upsert_latest(current: DataFrame, incoming: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Newest row per key of both frames; partial maxima are taken before the shuffle."""
    both = current.unionByName(incoming)
    rest = [c for c in both.columns if c not in keys]
    best = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(version)).alias("__r"))
    return best.select(*keys, *[F.col("__r")[c].alias(c) for c in rest])
