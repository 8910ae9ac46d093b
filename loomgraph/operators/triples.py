"""Knowledge triples: building, normalising, replacing and regrouping them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.eventtime import event_time_epoch
from loomgraph.functions.normalize import EntityRules, canonical_predicate, normalize_entity, split_colisted
from loomgraph.functions.text import is_blank, strip
from loomgraph.operators.scale import first_per_key, unnest

RULES = EntityRules()


@dataclass(frozen=True)
class Roles:
    """Names of the edges of an event node."""

    # fixed values: prefix of event nodes and the predicates of their edges
    prefix: str = "결정:"
    owner: str = "주체"
    topic: str = "대상"
    value: str = "값"
    rationale: str = "근거"
    condition: str = "조건"
    rejected: str = "기각대안"
    default_owner: str = "팀"
    separator: str = " — "


EXTRACT_SCHEMA = (
    "struct<worthRecording:boolean,title:string,summary:array<string>,"
    "decisionPoints:array<struct<topic:string,decision:string,outcome:string,owner:string,rationale:string,"
    "condition:string,alternatives:array<string>>>,"
    "tacitKnowledge:array<struct<kind:string,statement:string,"
    "triples:array<struct<subject:string,predicate:string,object:string>>>>>"
)


def reify_decisions(extracts: DataFrame, roles: Roles = Roles(), rules: EntityRules = RULES) -> DataFrame:
    """Event-node edges of every decision (document_id, extract → triples).

    A decision whose topic is no entity is dropped; blank fields give no edge; a co-listed
    owner gives one edge each, a blank owner the default.
    """
    points = unnest(extracts, ["document_id"], F.col("extract.decisionPoints"), "p", "i")
    p = F.col("p")
    topic = normalize_entity(p["topic"], rules)
    owners = split_colisted(p["owner"], rules)
    owners = F.when(is_blank(p["owner"]) | (F.size(owners) == 0), F.array(F.lit(roles.default_owner))).otherwise(owners)

    def edge(name: str, value: Column) -> Column:
        return F.struct(F.lit(name).alias("predicate"), value.alias("object"))

    def one(name: str, value: Column) -> Column:
        return F.when(~is_blank(value), F.array(edge(name, strip(value)))).otherwise(none)

    none = F.expr("cast(array() as array<struct<predicate:string,object:string>>)")
    alts = F.filter(F.coalesce(p["alternatives"], F.array().cast("array<string>")), lambda a: ~is_blank(a))
    edges = F.concat(
        F.transform(owners, lambda o: edge(roles.owner, o)),
        F.array(edge(roles.topic, topic)),
        one(roles.value, p["outcome"]),
        one(roles.rationale, p["rationale"]),
        one(roles.condition, p["condition"]),
        F.transform(alts, lambda a: edge(roles.rejected, strip(a))),
    )
    statement = F.concat(
        p["decision"], F.when(~is_blank(p["rationale"]), F.concat(F.lit(roles.separator), p["rationale"])).otherwise("")
    )
    named = points.withColumn("topic", topic).where("topic IS NOT NULL")
    rows = unnest(
        named,
        ["document_id", "i", statement.alias("statement"), F.concat(F.lit(roles.prefix), "topic").alias("subject")],
        edges, "e", "j",
    )
    return rows.select(
        "document_id",
        place(0).alias("ordinal"),
        F.lit("decision").alias("kind"),
        "statement", "subject", "e.predicate", "e.object",
    )


def place(kind: int) -> Column:
    """Order of the triples of a document: decisions (0) before tacit items (1), then item, then edge; 2**31 of each."""
    return F.lit(kind << 62) + F.shiftleft(F.col("i").cast("long"), 31) + F.col("j")


def tacit_triples(extracts: DataFrame, rules: EntityRules = RULES) -> DataFrame:
    """Normalised triples of the tacit items; a row with a rejected part is dropped."""
    items = unnest(extracts, ["document_id"], F.col("extract.tacitKnowledge"), "t", "i")
    rows = unnest(items, ["document_id", "i", F.col("t.kind").alias("kind"), F.col("t.statement").alias("statement")],
                  F.col("t.triples"), "x", "j")
    parts = rows.select(
        "document_id",
        place(1).alias("ordinal"),
        "kind", "statement",
        split_colisted(F.col("x.subject"), rules).alias("ss"),
        canonical_predicate(F.col("x.predicate"), rules).alias("predicate"),
        split_colisted(F.col("x.object"), rules).alias("os"),
    ).where("predicate IS NOT NULL")
    subjects = unnest(parts, ["document_id", "ordinal", "kind", "statement", "predicate", "os"], F.col("ss"), "subject")
    return unnest(subjects, ["document_id", "ordinal", "kind", "statement", "subject", "predicate"], F.col("os"), "object")


def dedup_in_doc(triples: DataFrame) -> DataFrame:
    """One row per (document, subject, predicate, object): the lowest ordinal."""
    return first_per_key(triples, ["document_id", "subject", "predicate", "object"], ["ordinal"])


def replace_doc_triples(stored: DataFrame, fresh: DataFrame, drafts: DataFrame) -> DataFrame:
    """Stored triples with those of re-extracted draft documents replaced by the new set.

    New rows of documents that are stored and no longer drafts are ignored.
    """
    again = fresh.select("document_id").distinct()
    replaceable = again.join(drafts.select("document_id").distinct(), "document_id", "left_semi")
    kept = stored.join(replaceable, "document_id", "left_anti")
    frozen = stored.select("document_id").distinct().join(replaceable, "document_id", "left_anti")
    new = fresh.join(frozen, "document_id", "left_anti")
    return kept.unionByName(new)


def renormalize_graph(triples: DataFrame, roles: Roles = Roles(), rules: EntityRules = RULES) -> DataFrame:
    """Stored triples under the current rules, deduplicated; event nodes keep their prefix."""
    def entity(name: str) -> Column:
        c = F.col(name)
        node = c.startswith(roles.prefix)
        topic = normalize_entity(F.substr(c, F.lit(len(roles.prefix) + 1), F.length(c)), rules)
        return F.when(node, F.concat(F.lit(roles.prefix), topic)).otherwise(normalize_entity(c, rules))

    event = F.col("subject").startswith(roles.prefix)
    # values, reasons and conditions of event nodes are free text
    obj = F.when(event, strip(F.col("object"))).otherwise(entity("object"))
    predicate = F.when(event, F.col("predicate")).otherwise(canonical_predicate(F.col("predicate"), rules))
    rows = triples.withColumns({"__s": entity("subject"), "__p": predicate, "__o": obj})
    rows = rows.where("__s IS NOT NULL AND __p IS NOT NULL AND __o IS NOT NULL AND __o <> ''")
    rows = rows.withColumns({"subject": F.col("__s"), "predicate": F.col("__p"), "object": F.col("__o")}).drop("__s", "__p", "__o")
    return dedup_in_doc(rows)


def renormalize_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """Row counts before and after, and the difference."""
    b = before.agg(F.count(F.lit(1)).alias("n")).select("n").scalar()
    return after.agg(F.count(F.lit(1)).alias("after")).select(
        b.alias("before"), "after", (b - F.col("after")).alias("dropped")
    )


def derive_extract(triples: DataFrame, roles: Roles = Roles()) -> DataFrame:
    """Decisions regrouped from event-node edges, one row per (document, event node).

    Owners and values are joined with ``, `` in row order; for the other roles the last row wins.
    """
    rows = triples.where(F.col("subject").startswith(roles.prefix))
    pred = F.col("predicate")
    at = F.col("ordinal")

    def joined(role: str) -> Column:
        items = F.array_sort(F.collect_list(F.when(pred == role, F.struct(at.alias("n"), F.col("object").alias("o")))))
        return F.array_join(F.transform(items, lambda s: s["o"]), ", ")

    def last(role: str) -> Column:
        return F.coalesce(F.max_by("object", F.when(pred == role, at)), F.lit(""))

    statement = F.min_by("statement", at)
    return rows.groupBy("document_id", "subject").agg(
        F.get(F.split(statement, roles.separator), F.lit(0)).alias("decision"),
        last(roles.topic).alias("topic"),
        joined(roles.value).alias("outcome"),
        joined(roles.owner).alias("owner"),
        last(roles.rationale).alias("rationale"),
        last(roles.condition).alias("condition"),
        joined(roles.rejected).alias("alternatives"),
    )


def derive_tacit(triples: DataFrame, roles: Roles = Roles()) -> DataFrame:
    """Other triples regrouped by statement: kind and the number of triples."""
    rows = triples.where(~F.col("subject").startswith(roles.prefix))
    return rows.groupBy("document_id", "statement").agg(
        F.max_by("kind", "ordinal").alias("kind"), F.count(F.lit(1)).alias("n_triples")
    )


def backfill_event_time(docs: DataFrame, triples: DataFrame, drive: str = "drive", other: tuple = ("tiro", "meetily")) -> DataFrame:
    """Event time of every triple and of its document.

    ``docs``: doc_id, event_at (from the title). ``triples``: triple_id, document_id,
    channel_id, thread_ts. Drive triples copy the document; chat triples use the thread time;
    a document without a time takes the earliest of its triples.
    """
    d = docs.select(F.col("doc_id").alias("document_id"), F.col("event_at").alias("title_at"))
    channel = F.col("channel_id")
    dated = triples.join(d, "document_id", "left").withColumn(
        "event_at",
        F.when(channel == drive, F.col("title_at")).when(~channel.isin(*other), event_time_epoch(F.col("thread_ts"))),
    )
    earliest = dated.groupBy("document_id").agg(F.min("event_at").alias("first_at"))
    return dated.join(earliest, "document_id").select(
        "triple_id", "document_id", "channel_id", "event_at", F.coalesce("title_at", "first_at").alias("doc_event_at")
    )


# fixed values: coefficients of commitment and salience
COMMITMENT_WEIGHT = {"확정": 1.0, "조건부확정": 0.9, "의지예정": 0.7, "제안검토": 0.45, "당위": 0.4, "비결정": 0.2}
SALIENCE_WEIGHT = {"core": 1.0, "supporting": 0.75, "peripheral": 0.5}
# fixed values: grade shown for each commitment
GRADE_OF = {"확정": "확정", "조건부확정": "조건부", "의지예정": "예정", "제안검토": "논의", "당위": "논의", "비결정": "논의"}
UNGRADED = "미분류"


def lookup(col: Column, table: dict) -> Column:
    """Value of a small literal table, null when absent."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), col)


def node_weights(triples: DataFrame, judgments: DataFrame, commitment=None, salience=None) -> DataFrame:
    """Weight of every edge of a judged event node, null where no judgment exists."""
    w = lookup(F.col("commitment"), commitment or COMMITMENT_WEIGHT) * lookup(F.col("salience"), salience or SALIENCE_WEIGHT)
    table = judgments.select("document_id", "subject", F.round(w, 6).alias("weight"))
    return triples.join(table, ["document_id", "subject"], "left")


def weight_coverage(weighted: DataFrame) -> DataFrame:
    """Edges with and without a weight."""
    return weighted.agg(
        F.count_if(F.col("weight").isNotNull()).alias("matched"), F.count_if(F.col("weight").isNull()).alias("unmatched")
    )


def grade_labels(triples: DataFrame, judgments: DataFrame, grades=None, ungraded: str = UNGRADED) -> DataFrame:
    """Grade tag of every triple, read from the judgment; a condition follows as a suffix."""
    g = lookup(F.col("commitment"), grades or GRADE_OF)
    table = judgments.select("document_id", "subject", g.alias("__g"), F.col("condition"))
    tag = F.concat(F.lit("["), F.coalesce("__g", F.lit(ungraded)), F.lit("]"))
    # fixed value: form of the condition suffix
    suffix = F.when(~is_blank(F.col("condition")), F.concat(F.lit(" (조건: "), strip(F.col("condition")), F.lit(")"))).otherwise("")
    return triples.join(table, ["document_id", "subject"], "left").withColumn("grade", F.concat(tag, suffix)).drop("__g", "condition")
