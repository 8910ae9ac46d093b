"""Question sets, audits, leak-free splits, negatives, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.functions.text import tokenize
from loomgraph.operators.scale import bucketed_row_number, first_per_key, hash_row_number, top_k

# fixed values: question templates
TEMPLATES = [
    "{t} 어떻게 하기로 했나요?",
    "{t} 관련해서 정해진 내용이 뭐예요?",
    "{t}에 대한 결정 사항을 찾아줘",
]


def hash_number(key: Column, seed: str = "") -> Column:
    """First eight hex digits of md5(seed || key) as a number."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed), key.cast("string"))), 1, 8), 16, 10).cast("long")


def question_templates(nodes: DataFrame, key: Column, topic: Column, templates: list[str] = TEMPLATES, seed: str = "42") -> DataFrame:
    """One question per node from a template chosen by a seeded hash."""
    pick = F.element_at(F.array(*[F.lit(t) for t in templates]), (hash_number(key, seed) % len(templates) + 1).cast("int"))
    return nodes.withColumn("question", F.replace(pick, F.lit("{t}"), topic))


def audit_contaminated(rows: DataFrame, question: str, answer: str, limit: float = 0.5) -> DataFrame:
    """Adds ``overlap`` (share of distinct answer tokens in the question) and ``contaminated``."""
    a = F.array_distinct(tokenize(F.col(answer)))
    q = F.array_distinct(tokenize(F.col(question)))
    share = F.when(F.size("__a") > 0, F.size(F.array_intersect("__a", "__q")) / F.size("__a")).otherwise(F.lit(0.0))
    out = rows.withColumn("__a", a).withColumn("__q", q).withColumn("overlap", F.round(share, 6)).drop("__a", "__q")
    return out.withColumn("contaminated", F.col("overlap") > limit)


def best_gold_rank(ranked: DataFrame, gold: DataFrame, qid: str = "qid", item: str = "doc_id") -> DataFrame:
    """Best rank of any gold row per query that has one among its ranked rows."""
    return ranked.join(gold.select(qid, item), [qid, item], "left_semi").groupBy(qid).agg(F.min("rank").alias("rank"))


def audit_unfindable(queries: DataFrame, scores: DataFrame, gold: DataFrame, depth: int = 50) -> DataFrame:
    """Queries with the naive rank of their gold rows within ``depth``; ``kept`` is false where there is none."""
    ranked = top_k(scores, ["qid"], [F.desc("score"), "doc_id"], depth)
    return queries.join(best_gold_rank(ranked, gold), "qid", "left").select(
        "qid", F.col("rank").alias("naive_rank"), F.col("rank").isNotNull().alias("kept"),
        F.coalesce(F.col("rank") == 1, F.lit(False)).alias("trivial"),
    )


def split_by_doc(rows: DataFrame, doc: str, percent: int = 15, seed: str = "42") -> DataFrame:
    """Whole documents go to val, max(1, floor(percent)) of them in hash order, the rest to train."""
    docs = hash_row_number(rows.select(doc).distinct(), F.col(doc), "__pos", seed)
    n = rows.select(doc).distinct().agg(F.count(F.lit(1)).alias("n")).select("n").scalar()
    n_val = F.greatest(F.lit(1), F.floor(n * percent / 100))
    assigned = docs.select(doc, F.when(F.col("__pos") <= n_val, "val").otherwise("train").alias("split"))
    return rows.join(assigned, doc)


def split_by_group(
    rows: DataFrame, group: str, label: str, names: tuple[str, str], share: float | None, seed: str
) -> DataFrame:
    """Whole groups go to one side, stratified by the sorted labels of the group.

    The first side takes round(n · share) groups of each stratum in hash order, or half of
    them, rounded down, when ``share`` is None.
    """
    # counts per label first, so a group's size never matters
    counts = rows.groupBy(group, label).agg(F.count(F.lit(1)).alias("__n"))
    kinds = counts.groupBy(group).agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct(F.col(label).alias("l"), F.col("__n").alias("n")))),
                lambda s: F.concat(s["l"], F.lit("x"), s["n"].cast("string")),
            ),
            ",",
        ).alias("stratum")
    )
    placed = hash_row_number(kinds, F.col(group), "__pos", seed, partition=["stratum"])
    sizes = kinds.groupBy("stratum").agg(F.count(F.lit(1)).alias("__size"))
    first = F.floor(F.col("__size") / 2) if share is None else F.bround(F.col("__size") * share, 0)
    sides = placed.join(sizes, "stratum").select(
        group, "stratum", F.when(F.col("__pos") <= first, names[0]).otherwise(names[1]).alias("split")
    )
    return rows.join(sides, group)


def exclude_trained(cases: DataFrame, trained: DataFrame, question: str, label: str, order: str) -> DataFrame:
    """Cases whose question was not trained on, one per (question, label)."""
    fresh = cases.join(trained.select(question).distinct(), question, "left_anti")
    return first_per_key(fresh, [question, label], [order])


def leak_check(rows: DataFrame, key: str, split: str) -> DataFrame:
    """Number of keys that occur in more than one split."""
    per = rows.groupBy(key).agg((F.min(split) != F.max(split)).alias("leaks"))
    return per.agg(F.count(F.lit(1)).alias("keys"), F.count_if("leaks").alias("leaked"))


def split_balance(rows: DataFrame, split: str, label: str, labels: list[str], floor: int = 50) -> DataFrame:
    """Cases per split and label, with a flag when a split holds few cases to abstain from."""
    abstain = F.count_if(F.col(label).startswith("unanswerable"))
    return rows.groupBy(split).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(F.col(label) == x).alias(f"n_{x}") for x in labels],
        abstain.alias("n_abstain"),
        (abstain < floor).alias("too_few"),
    )


def resplit_docs(rows: DataFrame, doc: str, n_eval: int = 60, n_dev: int = 10) -> DataFrame:
    """The first ``n_eval`` documents go to eval, the next ``n_dev`` to dev, the rest to train."""
    head = rows.select(doc).distinct().orderBy(doc).limit(n_eval + n_dev)
    # at most n_eval + n_dev rows are numbered
    ordered = head.withColumn("__pos", F.row_number().over(W.orderBy(doc)))
    side = ordered.select(doc, F.when(F.col("__pos") <= n_eval, "eval").otherwise("dev").alias("split"))
    return rows.join(side, doc, "left").withColumn("split", F.coalesce("split", F.lit("train")))


def time_split(docs: DataFrame, doc: str, at: str, dev: str, old_share: float = 0.8, min_dev: int = 5) -> DataFrame:
    """Oldest share of the documents to ``old``, the others to ``recent``, each with its train/dev flag.

    If fewer than ``min_dev`` recent rows are dev, the newest recent training document moves there.
    """
    n = docs.agg(F.count(F.lit(1)).alias("n")).select("n").scalar()
    placed = bucketed_row_number(docs, F.to_date(at), [at, doc], "__pos")
    aged = placed.withColumn("era", F.when(F.col("__pos") <= F.floor(n * old_share), "old").otherwise("recent")).drop("__pos")
    recent = aged.where("era = 'recent'")
    n_dev = recent.agg(F.count_if(F.col(dev)).alias("n")).select("n").scalar()
    newest = recent.where(~F.col(dev)).agg(F.max_by(doc, F.struct(at, doc)).alias("m")).select("m").scalar()
    moved = (n_dev < min_dev) & (F.col("era") == "recent") & F.col(doc).eqNullSafe(newest)
    return aged.select(doc, "era", F.when(F.col(dev) | F.coalesce(moved, F.lit(False)), "dev").otherwise("train").alias("split"))


def chunk_pairs(prompts: DataFrame, parsed: DataFrame, doc: str, keys: list[str], n_dev: int = 10) -> DataFrame:
    """Prompt and completion of every chunk whose response parsed; the first ``n_dev`` documents are dev."""
    ok = parsed.where("outcome = 'ok'").select(*keys, F.to_json("extract").alias("completion"))
    rows = prompts.join(ok, keys)
    dev = rows.select(doc).distinct().orderBy(doc).limit(n_dev).withColumn("__dev", F.lit(True))
    return rows.join(dev, doc, "left").withColumn("split", F.when(F.col("__dev"), "dev").otherwise("train")).drop("__dev")


def chunk_failures(parsed: DataFrame) -> DataFrame:
    """How many responses gave a pair, held no JSON, or held broken JSON."""
    return parsed.agg(
        F.count(F.lit(1)).alias("responses"), F.count_if(F.col("outcome") == "ok").alias("pairs"),
        F.count_if(F.col("outcome") == "no_json").alias("no_json"), F.count_if(F.col("outcome") == "invalid_json").alias("invalid_json"),
    )


def chat_questions(answerable: DataFrame, topics: DataFrame, templates: list[str], n: int, seed: str = "42") -> DataFrame:
    """``n`` answerable questions in hash order, and every absent topic in every template.

    ``answerable``: question. ``topics``: topic.
    """
    picked = (
        answerable.select("question").distinct()
        .withColumn("__h", F.md5(F.concat(F.lit(seed), "question")))
        .orderBy("__h", "question").limit(n)
        .select(F.lit("answerable").alias("label"), "question")
    )
    t = F.explode(F.array(*[F.lit(x) for x in templates]))
    absent = topics.select("topic", t.alias("tpl")).select(
        F.lit("unanswerable").alias("label"), F.replace(F.col("tpl"), F.lit("{x}"), F.col("topic")).alias("question")
    )
    return picked.unionByName(absent)


def hard_negatives(scores: DataFrame, gold: DataFrame, k: int = 20) -> DataFrame:
    """Top rows per query with the gold rows removed (hard) and with them (paired).

    Only queries with a gold row are used.
    """
    asked = scores.join(gold.select("qid").distinct(), "qid", "left_semi")
    order = [F.desc("score"), "doc_id"]
    hard = top_k(asked.join(gold.select("qid", "doc_id"), ["qid", "doc_id"], "left_anti"), ["qid"], order, k)
    pair = top_k(asked, ["qid"], order, k)
    return hard.withColumn("label", F.lit("unanswerable_hard")).unionByName(pair.withColumn("label", F.lit("answerable_paired")))


def judged_filter(cases: DataFrame, verdicts: DataFrame, keys: list[str], label: str, refusal: str, answers: list[str]) -> DataFrame:
    """Adds ``verdict``: missing, kept or dropped.

    Cases to abstain from must be refused and the others answered, neither with fabrication.
    """
    v = verdicts.select(*keys, "response", "fabricated")
    clean = ~F.col("fabricated")
    ok = F.when(F.col(label).startswith("unanswerable"), (F.col("response") == refusal) & clean).otherwise(
        F.col("response").isin(*answers) & clean
    )
    verdict = F.when(F.col("response").isNull(), "missing").when(ok, "kept").otherwise("dropped")
    return cases.join(v, keys, "left").withColumn("verdict", verdict)


def judged_counts(judged: DataFrame, label: str, keyword_ok: Column) -> DataFrame:
    """Counts per kind and verdict, with the rows a keyword filter would have kept wrongly."""
    kind = F.when(F.col(label).startswith("unanswerable"), "abstain").otherwise("answer")
    return judged.groupBy(kind.alias("kind"), "verdict").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(keyword_ok & (F.col("verdict") == "dropped")).alias("keyword_would_keep")
    )


def blind_sample(claims: DataFrame, item: str, system: str, per_system: int, seed: str = "42") -> DataFrame:
    """``per_system`` claims of each system in hash order under opaque ids.

    The first two columns form the key table; judges get the opaque id and the claim only.
    """
    h = F.md5(F.concat(F.lit(seed), F.col(item).cast("string")))
    picked = top_k(claims.withColumn("__h", h), [system], ["__h", item], per_system, "__n")
    return picked.withColumn("blind_id", F.concat(F.lit("item-"), F.substring("__h", 1, 12))).drop("__h", "__n")


def length_stats(rows: DataFrame, length: Column, limit: int, empty: Column) -> DataFrame:
    """n, median [n // 2], p95 [int(0.95 n)] and maximum of a length by index, with over-limit and empty counts.

    Equal lengths are counted together first, so the ordered scan runs over distinct lengths.
    """
    per = rows.select(length.alias("len"), empty.alias("e")).groupBy("len").agg(
        F.count(F.lit(1)).alias("c"), F.count_if("e").alias("e")
    )
    cum = per.withColumn("hi", F.sum("c").over(W.orderBy("len").rowsBetween(W.unboundedPreceding, W.currentRow)))
    n = per.agg(F.sum("c").alias("n")).select("n").scalar()

    def pick(index: Column) -> Column:
        # smallest length whose cumulative count passes the zero-based index
        return F.min(F.when(F.col("hi") > index, F.col("len"))).cast("long")

    return cum.agg(
        F.sum("c").alias("n"),
        pick(F.floor(n / 2)).alias("median"),
        pick(F.floor(n * 0.95)).alias("p95"),
        F.max("len").cast("long").alias("max"),
        F.sum(F.when(F.col("len") > limit, F.col("c")).otherwise(0)).alias("over_limit"),
        F.sum("e").alias("empty"),
    )


def export_corpus(bodies: DataFrame, docs: DataFrame, decisions: DataFrame, tacit: DataFrame, min_chars: int = 40, max_chars: int | None = None) -> DataFrame:
    """Training rows: documents with a long enough body and a non-empty target.

    ``decisions`` and ``tacit`` are regrouped triples per document.
    """
    fields = [c for c in decisions.columns if c != "document_id"]
    d = decisions.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("decisions"))
    t = tacit.groupBy("document_id").agg(
        F.array_sort(F.collect_list(F.struct(*[c for c in tacit.columns if c != "document_id"]))).alias("tacit")
    )
    target = d.join(t, "document_id", "full_outer").withColumnRenamed("document_id", "doc_id")
    body = bodies.where(F.length("body") >= min_chars).select("doc_id", (F.col("body") if max_chars is None else F.substring("body", 1, max_chars)).alias("input"))
    return docs.join(body, "doc_id").join(target, "doc_id")
