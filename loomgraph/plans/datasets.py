"""Question sets, splits, negatives and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.operators import datasets as DS
from loomgraph.operators import documents as D
from loomgraph.operators import passages as P
from loomgraph.operators import retrieval as R
from loomgraph.operators import triples as TR
from loomgraph.plans import documents as PD
from loomgraph.plans import graph as PG
from loomgraph.plans import inputs as I
from loomgraph.plans import modelio as PM
from loomgraph.plans import search
from loomgraph.plans.oracle_views import hashed, oracle
from loomgraph.plans.registry import Plans
from loomgraph.sources.tables import read_table, read_spread

PLANS = Plans()
LABELS = ["answerable", "answerable_paired", "unanswerable", "unanswerable_hard"]
QUESTIONS = ["What was decided on {t}?", "What is settled about {t}?", "Find the decision on {t}"]

EXTRA = {
    **PM.EXTRA,
    "v_qnode": f"""
SELECT document_id, subject, replace(['What was decided on {{t}}?', 'What is settled about {{t}}?', 'Find the decision on {{t}}'][{hashed("'42' || document_id || '|' || subject")} % 3 + 1], '{{t}}', substr(subject, 10)) AS question,
  statement AS answer FROM v_node""",
    "v_aud": r"""
SELECT document_id, subject, question, answer, round(CASE WHEN len(a) > 0 THEN len(list_intersect(a, q)) / len(a) ELSE 0 END, 6) AS overlap FROM (
  SELECT *, list_distinct(regexp_extract_all(lower(answer), '[\p{L}\p{Nd}]+')) AS a, list_distinct(regexp_extract_all(lower(question), '[\p{L}\p{Nd}]+')) AS q FROM v_qnode)""",
    "v_naive": """
SELECT qid, naive_rank FROM v_query LEFT JOIN (
  SELECT h.qid, min(h.rank) AS naive_rank FROM v_hit h JOIN v_gold g ON g.qid = h.qid AND g.doc_id = h.doc_id WHERE h.rank <= 50 GROUP BY h.qid) USING (qid)""",
    "v_kind": "SELECT question, string_agg(label || 'x' || n, ',' ORDER BY label) AS stratum FROM (SELECT question, label, count(*) AS n FROM v_case GROUP BY ALL) GROUP BY question",
    "v_pool": """
SELECT case_id, question, label FROM (SELECT *, row_number() OVER (PARTITION BY question, label ORDER BY case_id) AS rn FROM v_case
WHERE question NOT IN (SELECT question FROM v_case WHERE conv_id % 6 = 0)) WHERE rn = 1""",
    "v_body": """
SELECT doc_id, string_agg(line, chr(10) ORDER BY position) AS body FROM v_block WHERE type = 'PARAGRAPH' AND trim(line) <> '' GROUP BY doc_id""",
}


def sides(names, first: str, seed: str) -> str:
    return f"""
SELECT case_id, question, label, stratum, CASE WHEN pos <= {first} THEN '{names[0]}' ELSE '{names[1]}' END AS split FROM v_case JOIN (
  SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY md5('{seed}' || question), question) AS pos, count(*) OVER (PARTITION BY stratum) AS n FROM v_kind) USING (question)"""


EXTRA["v_halves"] = sides(("select", "test"), "n // 2", "2026")


def sql(text: str) -> str:
    return oracle(text, EXTRA)


def question_rows(spark, d):
    nodes = D.decision_nodes(I.v_decision_triple(spark, d), "decision:")
    key = F.concat_ws("|", F.col("document_id"), "subject")
    topic = F.substr("subject", F.lit(10), F.length("subject"))
    return DS.question_templates(nodes, key, topic, QUESTIONS, "42").withColumnRenamed("statement", "answer")


@PLANS.add("question_templates", sql("SELECT document_id, subject, question FROM v_qnode"))
def question_templates(spark, d):
    return question_rows(spark, d).select("document_id", "subject", "question")


@PLANS.add("audit_contaminated", sql("SELECT document_id, subject, overlap, overlap > 0.3 AS contaminated FROM v_aud"))
def audit_contaminated(spark, d):
    out = DS.audit_contaminated(question_rows(spark, d), "question", "answer", 0.3)
    return out.select("document_id", "subject", "overlap", "contaminated")


@PLANS.add("audit_unfindable", sql("SELECT qid, naive_rank, naive_rank IS NOT NULL AS kept, coalesce(naive_rank = 1, false) AS trivial FROM v_naive"))
def audit_unfindable(spark, d):
    return DS.audit_unfindable(I.v_query(spark, d), search.doc_scores(spark, d), I.v_gold(spark, d))


@PLANS.add(
    "split_by_doc",
    sql("""
SELECT document_id, subject, CASE WHEN pos <= greatest(1, floor(n * 15 / 100)) THEN 'val' ELSE 'train' END AS split FROM v_qnode JOIN (
  SELECT document_id, row_number() OVER (ORDER BY md5('42' || document_id), CAST(document_id AS VARCHAR)) AS pos, count(*) OVER () AS n
  FROM (SELECT DISTINCT document_id FROM v_qnode)) USING (document_id)"""),
)
def split_by_doc(spark, d):
    return DS.split_by_doc(question_rows(spark, d), "document_id").select("document_id", "subject", "split")


def halves(spark, d):
    return DS.split_by_group(I.v_case(spark, d), "question", "label", ("select", "test"), None, "2026")


@PLANS.add("split_by_group", sql("SELECT case_id, stratum, split FROM v_halves"))
def split_by_group(spark, d):
    return halves(spark, d).select("case_id", "stratum", "split")


@PLANS.add("split_dev_share", sql(f"SELECT case_id, stratum, split FROM ({sides(('dev', 'train'), 'round_even(n * 0.15, 0)', '42')})"))
def split_dev_share(spark, d):
    out = DS.split_by_group(I.v_case(spark, d), "question", "label", ("dev", "train"), 0.15, "42")
    return out.select("case_id", "stratum", "split")


@PLANS.add("exclude_trained", sql("SELECT * FROM v_pool"))
def exclude_trained(spark, d):
    cases = I.v_case(spark, d)
    trained = cases.where("conv_id % 6 = 0").select("question")
    return DS.exclude_trained(cases, trained, "question", "label", "case_id").select("case_id", "question", "label")


@PLANS.add("leak_check", sql("SELECT count(*) AS keys, count(*) FILTER (WHERE n > 1) AS leaked FROM (SELECT question, count(DISTINCT split) AS n FROM v_halves GROUP BY question)"))
def leak_check(spark, d):
    return DS.leak_check(halves(spark, d), "question", "split")


@PLANS.add(
    "split_balance",
    sql("""
SELECT split, count(*) AS n, count(*) FILTER (WHERE label = 'answerable') AS n_answerable, count(*) FILTER (WHERE label = 'answerable_paired') AS n_answerable_paired,
  count(*) FILTER (WHERE label = 'unanswerable') AS n_unanswerable, count(*) FILTER (WHERE label = 'unanswerable_hard') AS n_unanswerable_hard,
  count(*) FILTER (WHERE label LIKE 'unanswerable%') AS n_abstain, count(*) FILTER (WHERE label LIKE 'unanswerable%') < 50 AS too_few FROM v_halves GROUP BY split"""),
)
def split_balance(spark, d):
    return DS.split_balance(halves(spark, d), "split", "label", LABELS)


@PLANS.add(
    "resplit_docs",
    sql("""
SELECT doc_id, chunk, CASE WHEN r <= 60 THEN 'eval' WHEN r <= 70 THEN 'dev' ELSE 'train' END AS split
FROM (SELECT doc_id, chunk, dense_rank() OVER (ORDER BY doc_id) AS r FROM v_pack)"""),
)
def resplit_docs(spark, d):
    return DS.resplit_docs(P.paragraph_pack(read_spread(spark, d), PD.PACK), "doc_id").select("doc_id", "chunk", "split")


@PLANS.add(
    "time_split",
    sql("""
WITH a AS (SELECT doc_id, created_at, doc_id % 300 = 0 AS dev, row_number() OVER (ORDER BY created_at, doc_id) <= floor(count(*) OVER () * 0.8) AS old FROM v_doc),
m AS (SELECT arg_max(doc_id, (created_at, doc_id)) AS doc_id FROM a WHERE NOT old AND NOT dev)
SELECT a.doc_id, CASE WHEN old THEN 'old' ELSE 'recent' END AS era,
  CASE WHEN dev OR (NOT old AND a.doc_id = m.doc_id AND (SELECT count(*) FROM a WHERE dev AND NOT old) < 5) THEN 'dev' ELSE 'train' END AS split FROM a, m"""),
)
def time_split(spark, d):
    docs = I.v_doc(spark, d).selectExpr("doc_id", "created_at", "doc_id % 300 = 0 AS dev")
    return DS.time_split(docs, "doc_id", "created_at", "dev")


@PLANS.add(
    "chunk_sft_pairs",
    sql("""
SELECT document_id, 'Extract: ' || document_id AS prompt, CASE WHEN document_id IN (SELECT document_id FROM v_parsed WHERE outcome = 'ok' ORDER BY document_id LIMIT 10) THEN 'dev' ELSE 'train' END AS split
FROM v_parsed WHERE outcome = 'ok'"""),
)
def chunk_sft_pairs(spark, d):
    parsed = PM.parsed(spark, d)
    prompts = parsed.select("document_id", F.concat(F.lit("Extract: "), "document_id").alias("prompt"))
    return DS.chunk_pairs(prompts, parsed, "document_id", ["document_id"]).select("document_id", "prompt", "split")


@PLANS.add(
    "chunk_sft_failures",
    sql("SELECT count(*) AS responses, count(*) FILTER (WHERE outcome = 'ok') AS pairs, count(*) FILTER (WHERE outcome = 'no_json') AS no_json, count(*) FILTER (WHERE outcome = 'invalid_json') AS invalid_json FROM v_parsed"),
)
def chunk_sft_failures(spark, d):
    return DS.chunk_failures(PM.parsed(spark, d))


ABSENT = ["Is there a policy on {x}?", "Who owns {x}?", "When was {x} decided?"]

EXTRA["v_chatq"] = """
SELECT 'answerable' AS label, question FROM (SELECT DISTINCT q AS question FROM v_query) ORDER BY md5('42' || question), question LIMIT 100"""
EXTRA["v_chatall"] = """
SELECT label, question FROM (SELECT * FROM v_chatq)
UNION ALL SELECT 'unanswerable', replace(t, '{x}', lower(p_type)) FROM (SELECT DISTINCT p_type FROM part),
  (SELECT unnest(['Is there a policy on {x}?', 'Who owns {x}?', 'When was {x} decided?']) AS t)"""
EXTRA["v_chatterm"] = r"""
SELECT question, term, count(*) AS qtf FROM (SELECT question, unnest(regexp_extract_all(lower(question), '[\p{L}\p{Nd}]+')) AS term FROM (SELECT DISTINCT question FROM v_chatall)) GROUP BY ALL"""


@PLANS.add(
    "chat_cases",
    sql("""
SELECT c.label, c.question, facts, n_facts FROM v_chatall c LEFT JOIN (
  SELECT question, string_agg(rank || '. ' || title, chr(10) ORDER BY rank) AS facts, count(*) AS n_facts FROM (
    SELECT *, row_number() OVER (PARTITION BY question ORDER BY score DESC, doc_id) AS rank FROM (
      SELECT question, doc_id, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avgdl))), 6) AS score
      FROM v_chatterm JOIN v_term USING (term) JOIN v_post USING (term), v_total GROUP BY question, doc_id) WHERE score > 0)
  JOIN v_doc USING (doc_id) WHERE rank <= 5 GROUP BY question) f ON f.question = c.question"""),
)
def chat_cases(spark, d):
    topics = read_table(spark, d, "part").select(F.lower("p_type").alias("topic")).distinct()
    cases = DS.chat_questions(I.v_query(spark, d).select(F.col("q").alias("question")), topics, ABSENT, 100)
    asked = cases.select("question").distinct()
    top = R.bm25_search(search.docs(spark, d), "doc_id", "text", asked.withColumn("q", F.col("question")), "question", "q", 5)
    rows = top.join(I.v_doc(spark, d).select("doc_id", "title"), "doc_id")
    return cases.join(R.render_facts(rows, "question", F.col("title")), "question", "left").select("label", "question", "facts", "n_facts")


@PLANS.add(
    "hard_negatives",
    sql("""
SELECT 'answerable_paired' AS label, qid, doc_id, score, rank FROM v_hit WHERE qid IN (SELECT qid FROM v_gold) AND rank <= 20
UNION ALL
SELECT 'unanswerable_hard', qid, doc_id, score, rank FROM (SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank
  FROM v_score WHERE qid IN (SELECT qid FROM v_gold) AND (qid, doc_id) NOT IN (SELECT (qid, doc_id) FROM v_gold)) WHERE rank <= 20"""),
)
def hard_negatives(spark, d):
    return DS.hard_negatives(search.stored_scores(spark, d), search.stored_gold(spark, d))


def judged(spark, d):
    cases = I.v_case(spark, d)
    verdicts = I.v_case(spark, d).withColumn("h", DS.hash_number(F.col("case_id"))).where("h % 10 <> 0").selectExpr(
        "case_id", "label", "CASE h % 3 WHEN 0 THEN 'answer' WHEN 1 THEN 'partial' ELSE 'refusal' END AS response", "h % 4 = 0 AS fabricated"
    )
    return DS.judged_filter(cases, verdicts, ["case_id", "label"], "label", "refusal", ["answer", "partial"])


EXTRA["v_judged"] = f"""
SELECT case_id, label, question, CASE WHEN h % 10 = 0 THEN 'missing' WHEN h % 4 = 0 THEN 'dropped'
  WHEN (label LIKE 'unanswerable%') = (h % 3 = 2) THEN 'kept' ELSE 'dropped' END AS verdict FROM (SELECT *, {hashed("case_id")} AS h FROM v_case)"""


@PLANS.add("judged_filter", sql("SELECT case_id, label, verdict FROM v_judged"))
def judged_filter(spark, d):
    return judged(spark, d).select("case_id", "label", "verdict")


@PLANS.add(
    "judged_counts",
    sql("""SELECT CASE WHEN label LIKE 'unanswerable%' THEN 'abstain' ELSE 'answer' END AS kind, verdict, count(*) AS n,
count(*) FILTER (WHERE verdict = 'dropped' AND contains(question, 'e')) AS keyword_would_keep FROM v_judged GROUP BY ALL"""),
)
def judged_counts(spark, d):
    return DS.judged_counts(judged(spark, d), "label", F.col("question").contains("e"))


@PLANS.add(
    "blind_sample",
    sql("""
SELECT 'item-' || substr(h, 1, 12) AS blind_id, system, doc_id, claim FROM (
  SELECT *, row_number() OVER (PARTITION BY system ORDER BY h) AS n FROM (SELECT *, md5('42' || doc_id || '-' || claim_id) AS h FROM v_claim)) WHERE n <= 25"""),
)
def blind_sample(spark, d):
    claims = I.v_claim(spark, d).withColumn("item", F.concat_ws("-", "doc_id", "claim_id"))
    return DS.blind_sample(claims, "item", "system", 25).select("blind_id", "system", "doc_id", "claim")


@PLANS.add(
    "length_stats",
    """
SELECT count(*) AS n, list_sort(list(length(text)))[count(*) // 2 + 1] AS median, list_sort(list(length(text)))[CAST(floor(count(*) * 0.95) AS BIGINT) + 1] AS p95,
  max(length(text)) AS max, count(*) FILTER (WHERE length(text) > 8000) AS over_limit, count(*) FILTER (WHERE trim(text) = '') AS empty FROM documents""",
)
def length_stats(spark, d):
    return DS.length_stats(read_spread(spark, d), F.length("text"), 8000, F.trim("text") == "")


@PLANS.add(
    "export_corpus",
    sql("""
SELECT d.doc_id, d.title, body AS input, n AS n_decisions, topics FROM v_doc d JOIN v_body USING (doc_id) JOIN (
  SELECT document_id, count(*) AS n, string_agg(substr(subject, 10), ',' ORDER BY subject) AS topics FROM v_node GROUP BY document_id) ON document_id = d.doc_id
WHERE length(body) >= 40"""),
)
def export_corpus(spark, d):
    bodies = P.reconstruct_body(PD.typed_blocks(spark, d))
    triples = I.v_decision_triple(spark, d)
    out = DS.export_corpus(
        bodies, I.v_doc(spark, d).select("doc_id", "title"), TR.derive_extract(triples, PG.ROLES), TR.derive_tacit(triples, PG.ROLES)
    )
    return out.select(
        "doc_id", "title", "input", F.size("decisions").cast("long").alias("n_decisions"),
        F.array_join(F.array_sort(F.transform("decisions", lambda x: x["topic"])), ",").alias("topics"),
    )
