"""Triples, graph measures, event times, embeddings, graph retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.functions import eventtime as T
from loomgraph.functions import normalize as N
from loomgraph.operators import graph as GR
from loomgraph.operators import modelio as MI
from loomgraph.operators import retrieval as R
from loomgraph.operators import transe as TE
from loomgraph.operators import triples as TR
from loomgraph.plans import inputs as I
from loomgraph.plans import search
from loomgraph.plans.oracle_views import oracle
from loomgraph.plans.registry import Plans
from loomgraph.session import fresh_path, materialize
from loomgraph.sources.tables import read_table, read_spread
from loomgraph.sources.versioned import VersionedTable

PLANS = Plans()
ROLES = TR.Roles(
    prefix="decision:", owner="owner", topic="topic", value="value", rationale="rationale", condition="condition",
    rejected="rejected", default_owner="team",
)
COMMIT = {"confirmed": 1.0, "conditional": 0.9, "intended": 0.7, "proposed": 0.45, "needed": 0.4, "none": 0.2}
GRADES = {"confirmed": "firm", "conditional": "conditional", "intended": "planned", "proposed": "open", "needed": "open", "none": "open"}

ENDINGS = "|".join(N.SENTENCE_ENDINGS)


def sql_entity(x: str) -> str:
    """Normalisation of one text as nested DuckDB expressions."""
    value = rf"regexp_replace(regexp_replace({x}, '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g')"
    bare = rf"regexp_replace({value}, '(\s*[.。])+$', '')"
    keep = ", ".join(f"'{w}'" for w in N.NOT_HONORIFIC)
    plain = f"CASE WHEN {bare} LIKE '%님' AND length({bare}) >= 3 AND {bare} NOT IN ({keep}) THEN left({bare}, -1) ELSE {bare} END"
    name = f"regexp_replace({plain}, '{N.NICKNAME}', '\\1')"
    alias = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in N.ALIASES.items())
    out = f"CASE lower({name}) {alias} ELSE {name} END"
    return (f"CASE WHEN {x} IS NULL OR {value} = '' OR regexp_matches({value}, '({ENDINGS})[.!?]?\\s*$') OR trim({out}) = '' "
            f"OR length({out}) > 40 THEN NULL ELSE {out} END")


def sql_predicate(x: str) -> str:
    value = rf"regexp_replace(regexp_replace({x}, '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g')"
    cases = " ".join(f"WHEN regexp_matches({value}, '{'|'.join(n)}') THEN '{c}'" for c, n in N.PREDICATES.items())
    return f"CASE WHEN {value} = '' OR length({value}) > 30 THEN NULL ELSE CASE {cases} ELSE {value} END END"


# the same texts for both engines; only string concatenation and arithmetic
RAW_ENTITY = (
    "CASE {k} % 9 WHEN 0 THEN '  ' || p_name || '   .' WHEN 1 THEN p_name || ' 합니다.' WHEN 2 THEN p_name || '님' "
    "WHEN 3 THEN p_name || p_name || p_name || p_name || p_name WHEN 4 THEN '김철수(momo)' WHEN 5 THEN '우리  팀' "
    "WHEN 6 THEN p_name || ', ' || p_brand WHEN 7 THEN p_brand || ' · Inc.' ELSE '선생님' END"
)
RAW_PREDICATE = (
    "CASE {k} % 7 WHEN 0 THEN '합의함' WHEN 1 THEN ' 구성되어   있다 ' WHEN 2 THEN 'uses' WHEN 3 THEN '  needs   it ' WHEN 4 THEN ' ' "
    "WHEN 5 THEN 'a predicate that is far too long to be one' ELSE '요청한다' END"
)

EXTRA = {
    **search.EXTRA,
    "v_raw": f"SELECT p_partkey, {RAW_ENTITY.format(k='p_partkey')} AS raw, {RAW_PREDICATE.format(k='p_partkey')} AS pred, p_brand FROM part",
    "v_split": rf"""
SELECT p_partkey, list_distinct(CASE WHEN listed AND len(many) > 0 THEN many ELSE one END) AS l FROM (
  SELECT p_partkey, regexp_matches(v, '{N.CO_LISTED}') AND NOT regexp_matches(v, '(?i)(^|[,·・])\s*(inc|ltd|llc|co|corp|주식회사|㈜)\.?\s*([,·・]|$)') AS listed,
    list_filter([{sql_entity("trim(string_split_regex(v, '[,·・]')[1])")}, {sql_entity("trim(string_split_regex(v, '[,·・]')[2])")}, {sql_entity("trim(string_split_regex(v, '[,·・]')[3])")}], lambda x: x IS NOT NULL) AS many,
    list_filter([{sql_entity("v")}], lambda x: x IS NOT NULL) AS one
  FROM (SELECT p_partkey, trim(raw) AS v FROM v_raw))""",
    "v_rawtriple": """
SELECT l_orderkey AS document_id, l_linenumber * 10000000 + l_partkey * 1000 + l_suppkey % 1000 AS ordinal, raw AS subject, pred AS predicate, p_brand AS object
FROM lineitem JOIN v_raw ON p_partkey = l_partkey""",
    "v_norm": f"""
SELECT document_id, ordinal, s AS subject, p AS predicate, o AS object FROM (
  SELECT *, row_number() OVER (PARTITION BY document_id, s, p, o ORDER BY ordinal) AS rn FROM (
    SELECT document_id, ordinal, {sql_entity("subject")} AS s, {sql_predicate("predicate")} AS p, {sql_entity("object")} AS o FROM v_rawtriple)
  WHERE s IS NOT NULL AND p IS NOT NULL AND o IS NOT NULL) WHERE rn = 1""",
    # json_valid lets a comma before a closing bracket, NaN and Infinity pass; JSON has none of them
    "v_parsed": r"""
SELECT document_id, response, j, CASE WHEN j IS NULL THEN 'no_json'
  WHEN NOT json_valid(j) OR regexp_matches(regexp_replace(j, '"([^"\\]|\\.)*"', '""', 'g'), ',\s*[\]}]|(?i:nan|inf)') THEN 'invalid_json' ELSE 'ok' END AS outcome
FROM (SELECT *, nullif(regexp_extract(response, '(?s)\{.*\}'), '') AS j FROM v_extract_raw)""",
    "v_ok": "SELECT document_id, CAST(j AS JSON) AS x FROM v_parsed WHERE outcome = 'ok' AND CAST(CAST(j AS JSON) -> '$.worthRecording' AS VARCHAR) = 'true'",
    "v_dec": """
SELECT document_id, i, p ->> '$.topic' AS topic, p ->> '$.decision' AS decision, p ->> '$.outcome' AS outcome, p ->> '$.owner' AS owner,
  p ->> '$.rationale' AS rationale, p ->> '$.condition' AS condition, p -> '$.alternatives' AS alts
FROM (SELECT document_id, unnest(CAST(x -> '$.decisionPoints' AS JSON[])) AS p, generate_subscripts(CAST(x -> '$.decisionPoints' AS JSON[]), 1) - 1 AS i FROM v_ok)""",
    "v_tac": """
SELECT document_id, i, j, kind, statement, t ->> '$.subject' AS s, t ->> '$.predicate' AS p, t ->> '$.object' AS o FROM (
  SELECT document_id, i, kind, statement, unnest(ts) AS t, generate_subscripts(ts, 1) - 1 AS j FROM (
    SELECT document_id, i, k ->> '$.kind' AS kind, k ->> '$.statement' AS statement, CAST(k -> '$.triples' AS JSON[]) AS ts FROM (
      SELECT document_id, unnest(CAST(x -> '$.tacitKnowledge' AS JSON[])) AS k, generate_subscripts(CAST(x -> '$.tacitKnowledge' AS JSON[]), 1) - 1 AS i FROM v_ok)))""",
    "v_reified": f"""
WITH d AS (SELECT *, {sql_entity("topic")} AS tp FROM v_dec),
e AS (
  SELECT document_id, i, decision, rationale, tp, 'owner' AS predicate, unnest(CASE WHEN trim(owner) = '' THEN ['team'] ELSE string_split(owner, ', ') END) AS object FROM d
  UNION ALL SELECT document_id, i, decision, rationale, tp, 'topic', tp FROM d
  UNION ALL SELECT document_id, i, decision, rationale, tp, 'value', trim(outcome) FROM d WHERE trim(outcome) <> ''
  UNION ALL SELECT document_id, i, decision, rationale, tp, 'rationale', trim(rationale) FROM d WHERE trim(rationale) <> ''
  UNION ALL SELECT document_id, i, decision, rationale, tp, 'condition', trim(condition) FROM d WHERE trim(condition) <> ''
  UNION ALL SELECT document_id, i, decision, rationale, tp, 'rejected', unnest(CAST(alts AS VARCHAR[])) FROM d)
SELECT document_id, 'decision' AS kind, decision || CASE WHEN trim(rationale) <> '' THEN ' — ' || rationale ELSE '' END AS statement,
  'decision:' || tp AS subject, predicate, object FROM e WHERE tp IS NOT NULL""",
    "v_tacit": f"""
SELECT * FROM (SELECT document_id, i, j, kind, statement, {sql_entity("s")} AS subject, {sql_predicate("p")} AS predicate, {sql_entity("o")} AS object FROM v_tac)
WHERE subject IS NOT NULL AND predicate IS NOT NULL AND object IS NOT NULL""",
    "v_ends": "SELECT subject AS entity, document_id, triple_id FROM v_triple UNION ALL SELECT object, document_id, triple_id FROM v_triple",
    "v_ent": "SELECT entity, count(*) AS degree, min(document_id) = max(document_id) AS isolated, min(document_id % 2) <> max(document_id % 2) AS shared FROM v_ends GROUP BY entity",
    "v_ask": "SELECT CAST(n_nationkey AS BIGINT) AS qid, n_name || ' ' || r_name AS q FROM nation JOIN region ON n_regionkey = r_regionkey",
    "v_qt": r"SELECT qid, term, count(*) AS qtf FROM (SELECT qid, unnest(regexp_extract_all(lower(q), '[\p{L}\p{Nd}]+')) AS term FROM v_ask) GROUP BY qid, term",
    "v_tp": """
SELECT triple_id, any_value(event_at) AS event_at, any_value(len) AS len, term, count(*) AS tf FROM v_ctok
WHERE term IN (SELECT term FROM v_qt) GROUP BY triple_id, term""",
    "v_thit": r"""
SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, event_at DESC, triple_id) AS rank FROM (
    SELECT qid, triple_id, any_value(event_at) AS event_at, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2
      / (tf + 1.2 * (0.25 + 0.75 * len / avgdl))), 6) AS score
    FROM v_qt JOIN (SELECT term, count(*) AS df FROM v_tp GROUP BY term) USING (term) JOIN v_tp USING (term),
      (SELECT count(*) AS n, (SELECT count(*) FROM v_ctok) / count(*) AS avgdl FROM v_triple)
    GROUP BY qid, triple_id) WHERE score > 0) WHERE rank <= 10""",
    "v_relvec": """
SELECT relation, list(v ORDER BY i) AS rv FROM (
  SELECT relation, i, avg(CAST(x AS DOUBLE)) AS v FROM (SELECT relation, unnest(vec) AS x, generate_subscripts(vec, 1) AS i FROM v_kg_vec) GROUP BY relation, i)
GROUP BY relation""",
    "v_edge": "SELECT entity AS subject, relation, (entity * 7 + 1) % (SELECT count(*) FROM embeddings) AS object FROM v_kg_vec",
    "v_qv": """
SELECT s.entity AS subject, r.relation, (SELECT list(a + b ORDER BY i) FROM (SELECT unnest(CAST(s.vec AS DOUBLE[])) AS a, unnest(r.rv) AS b, generate_subscripts(r.rv, 1) AS i)) AS qv
FROM v_kg_vec s, v_relvec r""",
}


def sql(text: str) -> str:
    return oracle(text, EXTRA)


def spark_text(template: str, key: str) -> str:
    return template.format(k=key)


def raw(spark, d):
    return read_table(spark, d, "part").selectExpr(
        "p_partkey", f"{RAW_ENTITY.format(k='p_partkey')} AS raw", f"{RAW_PREDICATE.format(k='p_partkey')} AS pred", "p_brand"
    )


def raw_triples(spark, d):
    line = read_spread(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    parts = raw(spark, d)
    return line.join(parts, line.l_partkey == parts.p_partkey).selectExpr(
        "l_orderkey AS document_id", "l_linenumber * 10000000 + l_partkey * 1000 + l_suppkey % 1000 AS ordinal",
        "raw AS subject", "pred AS predicate", "p_brand AS object",
    )


def extracts(spark, d):
    return MI.recorded(MI.parse_extracts(I.v_extract_raw(spark, d)))


# ---- normalisers

@PLANS.add("normalize_entity", sql(f"SELECT p_partkey, raw, {sql_entity('raw')} AS entity FROM v_raw"))
def normalize_entity(spark, d):
    return raw(spark, d).select("p_partkey", "raw", N.normalize_entity(F.col("raw")).alias("entity"))


@PLANS.add("split_colisted", sql("SELECT p_partkey, unnest(l) AS entity FROM v_split"))
def split_colisted(spark, d):
    return raw(spark, d).select("p_partkey", F.explode(N.split_colisted(F.col("raw"))).alias("entity"))


@PLANS.add("canonical_predicate", sql(f"SELECT p_partkey, pred, {sql_predicate('pred')} AS canonical FROM v_raw"))
def canonical_predicate(spark, d):
    return raw(spark, d).select("p_partkey", "pred", N.canonical_predicate(F.col("pred")).alias("canonical"))


@PLANS.add("entity_phrase_share", sql(f"SELECT count(*) AS entities, round(avg(CASE WHEN {sql_entity('raw')} IS NOT NULL THEN 1.0 ELSE 0 END), 6) AS accepted FROM v_raw"))
def entity_phrase_share(spark, d):
    return raw(spark, d).agg(
        F.count(F.lit(1)).alias("entities"),
        F.round(F.avg(N.normalize_entity(F.col("raw")).isNotNull().cast("double")), 6).alias("accepted"),
    )


# ---- triples

@PLANS.add("reify_decisions", sql("SELECT * FROM v_reified"))
def reify_decisions(spark, d):
    return TR.reify_decisions(extracts(spark, d), ROLES).drop("ordinal")


@PLANS.add("tacit_triples", sql("SELECT document_id, kind, statement, subject, predicate, object FROM v_tacit"))
def tacit_triples(spark, d):
    return TR.tacit_triples(extracts(spark, d)).drop("ordinal")


@PLANS.add(
    "dedup_in_doc",
    sql("SELECT document_id, min(ordinal) AS ordinal, subject, predicate, object FROM v_rawtriple GROUP BY ALL"),
)
def dedup_in_doc(spark, d):
    return TR.dedup_in_doc(raw_triples(spark, d))


@PLANS.add(
    "replace_doc_triples",
    sql("""
SELECT document_id, subject, predicate, object FROM v_decision_triple WHERE NOT (document_id % 3 = 0 AND document_id % 5 = 0)
UNION ALL SELECT document_id, subject, 'again', object FROM v_decision_triple WHERE document_id % 3 = 0 AND document_id % 5 = 0"""),
)
def replace_doc_triples(spark, d):
    stored = I.v_decision_triple(spark, d).select("document_id", "subject", "predicate", "object")
    fresh = stored.where("document_id % 3 = 0").withColumn("predicate", F.lit("again"))
    drafts = read_table(spark, d, "customer").where("c_custkey % 5 = 0").selectExpr("c_custkey AS document_id")
    return TR.replace_doc_triples(stored, fresh, drafts)


@PLANS.add(
    "stored_doc_triples",
    sql("""
SELECT document_id, subject, predicate, object FROM v_decision_triple WHERE document_id % 3 <> 0
UNION ALL SELECT document_id, subject, 'again', object FROM v_decision_triple WHERE document_id % 3 = 0 AND document_id % 5 <> 0"""),
)
def stored_doc_triples(spark, d):
    """A triple table on disk after one atomic write: re-extracted documents replaced, deleted ones gone."""
    table = VersionedTable(spark, fresh_path(spark, "doc-triples"), ["document_id"])
    stored = I.v_decision_triple(spark, d).select("document_id", "subject", "predicate", "object")
    table.replace(stored)
    fresh = stored.where("document_id % 3 = 0 AND document_id % 5 <> 0").withColumn("predicate", F.lit("again"))
    table.replace(fresh, gone=stored.where("document_id % 15 = 0"))
    return table.read()


@PLANS.add("renormalize_graph", sql("SELECT * FROM v_norm"))
def renormalize_graph(spark, d):
    return TR.renormalize_graph(raw_triples(spark, d))


@PLANS.add(
    "renormalize_report",
    sql('SELECT b.n AS "before", a.n AS "after", b.n - a.n AS dropped FROM (SELECT count(*) AS n FROM v_rawtriple) b, (SELECT count(*) AS n FROM v_norm) a'),
)
def renormalize_report(spark, d):
    before = raw_triples(spark, d)
    return TR.renormalize_report(before, TR.renormalize_graph(before))


@PLANS.add(
    "derive_extract",
    sql("""
SELECT document_id, subject, string_split(arg_min(statement, ordinal), ' — ')[1] AS decision,
  coalesce(arg_max(object, ordinal) FILTER (WHERE predicate = 'topic'), '') AS topic,
  coalesce(string_agg(object, ', ' ORDER BY ordinal) FILTER (WHERE predicate = 'value'), '') AS outcome,
  coalesce(string_agg(object, ', ' ORDER BY ordinal) FILTER (WHERE predicate = 'owner'), '') AS owner,
  coalesce(arg_max(object, ordinal) FILTER (WHERE predicate = 'rationale'), '') AS rationale, '' AS condition, '' AS alternatives
FROM v_decision_triple GROUP BY document_id, subject"""),
)
def derive_extract(spark, d):
    return TR.derive_extract(I.v_decision_triple(spark, d), ROLES)


@PLANS.add(
    "derive_tacit",
    sql("SELECT document_id, statement, arg_max(kind, triple_id) AS kind, count(*) AS n_triples FROM v_triple GROUP BY document_id, statement"),
)
def derive_tacit(spark, d):
    return TR.derive_tacit(I.v_triple(spark, d).withColumn("ordinal", F.col("triple_id")), ROLES)


WEIGHT = (
    "round((CASE commitment WHEN 'confirmed' THEN 1.0 WHEN 'conditional' THEN 0.9 WHEN 'intended' THEN 0.7 WHEN 'proposed' THEN 0.45 "
    "WHEN 'needed' THEN 0.4 ELSE 0.2 END) * (CASE salience WHEN 'core' THEN 1.0 WHEN 'supporting' THEN 0.75 ELSE 0.5 END)::DOUBLE, 6)"
)
EXTRA["v_weighted"] = f"SELECT t.*, CASE WHEN commitment IS NOT NULL THEN {WEIGHT} END AS weight FROM v_decision_triple t LEFT JOIN v_judgment j USING (document_id, subject)"


def weighted(spark, d):
    return TR.node_weights(I.v_decision_triple(spark, d), I.v_judgment(spark, d), COMMIT)


@PLANS.add("node_weights", sql("SELECT triple_id, weight FROM v_weighted"))
def node_weights(spark, d):
    return weighted(spark, d).select("triple_id", "weight")


@PLANS.add("weight_coverage", sql("SELECT count(weight) AS matched, count(*) - count(weight) AS unmatched FROM v_weighted"))
def weight_coverage(spark, d):
    return TR.weight_coverage(weighted(spark, d))


GRADE_SQL = """
SELECT triple_id, '[' || coalesce(CASE commitment WHEN 'confirmed' THEN 'firm' WHEN 'conditional' THEN 'conditional' WHEN 'intended' THEN 'planned'
  ELSE CASE WHEN commitment IS NOT NULL THEN 'open' END END, 'unclassified') || ']' || CASE WHEN conditional THEN ' (조건: budget)' ELSE '' END AS grade
FROM v_decision_triple LEFT JOIN v_judgment USING (document_id, subject)"""
EXTRA["v_graded"] = GRADE_SQL


def graded(spark, d):
    judged = I.v_judgment(spark, d).withColumn("condition", F.when(F.col("conditional"), F.lit(" budget ")))
    return TR.grade_labels(I.v_decision_triple(spark, d), judged, GRADES, "unclassified")


@PLANS.add("grade_labels", sql("SELECT triple_id, grade FROM v_graded"))
def grade_labels(spark, d):
    return graded(spark, d).select("triple_id", "grade")


@PLANS.add("grade_distribution", sql("SELECT grade, count(*) AS n FROM v_graded GROUP BY grade"))
def grade_distribution(spark, d):
    return graded(spark, d).groupBy("grade").agg(F.count(F.lit(1)).alias("n"))


# ---- event times

@PLANS.add(
    "event_time_title",
    sql(r"""SELECT doc_id, title, try_strptime(nullif(regexp_extract(title, '^(20\d{6})', 1), ''), '%Y%m%d') - INTERVAL 9 HOUR AS event_at FROM v_doc"""),
)
def event_time_title(spark, d):
    return I.v_doc(spark, d).select("doc_id", "title", T.event_time_title(F.col("title")).alias("event_at"))


@PLANS.add(
    "event_time_epoch",
    sql("""
SELECT conv_id, turn, delivery, CASE WHEN turn % 5 <> 4 AND turn % 5 <> 3
  THEN TIMESTAMP '1970-01-01 00:00:00' + to_milliseconds(CAST(floor((1704067200 + conv_id * 3600 + turn * 60 + turn / 1000000.0) * 1000) AS BIGINT)) END AS event_at FROM v_msg"""),
)
def event_time_epoch(spark, d):
    ts = F.expr("CASE turn % 5 WHEN 4 THEN '12.5' WHEN 3 THEN concat(ts, 'x') ELSE ts END")
    return I.v_msg(spark, d).select("conv_id", "turn", "delivery", T.event_time_epoch(ts).alias("event_at"))


@PLANS.add(
    "event_time_iso",
    """
SELECT event_id, CASE event_id % 6 WHEN 0 THEN date_trunc('second', ts) WHEN 1 THEN date_trunc('second', ts) - INTERVAL 9 HOUR
  WHEN 2 THEN date_trunc('second', ts) - INTERVAL 9 HOUR WHEN 3 THEN date_trunc('day', ts) - INTERVAL 9 HOUR
  WHEN 4 THEN date_trunc('second', ts) - INTERVAL 150 MINUTE END AS event_at FROM events""",
)
def event_time_iso(spark, d):
    text = F.expr(
        "CASE event_id % 6 WHEN 0 THEN concat(date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\"), 'Z') "
        "WHEN 1 THEN date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\") WHEN 2 THEN date_format(ts, 'yyyy-MM-dd HH:mm:ss') "
        "WHEN 3 THEN concat(' ', date_format(ts, 'yyyy-MM-dd')) "
        "WHEN 4 THEN concat(date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\"), '+02:30') ELSE concat('2024-13-', event_id) END"
    )
    return read_table(spark, d, "events").select("event_id", T.event_time_iso(text).alias("event_at"))


@PLANS.add(
    "backfill_event_time",
    sql(r"""
WITH t AS (SELECT conv_id || '/' || turn AS triple_id, conv_id AS document_id,
    CASE conv_id % 3 WHEN 0 THEN 'drive' WHEN 1 THEN 'tiro' ELSE channel_id END AS channel_id, coalesce(thread_ts, ts) AS th FROM v_msg WHERE delivery = 1),
d AS (SELECT doc_id, try_strptime(nullif(regexp_extract(title, '^(20\d{6})', 1), ''), '%Y%m%d') - INTERVAL 9 HOUR AS t0 FROM v_doc),
e AS (SELECT t.*, d.t0, CASE WHEN channel_id = 'drive' THEN d.t0 WHEN channel_id = 'tiro' THEN NULL
    ELSE TIMESTAMP '1970-01-01' + to_seconds(CAST(split_part(th, '.', 1) AS BIGINT)) END AS event_at FROM t LEFT JOIN d ON doc_id = document_id)
SELECT triple_id, document_id, channel_id, event_at, coalesce(t0, min(event_at) OVER (PARTITION BY document_id)) AS doc_event_at FROM e"""),
)
def backfill_event_time(spark, d):
    docs = I.v_doc(spark, d).select("doc_id", T.event_time_title(F.col("title")).alias("event_at"))
    triples = I.v_msg(spark, d).where("delivery = 1").selectExpr(
        "concat(conv_id, '/', turn) AS triple_id", "conv_id AS document_id",
        "CASE conv_id % 3 WHEN 0 THEN 'drive' WHEN 1 THEN 'tiro' ELSE channel_id END AS channel_id",
        "coalesce(thread_ts, ts) AS thread_ts",
    )
    return TR.backfill_event_time(docs, triples)


# ---- graph measures

@PLANS.add("graph_edges", sql("SELECT subject AS source, object AS target, predicate, kind, document_id, statement, event_at FROM v_triple"))
def graph_edges(spark, d):
    return GR.graph_edges(I.v_triple(spark, d))


@PLANS.add("graph_nodes", sql("SELECT entity AS id, degree FROM v_ent"))
def graph_nodes(spark, d):
    return GR.graph_nodes(I.v_triple(spark, d))


@PLANS.add("graph_period", sql("SELECT min(event_at) AS first_at, max(event_at) AS last_at, round(count(event_at) / count(*), 6) AS dated_share, count(DISTINCT kind) AS kinds FROM v_triple"))
def graph_period(spark, d):
    return GR.graph_period(I.v_triple(spark, d))


@PLANS.add("entity_isolation", sql("SELECT count(*) AS entities, count(*) FILTER (WHERE isolated) AS isolated, round(count(*) FILTER (WHERE isolated) / count(*), 6) AS isolated_share, count(*) FILTER (WHERE shared) AS in_two_sources FROM v_ent"))
def entity_isolation(spark, d):
    return GR.entity_isolation(I.v_triple(spark, d), F.col("document_id") % 2)


@PLANS.add("hub_entities", sql("SELECT count(*) FILTER (WHERE degree >= 20) AS hubs, count(*) FILTER (WHERE degree >= 20 AND isolated) AS isolated_hubs, round(count(*) FILTER (WHERE isolated) / count(*), 6) AS isolated_share FROM v_ent"))
def hub_entities(spark, d):
    return GR.hub_entities(I.v_triple(spark, d), F.col("document_id") % 2, 20)


@PLANS.add(
    "predicate_singletons",
    sql("""
SELECT count(*) AS predicates, count(*) FILTER (WHERE n = 1) AS singletons, round(count(*) FILTER (WHERE n = 1) / count(*), 6) AS singleton_share,
  round(sum(CASE WHEN predicate IN ('placed_by', 'part_of') THEN n ELSE 0 END) / sum(n), 6) AS canonical_share
FROM (SELECT predicate, count(*) AS n FROM (SELECT predicate FROM v_triple UNION ALL SELECT 'p ' || o_orderkey FROM orders) GROUP BY predicate)"""),
)
def predicate_singletons(spark, d):
    own = read_table(spark, d, "orders").selectExpr("concat('p ', o_orderkey) AS predicate")
    return GR.predicate_singletons(I.v_triple(spark, d).select("predicate").unionByName(own), ["placed_by", "part_of"])


@PLANS.add("predicate_entropy", sql("SELECT round(sum(-(n / t) * ln(n / t)), 6) AS entropy, count(*) AS predicates FROM (SELECT predicate, count(*) AS n, (SELECT count(*) FROM v_triple) AS t FROM v_triple GROUP BY predicate)"))
def predicate_entropy(spark, d):
    return GR.predicate_entropy(I.v_triple(spark, d))


@PLANS.add(
    "decision_completeness",
    sql("""
SELECT count(*) AS nodes, round(avg(v), 6) AS avg_value, round(avg(r), 6) AS avg_rationale, round(avg(c), 6) AS avg_condition, round(avg(x), 6) AS avg_rejected FROM (
  SELECT document_id, subject, count(*) FILTER (WHERE predicate = 'value') AS v, count(*) FILTER (WHERE predicate = 'rationale') AS r,
    count(*) FILTER (WHERE predicate = 'condition') AS c, count(*) FILTER (WHERE predicate = 'rejected') AS x FROM v_reified GROUP BY document_id, subject)"""),
)
def decision_completeness(spark, d):
    return GR.decision_completeness(TR.reify_decisions(extracts(spark, d), ROLES), ROLES)


@PLANS.add(
    "kg_vocab",
    sql("""
SELECT kind, name, row_number() OVER (PARTITION BY kind ORDER BY md5(name), name) AS id FROM (
  SELECT 'entity' AS kind, entity AS name FROM v_ends UNION SELECT 'relation', predicate FROM v_triple)"""),
)
def kg_vocab(spark, d):
    return GR.kg_vocab(I.v_triple(spark, d))


# ---- embeddings

@PLANS.add(
    "transe_split",
    sql("""
SELECT subject, predicate, object, pos <= nt AS test, pos > nt OR nt >= n AS train FROM (
  SELECT *, row_number() OVER (ORDER BY md5('42' || k), k) AS pos, count(*) OVER () AS n, greatest(1, floor(count(*) OVER () * 0.1 + 0.5)) AS nt
  FROM (SELECT subject, predicate, object, subject || '|' || predicate || '|' || object AS k FROM v_triple))"""),
)
def transe_split(spark, d):
    return TE.transe_split(I.v_triple(spark, d), 0.1, "42")


def relation_vectors(spark, d):
    parts = I.v_kg_vec(spark, d).select("relation", F.posexplode("vec").alias("i", "x"))
    means = parts.groupBy("relation", "i").agg(F.avg(F.col("x").cast("double")).alias("v"))
    rows = F.array_sort(F.collect_list(F.struct("i", "v")))
    return means.groupBy("relation").agg(F.transform(rows, lambda s: s["v"]).alias("vec"))


def kg_edges(spark, d):
    n = read_table(spark, d, "embeddings").agg(F.count(F.lit(1)).alias("n")).select("n").scalar()
    return I.v_kg_vec(spark, d).select("entity", "relation", ((F.col("entity") * 7 + 1) % n).alias("object"))


@PLANS.add(
    "hits_at_10",
    sql("""
SELECT subject AS edge_id, 1 + count(*) FILTER (WHERE dist < lim) AS rank, count(*) FILTER (WHERE dist < lim) < 10 AS hit FROM (
  SELECT q.subject, round(list_distance(qv, CAST(t.vec AS DOUBLE[])), 6) AS lim, round(list_distance(qv, CAST(e.vec AS DOUBLE[])), 6) AS dist
  FROM v_edge g JOIN v_qv q ON q.subject = g.subject AND q.relation = g.relation JOIN v_kg_vec t ON t.entity = g.object, v_kg_vec e)
GROUP BY subject"""),
)
def hits_at_10(spark, d):
    test = kg_edges(spark, d).selectExpr("entity AS edge_id", "entity AS head", "relation", "object AS tail")
    return TE.hits_at_10(test, I.v_kg_vec(spark, d).select("entity", "vec"), relation_vectors(spark, d))


@PLANS.add(
    "link_predict",
    sql("""
SELECT subject, relation, object, rank, floor(dist * 1e4 + 0.5) / 1e4 AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY subject ORDER BY dist, relation, object) AS rank FROM (
    SELECT subject, q.relation AS relation, e.entity AS object, round(list_distance(qv, CAST(e.vec AS DOUBLE[])), 6) AS dist
    FROM v_qv q, v_kg_vec e WHERE subject IN (SELECT item_id FROM benchmark) AND e.entity <> subject
      AND (subject, q.relation, e.entity) NOT IN (SELECT (subject, relation, object) FROM v_edge)))
WHERE rank <= 10"""),
)
def link_predict(spark, d):
    subjects = read_table(spark, d, "benchmark").selectExpr("item_id AS subject")
    known = kg_edges(spark, d).withColumnRenamed("entity", "subject")
    return TE.link_predict(subjects, I.v_kg_vec(spark, d).select("entity", "vec"), relation_vectors(spark, d), known)


@PLANS.add("transe_train")
def transe_train(spark, d):
    _, _, curve = TE.transe_train(I.v_triple(spark, d).select("subject", "predicate", "object"))
    return spark.createDataFrame(curve, "epoch int, train_loss double, hits10 double")


# ---- graph retrieval

def corpus(spark, d):
    # the stored triple table: written once, then read by column for each step of a query
    return materialize(I.v_triple(spark, d).withColumn("corpus", F.expr(search.CORPUS)), "triples")


def ask(spark, d):
    n, r = read_table(spark, d, "nation"), read_table(spark, d, "region")
    return n.join(r, n.n_regionkey == r.r_regionkey).selectExpr("cast(n_nationkey AS bigint) AS qid", "concat(n_name, ' ', r_name) AS q")


@PLANS.add("triple_search", sql("SELECT qid, triple_id, score, rank FROM v_thit"))
def triple_search(spark, d):
    return R.bm25_search(corpus(spark, d), "triple_id", "corpus", ask(spark, d), "qid", "q", 10, newest="event_at").select(
        "qid", "triple_id", "score", "rank"
    )


def ranked_edges_of(spark, d):
    # a few rows per query; written out, their size is known, so the triples are not shuffled to meet them
    return GR.ranked_edges(materialize(triple_search(spark, d), "top-triples"), I.v_triple(spark, d))


@PLANS.add(
    "ranked_edges",
    sql("SELECT qid, rank, subject AS source, object AS target, predicate, kind, document_id, statement, t.event_at FROM v_thit JOIN v_triple t USING (triple_id)"),
)
def ranked_edges(spark, d):
    return ranked_edges_of(spark, d)


@PLANS.add(
    "ranked_nodes",
    sql("SELECT qid, id, count(*) AS degree FROM (SELECT qid, unnest([subject, object]) AS id FROM v_thit JOIN v_triple USING (triple_id)) GROUP BY ALL"),
)
def ranked_nodes(spark, d):
    return GR.ranked_nodes(ranked_edges_of(spark, d))


@PLANS.add(
    "expand_one_hop",
    sql("""
WITH s AS (SELECT * FROM v_thit WHERE rank <= 6),
ents AS (SELECT DISTINCT qid, unnest([subject, object]) AS entity FROM s JOIN v_triple USING (triple_id)),
nb AS (SELECT DISTINCT e.qid, t.triple_id, t.event_at FROM v_triple t JOIN ents e ON e.entity = t.subject
  UNION SELECT DISTINCT e.qid, t.triple_id, t.event_at FROM v_triple t JOIN ents e ON e.entity = t.object),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY event_at DESC, triple_id) AS pos FROM nb
  WHERE (qid, triple_id) NOT IN (SELECT (qid, triple_id) FROM s))
SELECT qid, triple_id, score, rank FROM s
UNION ALL SELECT r.qid, triple_id, 0.0::DOUBLE, pos + k FROM r JOIN (SELECT qid, count(*) AS k FROM s GROUP BY qid) USING (qid) WHERE pos + k <= 20"""),
)
def expand_one_hop(spark, d):
    return R.expand_one_hop(corpus(spark, d), ask(spark, d), "qid", "q")


@PLANS.add(
    "ranked_facts",
    sql("""
SELECT qid, string_agg(rank || '. [' || kind || '] ' || subject || ' — ' || predicate || ' — ' || object || '  (' || statement || ')', chr(10) ORDER BY rank) AS facts,
  count(*) AS n_facts FROM v_thit JOIN v_triple USING (triple_id) GROUP BY qid"""),
)
def ranked_facts(spark, d):
    triples = corpus(spark, d)
    top = R.bm25_search(triples, "triple_id", "corpus", ask(spark, d), "qid", "q", 10, newest="event_at").select("qid", "triple_id", "rank")
    # a few rows per query; written out, their size is known, so the triples are not shuffled to meet them
    rows = materialize(top, "top-triples").join(triples.select("triple_id", "kind", "subject", "predicate", "object", "statement"), "triple_id")
    line = F.expr("concat('[', kind, '] ', subject, ' — ', predicate, ' — ', object, '  (', statement, ')')")
    return R.render_facts(rows, "qid", line)


DOC_WEIGHT = "CASE WHEN quality IS NULL THEN NULL WHEN quality = 1 THEN 1.0 * 0.75 ELSE 0.45 * 0.5 END"


def weighted_hits(spark, d):
    hits = search.bm25_search(spark, d)
    weights = read_table(spark, d, "labels").selectExpr("doc_id", f"cast({DOC_WEIGHT} AS double) AS weight")
    times = I.v_doc(spark, d).select("doc_id", "verified_at")
    return hits.join(weights, "doc_id", "left").join(times, "doc_id")


@PLANS.add(
    "weighted_rank",
    sql(f"""
SELECT qid, doc_id, score, floor(score * (0.4::DOUBLE + 0.6::DOUBLE * w) * 1e6 + 0.5) / 1e6 AS score_weight,
  floor(score * (0.4::DOUBLE + 0.6::DOUBLE * w) * (0.5::DOUBLE + 0.5::DOUBLE * r) * 1e6 + 0.5) / 1e6 AS score_recency FROM (
  SELECT h.*, coalesce(CAST({DOC_WEIGHT} AS DOUBLE), 0.7::DOUBLE) AS w,
    CASE WHEN verified_at IS NULL THEN 0.8::DOUBLE ELSE exp(-greatest(date_diff('day', verified_at, TIMESTAMP '2024-06-01'), 0) / 180.0::DOUBLE) END AS r
  FROM v_hit h LEFT JOIN labels USING (doc_id) JOIN v_doc USING (doc_id) WHERE rank <= 10)"""),
)
def weighted_rank(spark, d):
    rows = R.weighted_rank(weighted_hits(spark, d), F.col("weight"), F.col("verified_at"), F.expr(I.NOW))
    return rows.select("qid", "doc_id", "score", "score_weight", "score_recency")


@PLANS.add(
    "additive_rank",
    sql(f"SELECT qid, doc_id, round(score + 0.1 * coalesce(CAST({DOC_WEIGHT} AS DOUBLE), 0.7::DOUBLE), 6) AS score_added FROM v_hit LEFT JOIN labels USING (doc_id) WHERE rank <= 10"),
)
def additive_rank(spark, d):
    return R.additive_rank(weighted_hits(spark, d), F.col("weight")).select("qid", "doc_id", "score_added")
