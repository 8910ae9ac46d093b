"""Null keys, several claims per document, real decision verbs, ids and ordinals beyond three digits."""

import math

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import text as X
from loomgraph.operators import datasets as DS
from loomgraph.operators import evaluation as E
from loomgraph.operators import lifecycle as L
from loomgraph.operators import passages as P
from loomgraph.operators import scale as S
from loomgraph.operators import triples as TR
from loomgraph.operators import transe as TE


@pytest.fixture(scope="module")
def keyed(spark):
    rows = [(k, n, n % 3) for k in ("a", None) for n in range(8)]
    return spark.createDataFrame(rows, "k string, n int, v int")


def test_row_numbers_keep_null_keys(keyed):
    got = S.bucketed_row_number(keyed, F.floor(F.col("n") / 3), ["n"], "rn", ["k"]).collect()
    assert sorted((r.k or "", r.n, r.rn) for r in got) == sorted((k, n, n + 1) for k in ("a", "") for n in range(8))


def test_prefix_scan_keeps_null_keys(keyed):
    got = S.prefix_scan(keyed, ["k"], ["n"], F.floor(F.col("n") / 3), sums={"s": F.col("v")}, lags={"p": F.col("v")}).collect()
    want = [(k, n, sum(i % 3 for i in range(n + 1)), (n - 1) % 3 if n else None) for k in ("a", "") for n in range(8)]
    assert sorted((r.k or "", r.n, r.s, r.p if r.p is not None else -1) for r in got) == sorted((*w[:3], -1 if w[3] is None else w[3]) for w in want)


def test_break_groups_keeps_null_keys(keyed):
    got = S.break_groups(keyed, ["k"], ["n"], F.floor(F.col("n") / 4), ["v"], lambda p, c: c["v"] == 0, "g").collect()
    assert len(got) == 16 and {r.g for r in got if r.k is None} == {r.g for r in got if r.k == "a"}


def test_null_times_and_strata_stay(spark):
    docs = spark.createDataFrame([(1, None), (2, 10), (3, 20)], "doc_id long, at long")
    placed = docs.withColumn("at", F.timestamp_seconds("at"))
    assert S.bucketed_row_number(placed, F.to_date("at"), ["at", "doc_id"], "rn").count() == 3


def test_claims_of_one_document_are_judged_apart(spark):
    docs = spark.createDataFrame([(1, "alpha beta gamma delta. Second sentence has other words here.")], "doc_id long, text string")
    claims = spark.createDataFrame(
        [(1, 1, "s1", "alpha beta gamma delta"), (1, 2, "s1", "nothing common whatsoever now"), (1, 3, "s2", "alpha unknown unknown2 unknown3")],
        "doc_id long, claim_id long, system string, claim string",
    )
    overlap = E.token_overlap(claims, docs, X.LATIN_CORE_MARKERS, X.LATIN_EXTENDED_MARKERS)
    assert {(r.claim_id, r.overlap) for r in overlap.collect() if r.ordinal == 1} == {(1, 1.0), (3, 0.25)}
    got = {(r.system, r.theta): (r.claims, r.supported) for r in E.claim_grounding(claims, overlap).collect()}
    assert got == {("s1", 0.3): (2, 1), ("s1", 0.5): (2, 1), ("s2", 0.3): (1, 0), ("s2", 0.5): (1, 0)}
    lengths = spark.createDataFrame([(1, 2)], "doc_id long, n_sentences long")
    salience = spark.createDataFrame([(1, 1, "core"), (1, 3, "core")], "doc_id long, claim_id long, salience string")
    bins = E.position_bins(overlap, lengths, salience, ["core"], theta=0.2).collect()
    assert [(r.third, r.core) for r in bins] == [("early", 2)]


@pytest.mark.parametrize(
    "sentence,expected",
    [
        ("We will ship on Monday.", "WILL"),
        ("The team agreed on the second design.", "DECIDE"),
        ("Each service must log its errors.", "MUST"),
        ("They plan to move in May.", "PLAN"),
        ("Das Team wird am Montag liefern.", "WILL"),
        ("Wir müssen den Dienst ersetzen.", "MUST"),
        ("Die Gruppe hat die Frist beschlossen.", "DECIDE"),
        ("L'équipe doit fermer le ticket.", "MUST"),
        ("Elle va publier la note.", "WILL"),
        ("El equipo ha decidido el plan.", "DECIDE"),
        ("Hay que revisar el texto.", "MUST"),
        ("The cat is with the dog and the bird.", None),
        ("Der Hund ist mit der Katze im Haus.", None),
        ("Les chats de la maison et des voisins.", None),
        ("El perro es de la vecina.", None),
        ("Goodwill matters in the willow.", None),
    ],
)
def test_decision_verbs(spark, sentence, expected):
    rules = (X.LATIN_CORE_MARKERS, X.LATIN_EXTENDED_MARKERS)
    assert spark.range(1).select(X.marker(F.lit(sentence), *rules).alias("m")).first().m == expected


def test_sentence_ids_beyond_999(spark):
    text = " ".join(f"Sentence number {k} ends here." for k in range(1005))
    got = [r.sentence_id for r in P.number_sentences(spark.createDataFrame([(1, text)], "id long, text string"), ["id"]).collect()]
    assert len(set(got)) == 1005 and {"S001", "S999", "S1000", "S1005"} <= set(got)


def test_ordinals_do_not_meet(spark):
    places = spark.createDataFrame([(i, j) for i in (0, 1, 1000, 1001) for j in (0, 999, 1000, 1001)], "i int, j int")
    got = places.select(TR.place(0).alias("a"), TR.place(1).alias("b"), "i", "j").collect()
    assert len({r.a for r in got} | {r.b for r in got}) == 32
    assert [(r.i, r.j) for r in sorted(got, key=lambda r: r.a)] == sorted((r.i, r.j) for r in got)
    assert max(r.a for r in got) < min(r.b for r in got)


def test_long_decisions_with_a_common_beginning_stay(spark):
    same = "the same forty characters at the beginning of each, then "
    rows = spark.createDataFrame([(1, 1, "t", same + "one"), (1, 2, "t", same + "two"), (1, 3, "t", same + "one ")], "document_id long, part int, topic string, decision string")
    assert P.merge_decisions(rows, ["part"]).count() == 2
    assert P.merge_decisions(rows, ["part"], chars=40).count() == 1


def test_repeated_triples_count_in_the_split(spark):
    rows = spark.createDataFrame([("a", "b", "c")] * 20, "subject string, predicate string, object string")
    got = TE.transe_split(rows, 0.1)
    assert got.count() == 20 and got.where("test").count() == 2


def test_known_item_rank_of_string_ids(spark):
    scores = spark.createDataFrame([(1, "x", 2.0), (1, "y", 1.0), (1, "a", 1.0)], "qid long, doc_id string, score double")
    gold = spark.createDataFrame([(1, "y")], "qid long, doc_id string")
    assert E.known_item_rank(scores.select("qid").distinct(), scores, gold).first()["rank"] == 3


def test_p_value_follows_erfc(spark):
    z = [0.0, 0.1, 0.598, 1.0, 1.96, 3.0, 6.0, -2.0]
    got = E.two_prop_p(spark.createDataFrame([(x,) for x in z], "z double")).collect()
    for r in got:
        assert r.p_value == pytest.approx(math.erfc(abs(r.z) / math.sqrt(2)), abs=1e-6)
