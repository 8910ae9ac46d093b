"""Extraction queries and their SQL on responses that are cut where JSON nearly ends."""

import duckdb
import pytest

from harness import compare

NAMES = ["parse_extracts", "first_valid_attempt", "extract_yield", "chunk_sft_pairs", "chunk_sft_failures"]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("extracts")
    # response 12 ends in `"summary":["Sum "],}`; response 468 in `"summary":["Sum "]}`, with nothing after the summary
    rows = [(c, t, role, text) for c, text in ((12, "Two words"), (15, "Two words"), (468, "Two words"), (469, "One two three four five six"))
            for t, role in enumerate(("user", "assistant"))]
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    con.execute(f"COPY conversations TO '{folder}/conversations.parquet'")
    return str(folder), con


@pytest.mark.parametrize("name", NAMES)
def test_a_comma_before_a_bracket_is_no_json(spark, tables, name):
    import __spark_entry__ as entry

    folder, con = tables
    ok, message, *_ = compare(spark, con, folder, entry.queries()[name], entry.oracle_sql()[name])
    assert ok, message


def test_outcomes(spark, tables):
    import __spark_entry__ as entry

    rows = entry.queries()["parse_extracts"](spark, tables[0]).collect()
    assert {r.document_id: r.outcome for r in rows} == {12: "invalid_json", 15: "ok", 468: "ok", 469: "ok"}


@pytest.mark.parametrize("name", ["validate_extracts", "schema_valid_rate"])
def test_every_rule_is_in_the_sql(spark, tables, name):
    import __spark_entry__ as entry

    folder, con = tables
    ok, message, *_ = compare(spark, con, folder, entry.queries()[name], entry.oracle_sql()[name])
    assert ok, message


def test_an_extract_without_findings_is_empty(spark, tables):
    import __spark_entry__ as entry

    rows = entry.queries()["validate_extracts"](spark, tables[0]).collect()
    assert {r.document_id: r.failed_rule for r in rows} == {15: None, 468: "empty", 469: "title"}


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Writes (conv_id, turn, role, text) rows as a table of conversations and opens it."""

    def write(rows):
        folder = tmp_path_factory.mktemp("odd")
        con = duckdb.connect()
        con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
        con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
        con.execute(f"COPY conversations TO '{folder}/conversations.parquet'")
        return str(folder), con

    return write


def test_a_run_without_a_usable_document_has_no_rate(spark, odd):
    import __spark_entry__ as entry

    # response 468 is an extract that lists no decisions; responses 11 and 19 hold no JSON
    folder, con = odd([(c, t, role, "Two words") for c in (468, 11, 19) for t, role in enumerate(("user", "assistant"))])
    ok, message, *_ = compare(spark, con, folder, entry.queries()["extract_yield"], entry.oracle_sql()["extract_yield"])
    assert ok, message
    rows = entry.queries()["extract_yield"](spark, folder).collect()
    assert {(r.run, r.decisions, r.decisions_per_document) for r in rows} == {("run0", 0, 0.0), ("run2", 0, None), ("run1", 0, None)}


def test_yield_rounds_a_half_up(spark, odd):
    import __spark_entry__ as entry

    # 41 decisions in 640 documents: 0.0640625
    rows = [(24 * k, 0, "user", "One two three") for k in range(640)] + [(24 * k, 1, "assistant", "One two three") for k in range(41)]
    folder, con = odd(rows)
    ok, message, *_ = compare(spark, con, folder, entry.queries()["extract_yield"], entry.oracle_sql()["extract_yield"])
    assert ok, message
    assert [r.decisions_per_document for r in entry.queries()["extract_yield"](spark, folder).collect()] == [0.064063]


def test_a_conversation_without_an_id_keeps_its_failure(spark, odd):
    import __spark_entry__ as entry

    folder, con = odd([(c, 0, "user", "One two three") for c in (None, 11, 12)])
    ok, message, *_ = compare(spark, con, folder, entry.queries()["first_valid_attempt"], entry.oracle_sql()["first_valid_attempt"])
    assert ok, message
    rows = entry.queries()["first_valid_attempt"](spark, folder).collect()
    assert {tuple(r) for r in rows} == {(None, None, "no_json"), (2, 11, "no_json"), (3, 12, "invalid_json")}


def ids(spark, folder):
    import __spark_entry__ as entry

    return {r.document_id for r in entry.queries()["chunk_sft_pairs"](spark, folder).collect()}


@pytest.mark.parametrize("name", NAMES)
def test_a_turn_without_text_loses_no_conversation(spark, odd, name):
    import __spark_entry__ as entry

    folder, con = odd([(15, 0, "user", None), (15, 1, "assistant", "One two three"), (16, 0, "user", None), (17, 0, "user", "One"), (17, 1, "user", None)])
    ok, message, *_ = compare(spark, con, folder, entry.queries()[name], entry.oracle_sql()[name])
    assert ok, message
    assert ids(spark, folder) == {15, 17}


@pytest.mark.parametrize("name", NAMES)
@pytest.mark.parametrize("turn", [0, None])
def test_equal_turns_come_by_their_words(spark, odd, name, turn):
    import __spark_entry__ as entry

    # cut at 60 characters, response 468 is JSON only if the turn without further words gives the summary
    heads = [(468, "Two words"), (468, "One two three four five six"), (476, "One two three four five six"), (476, "Two words")]
    folder, con = odd([(c, turn, "user", t) for c, t in heads] + [(c, None, "user", "Late") for c in (468, 476)])
    ok, message, *_ = compare(spark, con, folder, entry.queries()[name], entry.oracle_sql()[name])
    assert ok, message
    assert ids(spark, folder) == {468, 476}
