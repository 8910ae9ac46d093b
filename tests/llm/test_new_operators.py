"""Fill-in-the-middle, ranked search and the quality classifier against plain versions."""

import os
import random
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import brute as B  # noqa: E402

from loomgraph.llm import fill_middle, quality_classifier, ranked_search  # noqa: E402
from loomgraph.llm.textarrays import text_bytes  # noqa: E402


@pytest.fixture(scope="module")
def docs(spark):
    return B.table(spark).withColumn("output", F.lit("other")).persist()


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.where("false")


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


# ---- fill-in-the-middle

MARKED = [
    (100, "one <P> two\nthree"),
    (101, "<S>"),
    (102, "a <M"),
    (103, "< P>\n<P\n>S>\n"),
    (104, "\n\n\n"),
    (105, "no line end"),
    (106, "é\n你好\n\U0001f600 x\n" * 3000),
    (107, "<P" * 2000 + "\n" + "S>" * 2000),
    (108, "word " * 200000),
    (109, "passage\n" * 50000 + "<M>" + "passage\n" * 50000),
]


def test_fill_middle(spark, docs, nothing):
    table = docs.select("doc_id", "text").union(spark.createDataFrame(MARKED, "doc_id long, text string"))
    data = [(r[0], r[1]) for r in B.ROWS] + MARKED
    got = fill_middle.rearranged(table)
    assert rows(got, *got.columns) == sorted(((d, *B.rearranged(d, t)) for d, t in data), key=repr)
    digest = fill_middle.rearrangement_digest(got)
    want = sorted(((d, B.sha(B.rearranged(d, t)[4].encode()), B.sha((t or "").encode())) for d, t in data), key=repr)
    assert rows(digest, "doc_id", "output_sha256", "restored_sha256") == want
    assert fill_middle.rearranged(nothing).count() == 0
    few = fill_middle.rearranged(docs, seed="other", rate=40, suffix_first=10)
    assert rows(few, *few.columns) == sorted(((r[0], *B.rearranged(r[0], r[1], "other", 40, 10)) for r in B.ROWS), key=repr)


def test_marks_across_chunks():
    """With chunks of a few bytes, marks and line ends fall on every kind of edge."""
    rng = random.Random(3)
    texts = ["".join(rng.choices("<PSM>\né x", k=rng.randrange(400))) for _ in range(300)]
    data = "".join(texts).encode()
    offsets = np.cumsum([0] + [len(t.encode()) for t in texts])
    own = fill_middle.Rearranger("7", 100, 50, fill_middle.MARKS, bits=1)
    got = own.piece([str(k) for k in range(len(texts))], np.frombuffer(data, np.uint8), offsets)
    assert [(*r[:4], r[4].decode()) for r in got] == [B.rearranged(k, t) for k, t in enumerate(texts)]
    ends, first = fill_middle.chunk_ends(np.frombuffer(data, np.uint8), offsets, 1)
    assert (np.diff(np.r_[0, ends]) == 1).any() and len(ends) > 2 * len(texts)


def test_shared_chunks_are_met_again():
    passage = " ".join(f"w{k * k % 9973}" for k in range(4000))
    texts = ["before it " + passage, "other words come first " + passage, "x" + passage + " end"]
    data, offsets = text_bytes(__import__("pyarrow").array(texts))
    own = fill_middle.Rearranger("7", 100, 50, fill_middle.MARKS)
    got = own.piece(["1", "2", "3"], data, offsets)
    assert [r[4].decode() for r in got] == [B.rearranged(k + 1, t)[4] for k, t in enumerate(texts)]
    assert own.memo.met > 0.5 * own.memo.asked
    small = fill_middle.Memo(own.marks, most=5000)
    assert [small.of(bytes([k % 7]) * 1000).chars for k in range(50)] == [1000] * 50 and len(small.known) < 7


# ---- ranked search

ITEMS = [
    (1, "shared3 of the shared4 OF the shared5 of, the shared6 of the shared7"),
    (2, "term7a10 term8a4 Term9a11"),
    (3, "x"),
    (4, ""),
    (5, None),
    (6, "not in any text at all"),
    (6, "the line"),
    (7, "... --- !!!"),
    (None, "naïve CAFÉ 你好 line of the text"),
    (8, LONG_ITEM := " ".join(f"w{k * k % 977}x{k}" for k in range(300)) + " the of is"),
]


@pytest.mark.parametrize("options", [{}, {"shard_docs": 3, "block_items": 2}, {"k": 2, "shard_docs": 5}])
def test_ranked_search(spark, docs, nothing, options):
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("term", F.lit(1)).withColumn("block", F.lit("x"))
    got = ranked_search.search(docs, items, **options)
    want = B.best([(r[0], r[1]) for r in B.ROWS], ITEMS, options.get("k", 10))
    assert rows(got, "item_id", "rank", "doc_id", "score") == sorted(want, key=repr)
    assert ranked_search.search(nothing, items).count() == 0
    assert ranked_search.search(docs, items.where("false")).count() == 0


def test_reading_stops_early():
    """Random lists with many ties against full sums; a clear winner needs few postings."""
    rng = np.random.default_rng(5)
    for turn in range(60):
        n = int(rng.integers(1, 400))
        lists = []
        for _ in range(int(rng.integers(1, 9))):
            doc = rng.permutation(n)[: rng.integers(1, n + 1)]
            score = rng.integers(0 if turn % 3 else 1, 6, len(doc))
            order = np.lexsort((doc, -score))
            lists.append((doc[order], score[order]))
        total = np.zeros(n, np.int64)
        for doc, score in lists:
            total[doc] += score
        tie = rng.permutation(n)
        best, score, _ = ranked_search.best_by_intervals(lists, n, tie, 10, first_read=4)
        order = np.lexsort((tie, -total))
        order = order[total[order] > 0][:10]
        assert best.tolist() == order.tolist() and score.tolist() == total[order].tolist()
    falling = np.arange(100_000, 0, -1)
    lists = [(np.arange(100_000), falling), (np.arange(100_000), falling * 3)]
    best, _, read = ranked_search.best_by_intervals(lists, 100_000, np.arange(100_000), 10)
    assert best.tolist() == list(range(10)) and read < 2000


def test_terms_whose_keys_collide():
    """Words of one text with one key are told apart by their bytes."""
    data = np.frombuffer(b"aa bb aa bb bb", np.uint8)
    start, end = np.array([0, 3, 6, 9, 12]), np.array([2, 5, 8, 11, 14])
    order, new = ranked_search._grouped(np.arange(5), np.zeros(5, np.uint64), np.zeros(5, np.int64))
    assert ranked_search._differ(data, start[order], (end - start)[order], new)
    exact = ranked_search._numbered(data, start, end)
    order, new = ranked_search._grouped(np.arange(5), exact, np.zeros(5, np.int64))
    assert np.diff(np.r_[np.flatnonzero(new), 5]).tolist() == [2, 3]


# ---- quality classifier


def test_features():
    texts = ["ab c", "", "ab ab", " \n", "né"]
    data = "".join(texts).encode()
    bags = quality_classifier.features(np.frombuffer(data, np.uint8), np.cumsum([0] + [len(t.encode()) for t in texts]))
    own = [bags.bucket[a:b].tolist() for a, b in zip(bags.first[:-1], bags.first[1:])]
    # ab: the word, _ab, ab_, _ab_; c: the word and _c_; a repeat adds how far back it is
    assert [len(b) for b in own] == [6, 0, 9, 0, 4]
    assert set(own[0]) & set(own[2]) and not set(own[0]) & set(own[4])
    alone = quality_classifier.features(np.frombuffer(b"ab ab", np.uint8), np.array([0, 5]))
    assert sorted(alone.bucket.tolist()) == sorted(own[2])


def test_gradient_steps_lower_the_loss():
    rng = np.random.default_rng(0)
    texts = [" ".join(rng.choice(["good", "fine", "well"] if k % 2 else ["BAD!!", "###", "$$$"], 20)) for k in range(60)]
    labels = np.arange(60) % 2
    model = quality_classifier.train(quality_classifier.Model(), texts, labels, 0, 3, 0.3)
    data, offsets = text_bytes(__import__("pyarrow").array(["good well", "### BAD!!", ""]))
    score = model.scores(quality_classifier.features(data, offsets))
    assert score[0] > 0.9 and score[1] < 0.1 and 0 < score[2] < 1
    # scoring by sums equals averaging the vectors first
    bags = quality_classifier.features(data, offsets)
    vectors = np.stack([model.table[bags.bucket[a:b]].mean(axis=0) for a, b in ((0, bags.first[1]), (bags.first[1], bags.first[2]))])
    z = vectors @ model.layer.T + model.bias
    assert np.allclose(score[:2], np.exp(z[:, 1]) / np.exp(z).sum(axis=1), atol=1e-5)


def test_quality_awkward(spark, docs, nothing):
    labels = spark.createDataFrame(
        [(r[0], k % 2, "x") for k, r in enumerate(B.ROWS)] + [(1, 0, "x"), (9999, 1, "x"), (3, None, "x")], "doc_id long, quality int, text string"
    )
    options = {"rounds": 1, "epochs": 1}
    got = quality_classifier.quality_report(docs, labels, **options).collect()
    assert len(got) == len(B.ROWS) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert all(r.held_out == (B.crc(str(r.doc_id)) % 3 == 1) for r in got if r.doc_id is not None)
    plain = quality_classifier.quality_report(docs, labels.where("false"), **options).collect()
    assert {r.score for r in plain} == {0.5} and len(plain) == len(B.ROWS)
    assert quality_classifier.quality_report(nothing, labels, **options).count() == 0
    chosen = quality_classifier.training_sample(docs, labels, "doc_id", "text", "quality", 3).collect()
    assert len(chosen) == 3 and all(B.crc(r.name) % 3 != 1 for r in chosen)


def test_quality_held_out(spark):
    folder = "/root/testdata/sf0.01/"
    table, labels = (spark.read.parquet(folder + t + ".parquet") for t in ("documents", "labels"))
    got = quality_classifier.quality_report(table, labels)
    told = got.join(labels, "doc_id").where("held_out").toPandas()
    assert len(told) > 100 and (told.predicted == told.quality).mean() > 0.95
    good, bad = told[told.quality == 1].score.values, told[told.quality == 0].score.values
    assert (good[:, None] > bad[None]).mean() > 0.98
    # labels, source and language of held-out rows change nothing
    swapped = labels.withColumn("quality", F.when(quality_classifier.is_held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = quality_classifier.quality_report(table.drop("lang", "source"), swapped)
    assert rows(got, "doc_id", "score") == rows(again, "doc_id", "score")
