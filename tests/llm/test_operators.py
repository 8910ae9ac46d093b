"""Every operator against a plain version, on awkward rows, on nothing, and with hot groups split."""

import collections
import hashlib
import os
import sys
import uuid

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import brute as B  # noqa: E402

from loomgraph.llm import (  # noqa: E402
    decontaminate,
    language_id,
    line_dedup,
    mixing,
    near_copies,
    quality_rules,
    repeats,
    sharding,
    simhash,
    substring_dedup,
    suffix_dedup,
    token_files,
)
from loomgraph.llm.components import connected_components  # noqa: E402
from loomgraph.llm.suffix_array import Suffixes  # noqa: E402

ITEMS = [
    (1, "shared3 of the shared4 OF the shared5 of, the shared6 of the shared7"),
    (2, "term7a10 term8a4 Term9a11"),
    (3, "x"),
    (4, ""),
    (5, None),
    (6, "not in any text at all"),
    (6, "not in any text at all"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return B.table(spark).persist()


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.where("false")


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def expected(fn):
    """One row per input row: its id and what ``fn`` says of its text."""
    return sorted(((r[0], *fn(r)) for r in B.ROWS), key=repr)


def test_sharding(docs, nothing):
    got = sharding.place(docs)
    assert rows(got, "doc_id", "size", "text_crc32") == expected(lambda r: (len((r[1] or "").encode()) + 1, B.crc(r[1])))
    table = got.collect()
    for s in range(8):
        slots = sorted(r.slot for r in table if r.shard == s)
        assert slots == list(range(len(slots)))
    assert all(r.grown_shard in (r.shard, 8) for r in table)
    assert sharding.place(nothing).count() == 0
    assert sharding.with_shards(docs).columns == [*docs.columns, "shard"]


def test_shard_weights(spark):
    ids = spark.range(40000).withColumnRenamed("id", "doc_id")
    before = sharding.tree([[[1, 1], [2]], [[1, 3]]])
    after = sharding.tree([[[1, 1], [2]], [[2, 3]]])
    key = ids["doc_id"].cast("string")
    got = ids.select(sharding.shard_of(key, before).alias("a"), sharding.shard_of(key, after).alias("b")).toPandas()
    share = got.a.value_counts(normalize=True)
    for shard, weight in enumerate((1, 1, 2, 1, 3)):
        assert abs(share[shard] - weight / 8) < 0.02
    # nothing moves between subtrees whose weights stay, only into the region and shard that grew
    moved = got[got.a != got.b]
    assert 0 < len(moved) and set(moved.b) <= {3, 4} and not ((moved.b == 4) & (moved.a == 3)).any()


LANG_TEXTS = [
    ("en", "the cat and the dog sat there, then the cat left. That is the other thing"),
    ("en", "a -- b of the"),
    ("fr", "le chat et le chien sont l\u00e0; \u00c9t\u00e9 comme hiver"),
    ("ru", "\u0431\u044b\u043b\u043e \u0433\u0434\u0435 \u0436\u0438\u043b \u0432\u0435\u0442\u0435\u0440 \u0438 \u0442\u0443\u0447\u0438 \u0449\u0438"),
    ("sr", "\u0452\u0430\u043a \u0454\u0435 \u0457\u0435 \u0459\u0443\u0431\u0430\u0432 \u045a\u0435\u0433\u0430 \u045f\u0435\u043f \u0456\u0438"),
    ("zh", "\u4eca\u5929\u5929\u6c23\u5f88\u597d \u6211\u5011\u53bb\u516c\u5712"),
    ("ja", "\u4eca\u65e5\u306f\u6674\u308c\u3067\u3059 \u516c\u5712\u3078\u884c\u304d\u307e\u3059"),
    (None, "\u5929\u6c23 \u516c\u5712"),
    (None, "the \u0301 dog"),
    (None, "q"),
    (None, "\u0301 ."),
    (None, None),
    ("en", ""),
]


@pytest.mark.parametrize("block", [1, 1 << 20])
def test_language_models(spark, block, monkeypatch):
    """Languages, cross-entropies and the sum of probabilities against counting in dictionaries."""
    monkeypatch.setattr(language_id, "BLOCK", block)
    ids = [i for i in range(1000) if B.crc(str(i)) % 4 != 2]
    rows_ = [(ids[i], lang, text) for i, (lang, text) in enumerate(LANG_TEXTS)]
    got = language_id.language_report(spark.createDataFrame(rows_, "doc_id long, lang string, text string"))
    got = {r.doc_id: r for r in got.collect()}
    assert len(got) == len(rows_)
    models = B.language_models([(lang, text) for lang, text in LANG_TEXTS if lang is not None])
    for i, lang, text in rows_:
        want, entropy = B.language_of(models, text)
        assert got[i].lang_pred == want, (text, got[i])
        assert abs(got[i].cross_entropy - entropy) < 1e-9 and (want == "und") == (got[i].score == 0)
    assert [got[ids[k]].lang_pred for k in (3, 4, 7, 8, 10, 11)] == ["ru", "sr", "zh", "en", "und", "und"]


def test_language_report_of_awkward_rows(spark, docs, nothing):
    got = language_id.language_report(docs).collect()
    assert len(got) == len(B.ROWS)
    blank = [r for r in got if r.doc_id in (4, 5, 6, 8)]
    assert len(blank) == 4 and all(r.lang_pred == "und" and r.score == 0 for r in blank)
    assert all(r.lang_pred in ("en", "fr", "de") and 0 < r.score <= 1 for r in got if r.doc_id not in (4, 5, 6, 8))
    assert all(r.held_out == (B.crc(str(r.doc_id)) % 4 == 2) for r in got if r.doc_id is not None)
    assert language_id.language_report(nothing).count() == 0
    unlabelled = spark.createDataFrame([(1, None, "words"), (2, None, None)], "doc_id long, lang string, text string")
    assert [r.lang_pred for r in language_id.language_report(unlabelled).collect()] == ["und", "und"]


def test_language_accuracy(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_id.language_report(table).join(table.select("doc_id", "lang"), "doc_id").where("held_out")
    right, total = got.where("lang = lang_pred").count(), got.count()
    assert total > 200 and right >= 0.98 * total
    assert got.where("rejected").count() <= 0.1 * total


@pytest.mark.parametrize("bits", [line_dedup.FILTER_BITS, 64])
def test_lines(docs, nothing, bits):
    order = sorted({(r[0], r[1]) for r in B.ROWS if r[1] is not None}, key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5(r[1].encode()).digest()))
    seen, removed = [], {}
    for doc, text in order:
        gone = set()
        for k, line in enumerate(text.split("\n")):
            own = B.words(line)
            if own:
                body = " ".join(own).encode()
                if any(o == own or min(len(o), len(own)) >= 8 and line_dedup.alike(" ".join(o).encode(), body) for o in seen):
                    gone.add(k)
                seen.append(own)
        removed[doc, text] = gone

    def want(r):
        lines = r[1].split("\n") if r[1] is not None else []
        gone = removed.get((r[0], r[1]), ())
        return len(lines), len(gone), B.sha("\n".join(x for k, x in enumerate(lines) if k not in gone).encode())

    got = line_dedup.line_report(docs, filter_bits=bits)
    assert rows(got, "doc_id", "n_lines", "n_removed", "kept_sha256") == expected(want)
    assert line_dedup.line_report(nothing).count() == 0


def test_line_edits(spark):
    """Each kind of edit at each place, against all pairs."""
    base = [f"w{k}" for k in range(9)]
    lines = [base, base + ["end"], base[1:], ["w0"] * 9, ["w0"] * 8, base[:4] + base[5:], base[:3] + ["new"] + base[4:]]
    lines += [base[:k] + ["add"] + base[k:] for k in range(10)] + [base[:k] + ["put"] + base[k + 1 :] for k in range(9)]
    lines += [["far", "away"] + base, base[:7], base[:6] + ["q", "r", "s"]]
    docs = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(lines)], "doc_id long, text string")
    want = {
        k
        for k, x in enumerate(lines)
        for y in lines[:k]
        if x == y or min(len(x), len(y)) >= 8 and line_dedup.alike(" ".join(x).encode(), " ".join(y).encode())
    }
    got = {r.doc_id for r in line_dedup.line_report(docs).where("n_removed > 0").collect()}
    assert got == want


def test_decontamination(spark, docs, nothing):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    known = [i for i in ITEMS if i[1]]
    columns = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    got = decontaminate.decontamination_report(docs, items)
    assert rows(got, *columns) == expected(lambda r: B.contaminated(r[1], known))
    assert not any("Python" in x or "Arrow" in x for x in got._jdf.queryExecution().toString().split())
    clean = decontaminate.decontamination_report(docs, items.where("false"))
    assert clean.where("contaminated OR n_hit > 0").count() == 0 and clean.count() == len(B.ROWS)
    assert decontaminate.decontamination_report(nothing, items).count() == 0
    kept = decontaminate.without_contaminated(docs, items)
    assert kept.columns == docs.columns
    assert kept.count() == sum(not B.contaminated(r[1], known)[4] for r in B.ROWS)


def test_mixing(docs, nothing):
    got = mixing.mix(docs)
    assert rows(got, "doc_id", "size") == expected(lambda r: (len(B.words(r[1])),))
    sizes = collections.Counter()
    for r in B.ROWS:
        sizes[r[3]] += len(B.words(r[1]))
    want = B.targets(sizes)
    by_id = {r[0]: r[3] for r in B.ROWS}
    taken = collections.Counter()
    for r in got.collect():
        source = by_id[r.doc_id]
        assert r.source_size == sizes[source] and abs(r.target - want[source]) < 1e-6 and 0 <= r.taken <= 2 * r["size"]
        taken[source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 0.5 for s in sizes)
    assert rows(got, "doc_id", "taken") == rows(mixing.mix(docs.repartition(5)), "doc_id", "taken")
    assert mixing.mix(nothing).count() == 0
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns and mixed.count() > 0 and mixing.mixed(nothing).count() == 0


def test_mixing_prefers_quality(spark):
    from pyspark.sql import functions as F

    table = spark.range(4000).select(
        F.col("id").alias("doc_id"), F.lit("two words").alias("text"), F.when(F.col("id") < 2000, "a").otherwise("b").alias("source")
    )
    good = F.when(F.col("doc_id") % 2 == 0, 0.9).otherwise(0.1)
    got = mixing.mix(table, good, weights=(1, 1), share=0.5).toPandas()
    assert got.taken[got.doc_id % 2 == 0].sum() > 3 * got.taken[got.doc_id % 2 == 1].sum()
    assert abs(got.taken.sum() - 4000) <= 2


def spans(gone):
    return sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))


@pytest.mark.parametrize("hot, at_once", [(10_000, 1 << 22), (10_000, 300), (1, 300)])
def test_suffix_arrays(docs, nothing, hot, at_once):
    window = 60
    texts = [(r[1] or "").encode() for r in B.ROWS]
    gone = dict(zip(texts, B.repeated(texts, window)))

    def want(r):
        text = (r[1] or "").encode()
        own = gone[text]
        kept = bytes(b for b, g in zip(text, own) if not g)
        return len(text), sum(own), spans(own), B.sha(kept)

    got = suffix_dedup.suffix_report(docs, window=window, gram=8, hot=hot, at_once=at_once)
    assert rows(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == expected(want)
    assert suffix_dedup.suffix_report(nothing).count() == 0


def test_suffix_order():
    rng = np.random.default_rng(3)
    for trial in range(60):
        n, depth, letters = int(rng.integers(0, 300)), int(rng.integers(1, 30)), int(rng.integers(1, 4))
        text = rng.integers(97, 97 + letters, n).astype(np.uint8)
        if n > 100 and trial % 2:
            text[50:90] = text[:40]
        order = Suffixes(text, depth).array()
        body = bytes(text) + bytes(depth)
        heads = [body[k : k + depth] for k in order]
        assert sorted(order.tolist()) == list(range(n)) and heads == sorted(heads)
        assert Suffixes(text, depth, 1).array().tolist() == order.tolist()
        wanted = rng.random(n) < rng.random()
        some = Suffixes(text, depth).array(wanted)
        assert sorted(some.tolist()) == np.flatnonzero(wanted).tolist()
        heads = [body[k : k + depth] for k in some]
        assert heads == sorted(heads)


def shared(a, b):
    return next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def test_common_prefixes():
    rng = np.random.default_rng(5)
    for trial in range(60):
        n, depth, letters = int(rng.integers(2, 400)), int(rng.integers(1, 60)), int(rng.integers(1, 4))
        text = rng.integers(97, 97 + letters, n).astype(np.uint8)
        if n > 200 and trial % 2:
            text[100:190] = text[:90]
        suffixes = Suffixes(text, depth)
        order = suffixes.array()
        order = order[order <= n - depth]  # whole windows
        lengths, in_order = suffixes.common_prefixes(order)
        body = bytes(text)
        heads = [body[k : k + depth] for k in order]
        assert in_order and lengths.tolist() == [0, *map(shared, heads, heads[1:])][: len(order)]
        if len(set(heads)) > 1:
            assert not suffixes.common_prefixes(order[::-1])[1]


@pytest.mark.parametrize(
    "module, window, gram, units",
    [(suffix_dedup, 60, 8, repeats.ByteUnits), (substring_dedup, 9, 3, repeats.WordUnits)],
)
def test_strings_of_one_anchor_dealt_again(module, window, gram, units):
    """One passage in three megabytes of different surroundings, many times what is compared at once."""
    rng = np.random.default_rng(11)
    vocabulary = np.array([f"w{k}" for k in range(3000)])
    common = " ".join(rng.choice(vocabulary, 40))
    some = [" ".join(rng.choice(vocabulary, 30)) for _ in range(200)]
    texts = sorted({f"{some[int(rng.integers(200))]} {common} {k} {some[int(rng.integers(200))]}" for k in range(6000)})
    body = "".join(texts).encode()
    assert len(body) > 2 << 20
    data, offsets = np.frombuffer(body, np.uint8), np.cumsum([0, *(len(t) for t in texts)])
    n = np.diff(units(data, offsets).first) - window + 1
    copies = rng.integers(1, 3, len(texts)).astype(float)
    plan = repeats.Plan(units, window, gram, module.occur_again(window))
    want = plan.again(data, offsets, n, copies)
    for at_once in (1 << 20, 50_000):
        assert (repeats.dealt_again(data, offsets, n, copies, plan, at_once) == want).all()
    assert 0.1 < want.mean() < 0.99


@pytest.mark.parametrize("hot, at_once", [(10_000, 1 << 22), (10_000, 300), (1, 300)])
def test_substrings(docs, nothing, hot, at_once):
    window = 9
    texts = [tuple(B.words(r[1])) for r in B.ROWS]
    gone = dict(zip(texts, B.repeated(texts, window)))

    def want(r):
        own = tuple(B.words(r[1]))
        kept = [w for w, g in zip(own, gone[own]) if not g]
        return len(own), sum(gone[own]), B.sha(" ".join(kept).encode())

    got = substring_dedup.substring_report(docs, window=window, gram=3, hot=hot, at_once=at_once)
    # texts that differ in white space only are one sequence of words, which is as the plain version has it
    assert rows(got, "doc_id", "n_words", "n_removed", "kept_sha256") == expected(want)
    assert substring_dedup.substring_report(nothing).count() == 0


def test_quality(docs, nothing):
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    got = quality_rules.quality_report(docs)
    assert rows(got, *columns) == expected(lambda r: B.quality(r[1]))
    assert got.where("base_failed AND kept").count() == 0
    assert quality_rules.quality_report(nothing).count() == 0
    kept = quality_rules.keep_good(docs)
    assert kept.columns == docs.columns and kept.count() == got.where("kept").count()


@pytest.mark.parametrize("split_over", [10_000, 1])
def test_simhash(docs, nothing, split_over, monkeypatch):
    monkeypatch.setattr(simhash.fingerprint_classes, "__defaults__", (simhash.RADIUS, split_over))
    fps = [B.fingerprint(r[1]) for r in B.ROWS]
    root = B.components(fps, lambda a, b: bin(a ^ b).count("1") <= 3)
    least = {}
    for k, r in enumerate(B.ROWS):
        if r[0] is not None:
            least[root[k]] = min(r[0], least.get(root[k], r[0]))
    want = sorted(((r[0], f"{fps[k]:016x}", least.get(root[k])) for k, r in enumerate(B.ROWS)), key=repr)
    assert rows(simhash.near_duplicates(docs), "doc_id", "fingerprint", "component_id") == want
    assert simhash.near_duplicates(nothing).count() == 0


@pytest.mark.parametrize("radius", [1, 2, 3, 5])
def test_bit_sliced_links(radius):
    rng = np.random.default_rng(radius)
    group, values = [], []
    for g in range(30):
        base = int(rng.integers(0, 1 << 62))
        own = {base}
        for _ in range(int(rng.integers(0, 120))):
            x = base
            for b in rng.integers(0, 64, int(rng.integers(0, 2 * radius + 2))):
                x ^= 1 << int(b)
            own.add(x)
        values += sorted(own)
        group += [g] * len(own)
    group, values = np.array(group), np.array(values, np.uint64)
    both = list(zip(group.tolist(), values.tolist()))
    want = B.components(both, lambda a, b: a[0] == b[0] and bin(a[1] ^ b[1]).count("1") <= radius)
    a, b = simhash.joined(group, values, (radius,))
    links = set(zip(a.tolist(), b.tolist()))
    assert all(bin(int(values[x]) ^ int(values[y])).count("1") <= radius for x, y in links)
    up = list(range(len(both)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for x, y in links:
        up[max(root(x), root(y))] = min(root(x), root(y))
    assert [root(k) for k in range(len(both))] == want and len(links) == len(both) - len(set(want))
    masks = simhash.bucket_masks(radius)
    for x, y in links:
        assert any((int(values[x]) ^ int(values[y])) & (m % (1 << 64)) == 0 for m in masks)


def test_simhash_of_one_hot_bucket(spark, monkeypatch):
    """Fingerprints that agree in 44 bits: no bucket stays large, and no pair is lost."""
    rng = np.random.default_rng(3)
    values = np.unique(rng.integers(0, 1 << 20, 1500)) + (5 << 40)
    rest, sizes, linked = values, [], simhash.linked_rows

    def recorded(dealt, keys, *more):
        sizes.append(dealt.groupBy(*keys).count().agg({"count": "max"}).first()[0] or 0)
        return linked(dealt, keys, *more)

    monkeypatch.setattr(simhash, "linked_rows", recorded)
    got = {r.fp: r.label for r in simhash.fingerprint_classes(spark.createDataFrame([(int(v),) for v in values], "fp long"), 3, 60).collect()}
    want = {}
    while len(rest):
        group, new = rest[:0], rest[:1]
        while len(new):
            group, rest = np.r_[group, new], np.setdiff1d(rest, new)
            near = np.bitwise_count(rest[:, None] ^ new[None, :]) <= 3
            new = rest[near.any(axis=1)]
        want |= {int(v): int(group.min()) for v in group}
    assert got == want and max(sizes) <= 60


def test_chain_of_links(spark):
    edges = [(k, k + 1) for k in range(200)] + [(1000, 999), (5, 5), (None, 3)]
    got = {r.node: r.label for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(201)} | {999: 999, 1000: 999}


@pytest.mark.parametrize("split_over", [10_000, 1])
def test_near_copies(spark, split_over):
    rng = np.random.default_rng(5)
    texts = []
    for d in range(30):
        base = [f"t{d}x{k}" for k in range(150)]
        texts.append(base)
        for _ in range(int(rng.integers(0, 5))):
            copy = list(base)
            for k in rng.integers(0, 150, int(rng.integers(1, 9))):
                copy[k] = f"new{int(rng.integers(0, 10**6))}"
            texts.append(copy)
    texts = [" ".join(t) for t in texts] + ["", None, "", "short text", "short text"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")

    def grams(text):
        w = B.words(B.lower(text))
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)}

    sets = [grams(t) for t in texts]
    root = B.components(sets, lambda a, b: len(a & b) >= 0.8 * len(a | b))
    got = sorted(r.doc_id for r in near_copies.keep_one_of_each(docs, split_over=split_over).collect())
    assert got == sorted(set(root))


@pytest.mark.parametrize("options", [{}, {"split_over": 16, "block": 8}])
def test_near_copies_in_stars(spark, options):
    """Copies that are near a base but not near each other, and nearer in bits to each other than to the base."""
    rng = np.random.default_rng(11)
    texts = []
    for d in range(3):
        base = [f"s{d}x{k}" for k in range(300)]
        texts.append(base)
        for _ in range(80):
            copy = list(base)
            for k in rng.choice(60, 5, replace=False):
                copy[5 * k + 2] = f"new{int(rng.integers(0, 10**9))}"
            texts.append(copy)
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    sets = [{tuple(t[k : k + 5]) for k in range(len(t) - 4)} for t in texts]
    root = B.components(sets, lambda a, b: len(a & b) >= 0.8 * len(a | b))
    got = sorted(r.doc_id for r in near_copies.keep_one_of_each(docs, **options).collect())
    assert got == sorted(set(root))


def test_near_copies_with_repeated_passages(spark):
    """Equal sets of shingles have one fingerprint, however often a passage is repeated."""
    one, two = " ".join(f"p{k}" for k in range(40)), " ".join(f"q{k}" for k in range(40))
    texts = [f"{one} {one} {two} {two}", f"{one} {one} {two}" + f" {two}" * 60]
    keyed = spark.createDataFrame([(t[-9:].encode() + bytes([k]), t) for k, t in enumerate(texts)], "key binary, text string")
    assert len({(r.fp, tuple(r.least)) for r in near_copies._sketches(keyed, 5).collect()}) == 1
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.doc_id for r in near_copies.keep_one_of_each(docs).collect()] == [0]


def test_near_copies_of_awkward_rows(docs, nothing):
    def grams(text):
        w = B.words(B.lower(text))
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())

    # without words only equal texts are copies; null counts as empty
    sets = [grams(r[1]) or {r[1] or ""} for r in B.ROWS]
    root = B.components(sets, lambda a, b: len(a & b) >= 0.8 * len(a | b))
    want = {}
    for k, r in enumerate(B.ROWS):
        best = min(want.get(root[k], (True, 0)), (r[0] is None, r[0] or 0))
        want[root[k]] = best
    kept = near_copies.keep_one_of_each(docs)
    assert rows(kept, "doc_id") == sorted(((None if none else d,) for none, d in want.values()), key=repr)
    assert kept.columns == docs.columns and near_copies.keep_one_of_each(nothing).count() == 0


def test_token_files(spark, docs, nothing):
    import public_tokenizers
    from tokenizers import Tokenizer

    from loomgraph.session import fresh_path

    definition = public_tokenizers.path("word_bpe_49k.json")
    path = fresh_path(spark, f"tokens-{uuid.uuid4().hex}")
    token_files.write_tokens(docs, path, definition)
    tokenizer = Tokenizer.from_file(definition)
    texts = collections.Counter()
    ids = {}
    for r in B.ROWS:
        ids[r[0], r[1]] = [*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 1]
        texts[r[0]] += 1
    written = token_files.read_tokens(spark, path)
    want = sorted(((r[0], ids[r[0], r[1]]) for r in B.ROWS), key=repr)
    assert sorted(((r.doc_id, list(r.ids)) for r in written.collect()), key=repr) == want
    digest = token_files.token_digest(written).collect()
    start = 0
    for r in sorted(digest, key=lambda r: r.start):
        assert r.start == start
        start += r.n_tokens
    order = [r.doc_id for r in sorted(digest, key=lambda r: r.start)]
    assert order == sorted(order, key=lambda d: (d is not None, d or 0))
    import zlib

    for r in digest:
        if texts[r.doc_id] == 1:
            own = next(v for k, v in ids.items() if k[0] == r.doc_id)
            assert r.ids_crc32 == zlib.crc32(np.array(own, "<u4").tobytes())
    some = token_files.read_tokens(spark, path, [7, 11])
    assert {r.doc_id for r in some.collect()} == {7, 11}
    assert "PushedFilters: [In(doc_id" in some._jdf.queryExecution().toString()
    empty = fresh_path(spark, "tokens")
    token_files.write_tokens(nothing, empty, definition)


def test_words_kept_by_a_worker_do_not_change_ids(monkeypatch):
    import public_tokenizers

    texts = [(r[1] or "").encode() for r in B.ROWS]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.r_[0, np.cumsum([len(t) for t in texts])]
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file:
        definition = file.read()
    want, count = token_files.WordEncoder(definition).ids_of(data, offsets, 1)
    monkeypatch.setattr(token_files, "KEPT_WORDS", 10)
    own = token_files.WordEncoder(definition)
    for _ in range(3):
        got, again = own.ids_of(data, offsets, 1)
        assert (got == want).all() and (again == count).all()
