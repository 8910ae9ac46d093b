"""Benchmark decontamination as a prefix-filtered set join, in column expressions only.

A window is ``window`` consecutive words of an item (a shorter item is one window). Windows are sets of shingles of
``shingle`` words. A document can hold a window only if it holds the window's rarest shingle, so that one prefix token
is joined; its place gives the place at which the window would begin, and the shingles found from there on are compared
with the window's, which is exact because overlapping shingles fix every word.

The corpus is read once for its shingles: they meet the benchmark's shingle table in the first join, which Spark does as
a broadcast if the written table is below its threshold and by shuffle beyond. What is left is of the size of the matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.functions.text import bind
from loomgraph.llm.components import no_rows
from loomgraph.operators.scale import unnest
from loomgraph.session import materialize

WINDOW = 10
SHINGLE = 3
# fixed values: a word is a run of digits, lower-case ASCII letters and characters beyond ASCII
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Words of a text with A-Z in lower case; null has none."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def shingles(of: Column, n: int) -> Column:
    """Every run of ``n`` words, joined by a space; null if there are fewer words."""

    def at(w: Column, i: Column) -> Column:
        return F.concat_ws(" ", *(F.get(w, i + k) for k in range(n)))

    return bind(of, lambda w: F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: at(w, i))))


def text_key(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def item_windows(items: DataFrame, id_col: str, text_col: str, window: int, shingle: int) -> DataFrame:
    """``(item_id, n, tokens)``: each window of each item as its shingles of ``n`` words in order."""
    split = items.select(F.col(id_col).cast("string").alias("item_id"), words(items[text_col].cast("string")).alias("w"))
    split = split.where(F.size("w") > 0).withColumn("n", F.least(F.size("w"), F.lit(shingle)))
    length = F.least(F.size("w"), F.lit(window))
    starts = F.sequence(F.lit(0), F.size("w") - length)
    each = split.withColumn("length", length).withColumn("start", F.explode(starts))

    def token(i: Column) -> Column:
        return F.array_join(F.slice("w", F.col("start") + i + 1, F.col("n")), " ")

    tokens = F.transform(F.sequence(F.lit(0), F.col("length") - F.col("n")), token)
    return each.select("item_id", "n", F.col("length"), tokens.alias("tokens")).distinct()


def contaminated_spans(
    docs: DataFrame,
    items: DataFrame,
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    shingle: int = SHINGLE,
) -> DataFrame:
    """``(key, start, end, item_id)``: each occurrence of an item's window in a text; ``key`` is ``text_key``.

    Texts that are equal share their rows. Words are numbered from 0.
    """
    spark = docs.sparkSession
    windows = materialize(item_windows(items, item_id, item_text, window, shingle), "windows")
    tokens = materialize(windows.select("n", F.explode("tokens").alias("token")).distinct(), "shingles")
    sizes = sorted(r[0] for r in tokens.select("n").distinct().collect())  # 1 to ``shingle``
    text = docs[text_col].cast("string")
    found = None
    for n in sizes:
        src = docs.select(text_key(text).alias("key"), shingles(words(text), n).alias("all"))
        places = unnest(src, ["key"], F.col("all"), "token", "pos")
        met = places.join(tokens.where(F.col("n") == n), "token")
        found = met if found is None else found.unionByName(met)
    if found is None:
        return no_rows(spark, key="binary", start="int", end="int", item_id="string")
    # equal texts have equal shingles
    found = materialize(found.select("key", "pos", "n", "token"), "matches").distinct()

    # order a window's shingles by rarity; the rarest is its prefix, and one that occurs nowhere rules the window out
    rarity = found.groupBy("n", "token").agg(F.count("*").alias("df"))
    placed = windows.select("n", "length", "tokens", F.posexplode("tokens").alias("offset", "token")).distinct()
    ranked = placed.join(rarity, ["n", "token"]).groupBy("n", "length", "tokens").agg(
        F.min(F.struct("df", "token", "offset")).alias("first"), F.count("*").alias("present")
    )
    prefixes = ranked.where(F.col("present") == F.size("tokens")).select(
        "n", "length", "tokens", F.col("first.token").alias("token"), F.col("first.offset").alias("offset")
    )
    starts = (
        found.join(prefixes, ["n", "token"])
        .select("key", "n", "length", "tokens", (F.col("pos") - F.col("offset")).alias("start"))
        .where("start >= 0")
    )
    ahead = W.partitionBy("key", "n").orderBy("pos").rangeBetween(0, window - 1)
    runs = found.select(
        "key", "n", F.col("pos").alias("start"), F.collect_list(F.struct("pos", "token")).over(ahead).alias("run")
    )
    wanted = F.transform("tokens", lambda t, j: F.struct((F.col("start") + j).alias("pos"), t.alias("token")))
    occurs = (
        starts.join(runs, ["key", "n", "start"])
        .where(F.size("run") >= F.size("tokens"))
        .where(F.slice("run", F.lit(1), F.size("tokens")) == wanted)
    )
    return occurs.join(windows, ["n", "length", "tokens"]).select(
        "key", "start", (F.col("start") + F.col("length")).alias("end"), "item_id"
    )


def covered(spans: Column) -> Column:
    """Number of words inside sorted ``[start, end)`` spans."""
    zero = F.struct(F.lit(0).cast("long").alias("hit"), F.lit(0).alias("upto"))

    def add(acc: Column, s: Column) -> Column:
        fresh = F.greatest(s["end"] - F.greatest(s["start"], acc["upto"]), F.lit(0))
        return F.struct((acc["hit"] + fresh).alias("hit"), F.greatest(acc["upto"], s["end"]).alias("upto"))

    return F.aggregate(spans, zero, add, lambda acc: acc["hit"])


def decontamination_report(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options
) -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_hit, n_items, items_sha256, contaminated.

    Null and empty texts have no words and are clean, as are all if ``items`` is empty. A null item id is not named
    but its words count as hit; repeated items and repeated rows change nothing; other columns are ignored.
    """
    spans = contaminated_spans(docs, items, text_col, **options)
    hits = spans.groupBy("key").agg(
        F.sort_array(F.collect_set(F.struct("start", "end"))).alias("spans"),
        F.sort_array(F.collect_set("item_id")).alias("ids"),
    )
    hits = hits.select(
        "key",
        covered(F.col("spans")).alias("n_hit"),
        F.size("ids").cast("long").alias("n_items"),
        F.array_join("ids", ",").alias("ids"),
    )
    text = docs[text_col].cast("string")
    rows = docs.select(
        docs[id_col].alias(id_col), text_key(text).alias("key"), F.size(words(text)).cast("long").alias("n_words")
    )
    zero = F.lit(0).cast("long")
    return rows.join(hits, "key", "left").select(
        id_col,
        "n_words",
        F.coalesce("n_hit", zero).alias("n_hit"),
        F.coalesce("n_items", zero).alias("n_items"),
        F.sha2(F.coalesce("ids", F.lit("")), 256).alias("items_sha256"),
        F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"),
    )


def without_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that hold no window of an item, all columns as they are."""
    dirty = contaminated_spans(docs, items, text_col, **options).select(F.col("key").alias("__key")).distinct()
    own = docs.withColumn("__own", text_key(docs[text_col].cast("string")))
    return own.join(dirty, F.col("__own") == F.col("__key"), "left_anti").select(*docs.columns)
