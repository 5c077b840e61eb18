"""Benchmark decontamination: a prefix-filtered set join of item windows with documents.

Every window of an item must occur whole, so of its words, ordered by rarity in the corpus,
the first alone is the necessary prefix. Document words join with these rarest words; position
and length bound where a window could start, and the words there verify it exactly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, looked_up, prepare, private, table

WINDOW = 10
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# What words of the contract leave out, before letters are lowered.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
END = "\n"  # no word holds it


def lowered(c):
    return F.translate(c, UPPER, LOWER)


def pieces(text):
    """Words as they stand; the first and last may be empty strings."""
    return F.split(F.coalesce(text, F.lit("")), BETWEEN)


def item_windows(items: DataFrame, item_id: str, text: str, window: int) -> DataFrame:
    """(item, ws): each distinct window of each item, words lowered; a short item is one window."""
    ws = F.filter(pieces(lowered(F.col(f"`{text}`"))), lambda w: w != "")
    i = items.select(F.col(f"`{item_id}`").cast("string").alias("item"), ws.alias("all")).where(F.size("all") > 0)
    at = F.explode(F.sequence(F.lit(1), F.greatest(F.size("all") - window + 1, F.lit(1)))).alias("at")
    return i.select("item", "all", at).select("item", F.slice("all", F.col("at"), window).alias("ws")).distinct()


def contamination(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_hit, items, hits) of every document.

    items: the ids, as sorted strings, of items with a window that occurs in the document; hits:
    merged (from, to) word ranges, to exclusive, which n_hit counts. Null texts have no words;
    items without words have no window, and those with a null id give hits but no name. Repeated
    rows stay repeated. Without documents the result is empty; without items it is all zeros.
    """
    return _contamination(docs, items, doc_id, text, item_id, item_text, window).drop("th")


def _contamination(docs: DataFrame, items: DataFrame, doc_id: str, text: str, item_id: str, item_text: str, window: int) -> DataFrame:
    """contamination with th, the hash of the text, which tells rows of one doc_id apart."""
    prepare(docs.sparkSession)
    named = item_windows(items, item_id, item_text, window).checkpoint()
    wins = named.select("ws").distinct().withColumn("win", F.monotonically_increasing_id()).checkpoint()  # fixed by the checkpoint
    size = named.agg(F.sum(F.expr("aggregate(ws, 32L, (a, w) -> a + 24 + octet_length(w))"))).first()[0] or 0
    small = F.broadcast if size <= BROADCAST_BYTES else lambda df: df

    words = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.xxhash64(F.col(f"`{text}`")).alias("th"), pieces(F.col(f"`{text}`")).alias("ps"))
    vocabulary = wins.select(F.explode("ws").alias("w")).select(F.lower("w").alias("key")).distinct()
    # outer: else the texts are split once more for a filter on the number of words
    common = words.select(F.explode_outer("ps").alias("w")).select(F.lower("w").alias("key")).join(small(vocabulary), "key", "left_semi").groupBy("key").count().checkpoint()
    each = wins.select("win", F.posexplode("ws").alias("offset", "w")).select("win", "offset", F.lower("w").alias("key")).checkpoint()
    rank = looked_up(each, common, ["key"])  # frequent words are no hot keys
    rank = rank.groupBy("win").agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("count"), "key", "offset")).alias("rarest"))
    prefix = rank.join(wins, "win").select(F.array_join("ws", " ").alias("win_text"), F.size("ws").alias("n"), "win", "rarest.key", "rarest.offset").checkpoint()

    spaced = words.withColumn("n_words", F.size("ps") - (F.element_at("ps", 1) == "").cast("int") - ((F.size("ps") > 1) & (F.element_at("ps", -1) == "")).cast("int"))
    # No lambda here: with one, Spark would leave generated code and copy the whole array for each word.
    here = lowered(F.array_join(F.slice("ps", F.col("pos") - F.col("offset") + 1, F.col("n")), " "))
    fits = (F.col("pos") >= F.col("offset")) & (F.col("pos") - F.col("offset") + F.col("n") <= F.size("ps"))
    start = F.col("pos") - F.col("offset")
    hit = F.when(F.col("win").isNotNull(), F.struct(start.alias("a"), (start + F.col("n")).alias("b"))).alias("hit")
    if size <= BROADCAST_BYTES:
        # one row more for each document, so that those without hits stay too
        spread = spaced.select("doc_id", "th", "n_words", "ps", F.posexplode(F.concat("ps", F.array(F.lit(END)))).alias("pos", "w"))
        probe = prefix.union(docs.sparkSession.sql(f"SELECT CAST(NULL AS STRING), 0, CAST(NULL AS LONG), '{chr(92)}n', 0"))
        exact = F.when(F.col("win").isNull(), True).when(fits, here == F.col("win_text")).otherwise(False)
        found = spread.withColumn("key", F.lower("w")).join(F.broadcast(probe), "key").where(exact).select("doc_id", "th", "n_words", "win", hit)
    else:  # the words' positions travel without the documents, which join again to verify; rows of documents without hits stay out of the joins
        keys = spaced.select("doc_id", "th", "n_words", F.posexplode("ps").alias("pos", "w")).select("doc_id", "th", "n_words", "pos", F.lower("w").alias("key"))
        near = keys.join(prefix, "key").where(F.col("pos") >= F.col("offset"))
        whole = words.select(F.col("doc_id").alias("d"), F.col("th").alias("t"), "ps").dropDuplicates(["d", "t"])
        found = near.join(whole, F.col("doc_id").eqNullSafe(F.col("d")) & F.col("th").eqNullSafe(F.col("t"))).where(F.when(fits, here == F.col("win_text")).otherwise(False)).select("doc_id", "th", "n_words", "win", hit)
        found = found.union(spaced.select("doc_id", "th", "n_words", F.lit(None).cast("long"), F.lit(None).cast("struct<a: int, b: int>")))
    per = found.groupBy("doc_id", "th", "n_words").agg(F.collect_set("hit").alias("hits"), F.collect_set("win").alias("wins"), F.count_if(F.col("win").isNull()).alias("copies")).checkpoint()

    of = named.where("item IS NOT NULL").join(wins, "ws").select("win", "item")
    items_of = per.select("doc_id", "th", F.explode("wins").alias("win")).join(of, "win").groupBy("doc_id", "th").agg(F.array_sort(F.collect_set("item")).alias("items"))
    items_of = items_of.select(F.col("doc_id").alias("d"), F.col("th").alias("t"), "items")
    merged = F.expr("""aggregate(array_sort(hits), CAST(array() AS ARRAY<STRUCT<a: INT, b: INT>>), (m, h) ->
        CASE WHEN size(m) > 0 AND element_at(m, -1).b >= h.a
             THEN concat(slice(m, 1, size(m) - 1), array(struct(element_at(m, -1).a AS a, greatest(element_at(m, -1).b, h.b) AS b)))
             ELSE concat(m, array(h)) END)""")
    per = per.withColumn("hits", merged)
    out = per.join(items_of, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t")), "left")
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    n_hit = F.expr("aggregate(hits, 0L, (n, h) -> n + h.b - h.a)")
    return out.select("doc_id", "th", F.col("n_words").cast("long").alias("n_words"), n_hit.alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), "hits")


def clean(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """The documents in which no window of an item occurs. Rows that share a doc_id, or have none, are judged each by its own text."""
    p = private(docs)
    hit = _contamination(docs, items, doc_id, text, item_id, item_text, window).where("n_hit > 0").select(F.col("doc_id").alias(f"{p}id"), F.col("th").alias(f"{p}th")).distinct()
    return docs.join(hit, F.col(f"`{doc_id}`").eqNullSafe(F.col(f"{p}id")) & (F.xxhash64(F.col(f"`{text}`")) == F.col(f"{p}th")), "left_anti")


def op6_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Words of every whole text of documents that windows of benchmark items cover. Null texts have no words; see contamination."""
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    sha = F.sha2(F.encode(F.array_join("items", ","), "UTF-8"), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), sha.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


ORACLE = f"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '') AS ws FROM documents),
b AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '') AS ws FROM benchmark),
bw AS (
  SELECT item_id, least(len(ws), {WINDOW}) AS n, array_to_string(ws[i:i + {WINDOW} - 1], ' ') AS k
  FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - {WINDOW} + 1, 1) + 1)) AS i FROM b WHERE len(ws) > 0)),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS k
  FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, lens WHERE len(ws) >= n)),
hit AS (SELECT DISTINCT doc_id, i, n, item_id FROM dw JOIN bw USING (n, k)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS s FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN its USING (doc_id)
"""
