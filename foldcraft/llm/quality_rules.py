"""Quality rules: fixed text rules and a hashed n-gram log-likelihood ratio.

The ratio compares two multinomials over hashed n-grams: one counted on the
trusted documents (those labelled good), one on the whole corpus.  A
document's score is the mean over its n-grams of log(p_trusted / p_raw); it
is kept if the score reaches a fixed threshold and no base rule failed.

N-grams are character n-grams at word borders, two per word in the query: the
word's last three characters, and its last two with the next word's first two,
each kind in a half of ``BUCKETS`` buckets.  Without ``ends`` there is one per
word, its last three characters with the next word's first two.  Hashing gives
both counts and the table of ratios a fixed size whatever the corpus.

Distribution.  Texts are joined to the labels once, by doc_id (a shuffle of
the texts: labels grow with the corpus); counting aggregates map-side into at
most BUCKETS rows per task.  Scoring reads the texts again without moving
them: n-grams meet the broadcast table (BUCKETS rows, a fixed bound) and are
summed map-side to one row per document.  The rules are evaluated inside the
row, with array functions.

Defined results: null text is read as empty; a text without words has
n_words 0, so it fails the base rules; with no trusted document at all every
ratio is 0; several labels of one document count as good if any is; rows
that share a doc_id are told apart by their text's hash, and rows repeated
whole get equal results; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import SPACES, documents, has_word, text_key, text_of, words_of

BUCKETS = 1 << 16
ALPHA = 0.5
#: mean log-likelihood ratio from which a document is kept
THRESHOLD = -1.0
MIN_WORDS = 50
MAX_REPEAT_PCT = 50
SYMBOLS = "#*$%&|<>"


def grams(words: Column, buckets: int = BUCKETS, ends: bool = False) -> Column:
    """Buckets (a power of two of them) of the n-grams of an array of words;
    nothing follows the last word.  With ``ends``, the words' endings by
    themselves and the shorter borders, two per word."""
    nexts = F.slice(words, 2, F.greatest(F.size(words), F.lit(1)))

    def bucket(n, *parts):
        return F.xxhash64(*parts).bitwiseAND(F.lit(n - 1)).cast("int")

    if not ends:
        return F.zip_with(words, nexts, lambda a, b: bucket(buckets, F.substring(a, -3, 3), F.substring(b, 1, 2)))
    half = buckets // 2
    return F.concat(F.transform(words, lambda a: bucket(half, F.substring(a, -3, 3))), F.zip_with(
        words, nexts, lambda a, b: bucket(half, F.substring(a, -2, 2), F.substring(b, 1, 2)) + half))


def _exploded(d: DataFrame, buckets: int, ends: bool, *keep: str) -> DataFrame:
    """A row (keep..., g) per n-gram of the words ws, or one with null.  Words,
    n-grams and rows are made in steps of their own, and explode_outer adds no
    filter, so each is computed once."""
    return d.select(*keep, grams(F.col("ws"), buckets, ends).alias("gs")).select(*keep, F.explode_outer("gs").alias("g"))


def base_rules(docs: DataFrame) -> DataFrame:
    """(doc_id, tkey, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words) of rows (doc_id, text)."""
    d = docs.select("doc_id", text_of(F.col("text")).alias("t"))
    d = d.select("doc_id", "t", text_key(F.col("t")).alias("tkey"), words_of(F.col("t")).alias("ws"),
                 F.filter(F.split("t", "\n"), has_word).alias("ls"))
    n = F.size("ws")
    hashes = F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(
        F.get("ws", i), F.get("ws", i + 1), F.get("ws", i + 2))))
    d = d.select("doc_id", "tkey", "t", "ls", "ws", hashes.alias("hs"))
    # where a window repeats: (hash, place) of all, equal ones side by side
    windows = F.when(F.size(F.array_distinct("hs")) < F.size("hs"), F.sort_array(F.transform(
        "hs", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    d = d.select("doc_id", "tkey", "t", "ls", "ws", windows.alias("win"))
    again = F.filter("win", lambda x, i: (F.get("win", i - 1)["h"].eqNullSafe(x["h"]))
                     | (F.get("win", i + 1)["h"].eqNullSafe(x["h"])))
    d = d.select("doc_id", "tkey", "t", "ls", "ws", F.sort_array(F.transform(again, lambda x: x["i"])).alias("at"))
    # a window covers three words, or those up to the next window's start
    covered = F.aggregate(
        F.zip_with("at", F.slice("at", 2, F.greatest(F.size("at"), F.lit(1))),
                   lambda a, b: F.least(F.coalesce(b - a, F.lit(3)), F.lit(3))),
        F.lit(0), lambda acc, x: acc + x)
    return d.select(
        "doc_id", "tkey", F.size("ws").cast("long").alias("n_words"),
        F.length(F.translate("t", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("ls") - F.size(F.array_distinct("ls"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def ratio_table(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, alpha: float = ALPHA,
                ends: bool = False) -> DataFrame:
    """(g, llr), a row per bucket seen in ``docs``: log ratio of the bucket's
    share among the trusted documents (doc_ids in ``trusted``) and among all,
    both smoothed by ``alpha`` per bucket; in whole millionths, so that sums
    do not depend on the order of addition."""
    good = trusted.select(F.col("doc_id").alias("_good")).distinct()
    # both sides are shuffled at every size: the labels grow with the corpus
    d = docs.select("doc_id", text_of(F.col("text")).alias("t")).join(
        good.hint("merge"), F.col("doc_id") == F.col("_good"), "left")
    d = d.select(F.col("_good").isNotNull().cast("long").alias("good"), words_of(F.col("t")).alias("ws"))
    g = _exploded(d, buckets, ends, "good").filter("g is not null")
    counts = cut_lineage(g.groupBy("g").agg(F.count(F.lit(1)).alias("raw"), F.sum("good").alias("good")),
                         "gram-counts")
    n_raw, n_good = counts.agg(F.sum("raw"), F.sum("good")).first()  # two numbers
    if not n_good:
        return counts.select("g", F.lit(0).cast("long").alias("llr"))
    shift = math.log(n_raw + alpha * buckets) - math.log(n_good + alpha * buckets)
    ratio = F.log(F.col("good") + alpha) - F.log(F.col("raw") + alpha) + shift
    return counts.select("g", F.round(ratio * 1e6).cast("long").alias("llr"))


def score_documents(docs: DataFrame, ratios: DataFrame, buckets: int = BUCKETS, ends: bool = False) -> DataFrame:
    """(doc_id, tkey, llr): mean log ratio of every document with a word."""
    d = docs.select("doc_id", text_of(F.col("text")).alias("t")).select(
        "doc_id", text_key(F.col("t")).alias("tkey"), words_of(F.col("t")).alias("ws"))
    d = _exploded(d, buckets, ends, "doc_id", "tkey")
    r = ratios.select(F.col("g").alias("r_g"), "llr")
    # BUCKETS rows at most
    scored = d.join(F.broadcast(r), F.col("g") == F.col("r_g"))
    return scored.groupBy("doc_id", "tkey").agg((F.sum("llr") / F.count(F.lit(1)) / F.lit(1e6)).alias("llr"))


def judge_documents(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD,
                    min_words: int = MIN_WORDS, max_repeat_pct: int = MAX_REPEAT_PCT,
                    ends: bool = False) -> DataFrame:
    """Base figures, llr and verdict of every row of ``docs``."""
    base = cut_lineage(base_rules(docs), "quality-base")
    scores = score_documents(docs, ratio_table(docs, trusted, ends=ends), ends=ends).select(
        F.col("doc_id").alias("s_doc"), F.col("tkey").alias("s_key"), "llr")
    d = base.join(scores, F.col("doc_id").eqNullSafe(F.col("s_doc")) & (F.col("tkey") == F.col("s_key")), "left")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_pct * F.col("n_words"))
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                    failed.alias("base_failed"), (~failed & (F.coalesce("llr", F.lit(0.0)) >= threshold)).alias("kept"),
                    F.coalesce("llr", F.lit(0.0)).alias("llr"))


def trusted_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality = 1").select("doc_id")


def op8_quality_rules(spark, sf_dir):
    """op8: the rules' figures and verdict of every document."""
    return judge_documents(documents(spark, sf_dir), trusted_labels(spark, sf_dir), ends=True).drop("llr")


#: the part that SQL can express: all but the hashed ratio
RULES_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, string_split(coalesce(text, ''), chr(10)) AS ls,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
w AS (SELECT doc_id, ws, unnest(generate_series(1, len(ws))) AS i FROM d),
win AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i], ws[i + 1], ws[i + 2]) AS c
  FROM w WHERE i + 2 <= len(ws)),
rep AS (
  SELECT doc_id, CAST(sum(least(coalesce(nxt - i, 3), 3)) AS BIGINT) AS n FROM (
    SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM win WHERE c > 1) x GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(ls) AS line FROM d),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lines
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
base AS (
  SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN rep USING (doc_id) LEFT JOIN dup USING (doc_id))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base
"""
