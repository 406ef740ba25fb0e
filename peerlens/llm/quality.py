"""Quality rules: hashed n-gram log-likelihood ratio of a trusted target to the raw corpus. DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, let, materialize

BUCKETS = 1 << 16
SMOOTHING = 2.0
# Between the scores of good and bad documents of one half of the labels, nearer to the good ones, since a document that
# is junk in part scores between; README gives the scores of the other half.
THRESHOLD = -0.25
# A token is a run of letters, marks and digits, or a run of other signs: so each word is read whole, and signs hung on
# it, in front, inside or behind, are tokens of their own.
TOKEN = r"[\p{L}\p{M}\p{N}]+|[^\p{L}\p{M}\p{N}\x20\x09-\x0D]+"
MIN_WORDS = 50
BROADCAST_IDS = 2_000_000
SYMBOLS = "#*$%&|<>"
ASCII_SPACE = " \t\n\x0b\x0c\r"


def split_words(text: Column) -> Column:
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(ASCII_SPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE))


def n_repeat_words(words: Column) -> Column:
    """Words that lie in a 3-word window found twice or more. Windows are compared by 64-bit hashes of words."""

    def covered(windows: Column) -> Column:
        ordered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        repeated = lambda s: F.filter(s, lambda x, i: ((i > 0) & (F.get(s, i - 1)["h"] == x["h"])) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False)))
        places = F.sort_array(F.transform(let(ordered, repeated), lambda x: x["i"]))
        return F.aggregate(
            places,
            F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
            lambda a, p: F.struct((p + 3).alias("end"), (a["n"] + p + 3 - F.greatest(a["end"], p)).alias("n")),
            lambda a: a["n"],
        )

    def windows(h: Column) -> Column:
        return F.when(F.size(h) < 3, F.array().cast("array<bigint>")).otherwise(F.transform(F.slice(h, F.lit(1), F.size(h) - 2), lambda x, i: F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2))))

    hashed = F.transform(words, lambda w: F.xxhash64(w))
    any_repeat = lambda t: F.when(F.size(F.array_distinct(t)) == F.size(t), F.lit(0)).otherwise(covered(t))
    return let(let(hashed, windows), any_repeat).cast("long")


def n_dup_lines(text: Column) -> Column:
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: F.btrim(x, F.lit(ASCII_SPACE)) != "")
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def features(text: Column, buckets: int = BUCKETS) -> Column:
    """Buckets of the 1-grams of a text's tokens, in the lower half, and of their 2-grams, in the upper one."""
    half = F.lit(buckets // 2)
    hashes = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0)), lambda w: F.xxhash64(w))

    def grams(h: Column) -> Column:
        single = F.transform(h, lambda x: F.pmod(x, half).cast("int"))
        pairs = F.when(F.size(h) < 2, F.array().cast("array<int>")).otherwise(F.transform(F.slice(h, F.lit(1), F.size(h) - 1), lambda x, i: (half + F.pmod(F.xxhash64(x, F.get(h, i + 1)), half)).cast("int")))
        return F.concat(single, pairs)

    return let(hashes, grams)


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Documents of the trusted target: labelled good, not toxic. Once each, however often labelled."""
    return labels.filter("quality = 1 and coalesce(toxic, 0) = 0").select(F.col("doc_id").alias("__trusted")).distinct()


def fit_weights(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, smoothing: float = SMOOTHING) -> list[float]:
    """log(p_target / p_raw) per bucket, both multinomials counted over whole tables.

    Raw counts are scaled to the target's total, and both get the same pseudo-count: a bucket that is rare in the raw
    corpus weighs about 0 whether the target has it or not, one that is frequent there and missing in the target weighs
    much below 0. The counts are sums per bucket, partial before the shuffle; `buckets` rows reach the driver.
    Without any trusted document all weights are 0.
    """
    trusted = materialize(trusted_ids(labels), "trusted")
    if trusted.count() <= BROADCAST_IDS:  # 16 MB of identifiers, so that texts stay where they are; else shuffled
        trusted = F.broadcast(trusted)
    marked = docs.select("doc_id", "text").join(trusted, F.col("doc_id") == F.col("__trusted"), "left")
    grams = marked.select(F.col("__trusted").isNotNull().cast("long").alias("t"), F.explode(features(F.col("text"), buckets)).alias("bucket"))
    target, raw = [0] * buckets, [0] * buckets
    for r in grams.groupBy("bucket").agg(F.sum("t").alias("target"), F.count("*").alias("raw")).collect():
        target[r["bucket"]], raw[r["bucket"]] = r["target"], r["raw"]
    share = sum(target) / max(1, sum(raw))
    if not share:
        return [0.0] * buckets
    return [math.log((t + smoothing) / (r * share + smoothing)) for t, r in zip(target, raw, strict=True)]


def score(docs: DataFrame, labels: DataFrame, *, threshold: float = THRESHOLD, buckets: int = BUCKETS, smoothing: float = SMOOTHING, min_words: int = MIN_WORDS) -> DataFrame:
    """Columns of docs plus n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, llr, base_failed, kept.

    llr: sum of the weights of a document's n-grams (n = 1, 2; see TOKEN) over their number (0 without any). kept: not base_failed
    and llr >= threshold. Null or blank text: no words, so base_failed. Repeated rows count as often as they
    occur and get equal results. Empty tables give empty results. Columns named as the new ones are replaced.
    """
    new = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "llr", "base_failed", "kept")
    docs = docs.drop(*new)
    weights = fit_weights(docs, labels, buckets, smoothing)
    # A constant array of fixed length in the plan (folded once), so that no join is needed.
    table = F.split(F.lit(",".join(map(repr, weights))), ",").cast("array<double>")
    text = F.coalesce(F.col("text"), F.lit(""))
    total = lambda f: F.try_divide(F.aggregate(f, F.lit(0.0), lambda a, x: a + F.get(table, x)), F.size(f).cast("double"))
    measured = lambda w: F.struct(F.size(w).cast("long").alias("n_words"), n_repeat_words(w).alias("n_repeat_words"))
    out = docs.withColumn("__m", let(split_words(F.col("text")), measured)).select(
        "*",
        "__m.*",
        F.coalesce(let(features(F.col("text"), buckets), total), F.lit(0.0)).alias("llr"),
        F.length(F.regexp_replace(text, SPACE, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        n_dup_lines(F.col("text")).alias("n_dup_lines"),
    )
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.drop("__m").withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= threshold))
