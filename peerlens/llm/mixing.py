"""Mixing sources to target weights: seeded Bernoulli repetition by source rates. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, n_words_of

SEED = "mix-1"
BROADCAST_SOURCES = 200_000


def source_targets(sizes: DataFrame, weights: list[float], total_share: float, max_repeat: float) -> DataFrame:
    """(source, source_size, target): targets by weight, none above max_repeat times its source.

    Sources come in code-point order, null last, and take the weights in turn. The reshared excess ends
    where every uncapped source has the same target per unit of weight, so instead of resharing round by
    round the sources are sorted by the level at which each one caps and the level is read off prefix sums.
    The table has a row per source; its windows never see documents.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    ring = F.array(*[F.lit(float(w)) for w in weights])
    per = per.withColumn("w", ring[(F.row_number().over(order) - 1) % len(weights)])
    by_cap = Window.orderBy((F.col("source_size") / F.col("w")), F.col("source").isNull(), F.col("source"))
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    level = per.select(
        "*",
        F.coalesce(F.sum("source_size").over(before), F.lit(0)).alias("size_below"),
        F.coalesce(F.sum("w").over(before), F.lit(0.0)).alias("w_below"),
        F.sum("source_size").over(everything).alias("size_all"),
        F.sum("w").over(everything).alias("w_all"),
    ).select(
        "*",
        (F.lit(float(total_share)) * F.col("size_all") - F.lit(float(max_repeat)) * F.col("size_below")).alias("rest"),
        (F.col("w_all") - F.col("w_below")).alias("w_rest"),
        (F.lit(float(max_repeat)) * F.col("source_size")).alias("cap"),
    )
    # The first source, in order of capping, whose share stays within its cap sets the level for all after it.
    stays = F.col("rest") * F.col("w") <= F.col("cap") * F.col("w_rest")
    level = level.withColumn("at", F.min(F.when(stays, F.struct(F.col("source_size") / F.col("w"), F.col("size_below"), F.col("rest"), F.col("w_rest")))).over(everything))
    share = F.col("at.rest") * F.col("w") / F.col("at.w_rest")
    return level.select("source", "source_size", F.coalesce(F.least(share, F.col("cap")), F.col("cap")).alias("target"))


def uniform(doc_id: Column, text: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) from the id and the whole text: 48 bits of an MD5."""
    key = F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit("|"), F.md5(F.coalesce(text, F.lit(""))), F.lit(f"|{seed}"))
    return F.conv(F.substring(F.md5(key), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def mix(docs: DataFrame, *, weights: list[float] = (5.0, 2.0, 1.0), total_share: float = 1.5, max_repeat: float = 2.0, seed: str = SEED) -> DataFrame:
    """Columns of docs plus size, source_size, target and copies: how often the mix takes the document.

    copies = floor(rate) plus one Bernoulli copy with probability rate - floor(rate), rate = target / source_size. The
    draw is seeded by doc_id and text, so different texts that share a null or repeated doc_id draw on their own. Rows
    equal in both draw the same copies: a source of nothing but k equal rows is off its target by up to one copy of
    each. Null or empty text: size 0. Null source: a source of its own, last. Sources of size 0 have target 0 and
    copies 0. An empty table gives an empty result. Columns of docs named size, source_size, target or copies are
    replaced; all others are kept, whatever their names, but for those that begin with two underscores and `mix`.

    A hot source costs nothing: sums are partial before the shuffle, and the table of sources (a row each) is
    broadcast while its counted rows are few; beyond, Spark joins by source and splits skewed keys.
    """
    docs = docs.drop("size", "source_size", "target", "copies")
    sized = docs.withColumn("size", n_words_of(F.col("text")))
    targets = source_targets(sized.select("source", "size"), list(weights), total_share, max_repeat).withColumnRenamed("source", "__mix_source")
    targets = materialize(targets, "targets")
    if targets.count() <= BROADCAST_SOURCES:  # some 50 bytes each, so that texts stay where they are; else shuffled
        targets = F.broadcast(targets)
    rate = F.coalesce(F.try_divide(F.col("target"), F.col("source_size")), F.lit(0.0))
    joined = sized.join(targets, F.col("source").eqNullSafe(F.col("__mix_source")), "left").drop("__mix_source")
    extra = (uniform(F.col("doc_id"), F.col("text"), seed) < rate - F.floor(rate)).cast("long")
    return joined.withColumn("copies", F.floor(rate).cast("long") + extra)


def repeat_copies(mixed: DataFrame, number: str | None = "copy") -> DataFrame:
    """One row for each copy that the mix takes. number: a column that numbers a document's copies from 1; None for no
    such column. A column of that name is an error, as its values would be lost."""
    if number is None:
        return mixed.filter("copies > 0").withColumn("__mix_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).drop("__mix_copy")
    if number in mixed.columns:
        raise ValueError(f"there is a column {number} already; give another name or None")
    return mixed.filter("copies > 0").withColumn(number, F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))


def repeat_documents(docs: DataFrame, **how) -> DataFrame:
    """The rows of docs, each as often as the mix takes it: the columns of docs and no other, with their own values."""
    own = docs.select(F.struct("*").alias("__mix_row"), "doc_id", "source", "text")
    return repeat_copies(mix(own, **how), None).select("__mix_row.*")
