"""Writes: upsert, replace, append, insert-if-absent, dimension keys, season tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(current: DataFrame, incoming: DataFrame, keys: list[str], update: list[str], order: Column | None = None) -> DataFrame:
    """current with incoming rows merged in: listed columns are replaced, others keep their old values.

    Incoming rows of one key count by the last in order, by a hash of all their columns without one or where it ties,
    so that reruns agree. Rows of new keys come in whole.
    """
    cols = current.columns
    last = Window.partitionBy(*keys).orderBy(*([order] if order is not None else []), F.xxhash64(*incoming.columns))
    new = incoming.withColumn("__r", F.row_number().over(last)).withColumn("__n", F.count("*").over(Window.partitionBy(*keys))).filter("__r = __n").drop("__r", "__n")
    joined = current.select(F.struct(*cols).alias("o"), *keys).join(new.select(F.struct(*cols).alias("i"), *keys), keys, "full_outer")
    pick = lambda c: F.when(F.col("i").isNull(), F.col(f"o.{c}")).when(F.col("o").isNull(), F.col(f"i.{c}")).otherwise(F.col(f"i.{c}") if c in update or c in keys else F.col(f"o.{c}"))
    return joined.select(*[pick(c).alias(c) for c in cols])


def replace_partitions(rows: DataFrame, path: str, by: list[str]) -> None:
    """Delete-and-insert by partition: only the partitions in rows are rewritten."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def new_rows(current: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Incoming rows of keys that current lacks, one per key."""
    return incoming.dropDuplicates(keys).join(current.select(*keys), keys, "left_anti")


def get_or_create(dimension: DataFrame, incoming: DataFrame, natural: str, key: str = "id") -> DataFrame:
    """dimension with an id for every natural key of incoming; ids are hashes, so no counter serialises the write."""
    new = incoming.select(natural).filter(F.col(natural).isNotNull()).distinct().join(dimension.select(natural), natural, "left_anti")
    return dimension.select(key, natural).unionByName(new.select(F.xxhash64(natural).alias(key), natural))


def write_season_tables(tables: dict[str, DataFrame], folder: str) -> None:
    """Write what `season_tables` returns under folder: seasons of the derived tables are replaced, observations are added.

    Observations lie by run, and a run that is written again replaces itself, so a repeated job adds nothing twice.
    """
    for name in ("team_stats", "season_stats", "positions"):
        replace_partitions(tables[name], f"{folder}/{name}", ["season_id"])
    replace_partitions(tables["observations"], f"{folder}/observations", ["run"])
