"""Rules that rows must keep: rows that break one are set aside with its name, or fail the job."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.functions.text import own_columns

#: Offenders named in the message of a failed job.
NAMED = 5


def faults(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """df with faults, the names of the rules (conditions that a good row meets) that a row breaks; a null condition is a broken one."""
    own_columns(df)
    broken = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]
    return df.withColumn("faults", F.array_compact(F.array(*broken)))


def quarantined(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(rows that keep all rules, rows that do not with their faults)."""
    rows = faults(df, rules)
    return rows.where(F.size("faults") == 0).drop("faults"), rows.where(F.size("faults") > 0)


def enforced(df: DataFrame, rules: dict[str, Column], key: str) -> DataFrame:
    """df as it is, if every row keeps all rules; else the job that reads it fails and names the first offender that a task meets.

    The check is part of the plan: it costs no pass of its own, and no column of df can be read without it.
    """
    rows = faults(df, rules)
    message = F.concat(F.lit("row "), F.coalesce(F.col(key).cast("string"), F.lit("without an id")), F.lit(": "), F.array_join("faults", ", "))
    return rows.where(F.when(F.size("faults") == 0, F.lit(True)).otherwise(F.raise_error(message).cast("boolean"))).drop("faults")


def refused(df: DataFrame, rules: dict[str, Column], key: str) -> None:
    """Raises ValueError with how many rows break each rule, and the smallest keys of some; a whole pass before anything is written."""
    found = quarantined(df, rules)[1].select(F.explode("faults").alias("fault"), F.col(key).cast("string").alias("k"))
    rank = F.row_number().over(Window.partitionBy("fault").orderBy(F.asc_nulls_last("k")))
    named = found.groupBy("fault", "k").count().withColumn("n", rank)
    rows = named.groupBy("fault").agg(F.sum("count").alias("rows"), F.array_sort(F.collect_list(F.when(F.col("n") <= NAMED, F.col("k")))).alias("first")).orderBy("fault").collect()
    if rows:
        raise ValueError("; ".join(f"{r['fault']}: {r['rows']} rows, first {', '.join(r['first'])}" for r in rows))


def unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """df with is_unique, whether no other row has the same keys: counts are joined back, and only those above one."""
    own_columns(df)
    again = df.groupBy(*(F.col(k).alias(f"_tw_{k}") for k in keys)).agg(F.count("*").alias("_tw_n")).where("_tw_n > 1")
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_tw_{k}")) for k in keys))
    return df.join(again, same, "left").select(*df.columns, F.col("_tw_n").isNull().alias("is_unique"))
