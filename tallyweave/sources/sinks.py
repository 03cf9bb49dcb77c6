"""Sinks: bronze, reports and typed exports; layers and checkpoints are written by layers.refresh()."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.functions.text import nullif_blank, trimmed


def bronze_table(df: DataFrame, path: str) -> None:
    """Without rows that repeat in all columns."""
    df.dropDuplicates().write.mode("overwrite").parquet(path)


def report_by_kpi(df: DataFrame, path: str, column: str = "kpi_component") -> None:
    df.write.mode("overwrite").partitionBy(column).parquet(path)


def typed(df: DataFrame, dates: list[str], numbers: list[str], links: list[str] = ()) -> DataFrame:
    """Text columns as dates (ISO form alone), numbers (commas between digits and blanks around them do not count) and links without blanks
    around them. What is none becomes null; other columns stay as they are, and columns that df lacks are passed over."""
    there = lambda names: [c for c in names if c in df.columns]
    plain = lambda c: F.replace(trimmed(F.col(c).cast("string")), F.lit(","), F.lit(""))
    cols = {c: F.try_to_date(F.when(F.col(c).cast("string").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.col(c).cast("string")), "yyyy-MM-dd") for c in there(dates)}
    return df.withColumns(cols | {c: plain(c).try_cast("double") for c in there(numbers)} | {c: nullif_blank(trimmed(F.col(c))) for c in there(links)})


def verified(df: DataFrame, billed: str, factor: str, reported: str) -> DataFrame:
    """Recalculated kWh and its difference from what is reported."""
    again = F.col(billed) * F.col(factor)
    return df.withColumn("Recalculated kWh", again).withColumn("Difference kWh", again - F.col(reported))


def write_texts(df: DataFrame, folder: str, name: str, text: str) -> int:
    """A file for each row under a folder that all tasks share: name is unique there, text its content. Returns how many.

    Tasks write by themselves, under final names, so one that runs again writes the same: Spark's writers have a folder, a rename and, where files are
    local, several processes for each file.
    """

    def each(batches):
        import pandas as pd
        from pyarrow import fs

        files, base = fs.FileSystem.from_uri(folder)
        files.create_dir(base, recursive=True)
        for batch in batches:
            for file, content in zip(batch["name"], batch["text"], strict=True):
                with files.open_output_stream(f"{base}/{file}") as out:
                    out.write(content.encode())
            yield pd.DataFrame({"n": [len(batch)]})

    rows = df.select(F.col(name).alias("name"), F.col(text).alias("text"))
    return rows.mapInPandas(each, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
