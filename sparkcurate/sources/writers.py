"""Writers. Records are written as JSON lines by all tasks; nothing is gathered to form one file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    """JSON lines; null fields are written as null. Appending adds files to the folder."""
    df.write.mode("append" if append else "overwrite").option("ignoreNullFields", "false").json(path)


def write_parquet(df: DataFrame, path: str) -> None:
    """Held-out split or any other table for later runs."""
    df.write.mode("overwrite").parquet(path)


def save_table(df: DataFrame, name: str, append: bool = True) -> None:
    df.write.mode("append" if append else "overwrite").saveAsTable(name)


def save_part(df: DataFrame, name: str, part: str) -> None:
    """Replace the partitions of a table that ``df`` has rows of, by column ``part``; a missing table is made."""
    spark = df.sparkSession
    if not spark.catalog.tableExists(name):
        df.write.partitionBy(part).saveAsTable(name)
        return
    # The mode is a setting of the session only; without it all partitions would go.
    setting = "spark.sql.sources.partitionOverwriteMode"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "dynamic")
    try:
        df.select(*spark.table(name).columns).write.mode("overwrite").insertInto(name)
    finally:
        spark.conf.set(setting, before)


def write_collected(papers: DataFrame, path: str) -> None:
    """Paper metadata without the full text."""
    write_jsonl(papers.drop("full_text"), path)


def write_report(header: DataFrame, rows: dict[str, DataFrame], path: str) -> None:
    """A report as a folder: a one-row ``header`` and one JSON-lines folder per row set.

    The row sets grow with the data, so they are not nested into a single document.
    """
    write_jsonl(header, f"{path}/header")
    for name, df in rows.items():
        write_jsonl(df, f"{path}/{name}")


def as_json(df: DataFrame) -> DataFrame:
    """One JSON document per row, null fields included."""
    whole: Column = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    return df.select(F.to_json(whole, {"ignoreNullFields": "false"}).alias("value"))
