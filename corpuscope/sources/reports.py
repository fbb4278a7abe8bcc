"""Report sink: one Parquet table per name, all of a report or none."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpuscope.sources import versions


def write_report_tables(tables: dict[str, DataFrame], folder: str) -> None:
    """Writes a report's tables and then makes them the current ones, all at once.

    If one fails, readers go on with the report that was there. The report before the
    last one is removed; a reader that has just opened it may finish.
    """
    if not tables:
        return
    spark = next(iter(tables.values())).sparkSession
    while True:
        number, what = versions.current(spark, folder)
        name = versions.new_folder()
        for table, df in tables.items():
            df.write.parquet(f"{folder.rstrip('/')}/{name}/{table}")
        try:
            versions.commit(spark, folder, number + 1, {"folder": name, "tables": list(tables), "before": what.get("folder")})
            break
        except versions.Taken:
            versions.drop_folder(spark, folder, name)
    if what.get("before"):
        versions.drop_folder(spark, folder, what["before"])


def read_report_table(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """A table of the current report."""
    number, what = versions.current(spark, folder)
    if not number:
        raise FileNotFoundError(f"no report in {folder}")
    return spark.read.parquet(f"{folder.rstrip('/')}/{what['folder']}/{table}")
