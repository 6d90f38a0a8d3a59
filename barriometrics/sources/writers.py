"""Writing snapshots, key-value tables and reports. Every write is one distributed job."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from barriometrics.operators.crawl import latest_per_code


def write_snapshot(df: DataFrame, path: str, date: str = "snapshot_date") -> str:
    """One folder per snapshot date; rewriting a date replaces only that folder."""
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(date).parquet(path)
    return path


def write_raw_csv(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    return path


def write_kv_items(df: DataFrame, path: str) -> str:
    """One JSON item per row with every value as text."""
    item = F.to_json(F.struct(*[F.struct(F.coalesce(F.col(c).cast("string"), F.lit("nan")).alias("S")).alias(c) for c in df.columns]))
    df.select(item.alias("value")).write.mode("overwrite").text(path)
    return path


def upsert_by_key(current: DataFrame | None, incoming: DataFrame, code: str, loaded_at: str) -> DataFrame:
    """The table after the incoming rows are put: the last write per listing code stays."""
    rows = incoming if current is None else current.unionByName(incoming, allowMissingColumns=True)
    return latest_per_code(rows, code, loaded_at)


def write_kpi_json(kpis: DataFrame, path: str, month: str) -> str:
    """KPI rows as JSON under month=MM_YYYY/neighborhood=...; a month's folders are replaced."""
    money = [c for c in ("average_price_neighborhood", "min_price_neighborhood", "max_price_neighborhood") if c in kpis.columns]
    rows = kpis.withColumns({c: F.col(c).cast("string") for c in money})
    return _write_month(rows, path, month)


def write_trends_json(documents: DataFrame, path: str, month: str) -> str:
    return _write_month(documents, path, month)


def _write_month(rows: DataFrame, path: str, month: str) -> str:
    """The month's folder is replaced as a whole, so names that dropped out do not stay behind."""
    writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("neighborhood")
    writer.json(f"{path}/month={month}")
    return path


def write_report(requests: DataFrame, answers: DataFrame, path: str) -> DataFrame:
    """Inputs and answers of each request as JSON under its report id; returns the ids.

    The id is a digest of the request, so a retried task writes the same report again.
    """
    report_id = F.md5(F.to_json(F.struct(*requests.columns)))
    ids = requests.select("request_id", report_id.alias("report_id"))
    requests.withColumn("report_id", report_id).write.mode("overwrite").json(f"{path}/input_data")
    answers.join(ids, "request_id").write.mode("overwrite").json(f"{path}/output_data")
    return ids
