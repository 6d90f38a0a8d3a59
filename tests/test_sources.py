import json

from pyspark.sql import functions as F

from barriometrics import schemas
from barriometrics.sources import readers, writers


def test_csv_with_breaks_and_quotes(spark, tmp_path):
    rows = [("u", "1", "$ 850.000", None, None, "Núñez, CABA", "45 m²", 'dos\nlineas, "comillas"')]
    path = str(tmp_path / "raw")
    writers.write_raw_csv(spark.createDataFrame(rows, schemas.RAW_Z), path)
    assert [tuple(r) for r in readers.scan_raw_csv(spark, path).collect()] == rows


def test_snapshot_date_from_file_name(spark, tmp_path):
    path = tmp_path / "zonaprop_04022025.csv"
    path.write_text(",".join(schemas.RAW_Z.fieldNames()) + "\nu,1,$ 1,,,x,y,z\n", encoding="utf-8")
    row = readers.scan_raw_csv(spark, str(path), with_date=True).first()
    assert str(row["snapshot_date"]) == "2025-02-04" and row["zonaprop_code"] == "1"


def test_feature_lists(spark):
    texts = ["['45 m² cubie.', '2 ambientes']", '["1 baño"]', "[]", None]
    df = spark.createDataFrame([(t,) for t in texts], "features string")
    assert [r["features"] for r in readers.parse_feature_list(df).collect()] == [["45 m² cubie.", "2 ambientes"], ["1 baño"], [], None]


def test_kv_items(spark, tmp_path):
    path = tmp_path / "items.json"
    path.write_text(json.dumps({"code": {"S": "1"}, "rooms": {"N": "2"}}) + "\n" + json.dumps({"code": {"S": "2"}}) + "\n", encoding="utf-8")
    out = readers.scan_kv_items(spark, str(path), ["code", "rooms"]).orderBy("code").collect()
    assert [tuple(r) for r in out] == [("1", "2"), ("2", None)]


def test_upsert(spark):
    current = spark.createDataFrame([("1", "2025-01-01", "old"), ("2", "2025-01-01", "stays")], "code string, at string, v string")
    incoming = spark.createDataFrame([("1", "2025-02-01", "new"), ("3", "2025-02-01", "added")], "code string, at string, v string")
    out = writers.upsert_by_key(current, incoming, "code", "at").collect()
    assert {r["code"]: r["v"] for r in out} == {"1": "new", "2": "stays", "3": "added"}


def test_snapshot_rewrite_replaces_one_date(spark, tmp_path):
    path = str(tmp_path / "stage")
    write = lambda rows: writers.write_snapshot(spark.createDataFrame(rows, "v int, snapshot_date string"), path)
    write([(1, "2025-01-01"), (2, "2025-02-01")])
    write([(3, "2025-02-01")])
    assert sorted(r["v"] for r in spark.read.parquet(path).collect()) == [1, 3]


def test_month_folder_is_replaced(spark, tmp_path):
    path = str(tmp_path / "kpi")
    table = lambda *names: spark.createDataFrame([(n, 1, 2) for n in names], "neighborhood string, total int, average_price_neighborhood int")
    writers.write_kpi_json(table("PALERMO", "RETIRO"), path, "01_2025")
    writers.write_kpi_json(table("PALERMO"), path, "02_2025")
    writers.write_kpi_json(table("PALERMO"), path, "01_2025")
    out = spark.read.json(path).select("month", "neighborhood", "average_price_neighborhood").collect()
    assert sorted(tuple(r) for r in out) == [("01_2025", "PALERMO", "2"), ("02_2025", "PALERMO", "2")]


def test_reports_share_an_id(spark, tmp_path):
    requests = spark.createDataFrame([(1, "PALERMO"), (2, "RETIRO")], "request_id int, neighborhood string")
    answers = requests.select("request_id", F.lit(5).alias("total"))
    ids = {r["request_id"]: r["report_id"] for r in writers.write_report(requests, answers, str(tmp_path / "r")).collect()}
    for kind in ("input_data", "output_data"):
        stored = spark.read.json(str(tmp_path / "r" / kind)).collect()
        assert {r["request_id"]: r["report_id"] for r in stored} == ids
