import random
from itertools import groupby

from pyspark.sql import functions as F

from barriometrics.operators import crawl, neighborhoods, snapshots


def test_repeated_pages_against_a_loop(spark):
    rng = random.Random(2)
    rows = []
    for barrio in "abc":
        page = 0
        for _ in range(60):
            page += rng.choice([1, 1, 700])  # crosses range borders and leaves gaps
            rows.append((barrio, page, rng.choice([[], ["1"], ["1", "2"]])))
    expected = {}
    for barrio, pages in groupby(rows, key=lambda r: r[0]):
        seen, run = None, 0
        for _, page, ids in pages:
            repeated = bool(ids) and ids == seen
            run = run + 1 if repeated else 0
            if not repeated:
                seen = ids
            expected[barrio, page] = (repeated, run >= 2)
    df = spark.createDataFrame(rows, "barrio string, page int, ids array<string>")
    out = {(r["barrio"], r["page"]): (r["repeated"], r["stops"]) for r in crawl.repeated_pages(df).collect()}
    assert out == expected
    kept = crawl.keep_before_stop(crawl.repeated_pages(df), F.col("stops")).count()
    cut = {b: min([p for (bb, p), v in expected.items() if bb == b and v[1]], default=10**9) for b in "abc"}
    assert kept == sum(p < cut[b] for b, p in expected)


def test_past_the_end(spark):
    rows = [("a", 1, "h"), ("a", 2, "h?pagina-2"), ("a", 3, "h?pagina-2"), ("a", 4, "h?pagina-4"), ("b", 2, "h")]
    df = spark.createDataFrame(rows, "barrio string, page int, url string")
    kept = crawl.keep_before_stop(df, crawl.past_the_end(F.col("page"), F.col("url")))
    assert sorted((r["barrio"], r["page"]) for r in kept.collect()) == [("a", 1), ("a", 2)]


def test_first_and_latest(spark):
    rows = [("x", 2, "late"), ("x", 1, "early"), (None, 1, "n1"), (None, 2, "n2"), ("y", 1, "only")]
    df = spark.createDataFrame(rows, "code string, t int, v string")
    assert {r["code"]: r["v"] for r in crawl.first_per_code(df, "code", ["t"]).collect()} == {"x": "early", None: "n1", "y": "only"}
    assert {r["code"]: r["v"] for r in crawl.latest_per_code(df, "code", "t").collect()} == {"x": "late", None: "n2", "y": "only"}
    assert tuple(crawl.dedup_report(df, "code").first()) == (5, 3)


def test_snapshot_changes(spark):
    old = spark.createDataFrame([("p", "1"), ("p", "1"), ("p", "2"), ("q", "3")], "neighborhood string, code string")
    new = spark.createDataFrame([("p", "2"), ("p", "4"), ("p", "4"), ("q", "1")], "neighborhood string, code string")
    city = snapshots.change_counts(snapshots.code_presence(old, new)).first()
    assert (city["new_rows"], city["removed_rows"], city["new_codes"], city["removed_codes"]) == (2, 1, 1, 1)
    local = {r["neighborhood"]: r for r in snapshots.change_counts(snapshots.code_presence(old, new, by=["neighborhood"]), ["neighborhood"]).collect()}
    assert (local["p"]["new_rows"], local["p"]["removed_rows"], local["p"]["old_codes"]) == (2, 2, 2)
    assert (local["q"]["new_codes"], local["q"]["removed_codes"]) == (1, 1)
    assert sorted(r["code"] for r in snapshots.only_in(new, old).collect()) == ["4", "4"]


def test_latest_snapshots_and_dates(spark):
    rows = [("z", "d/x_04022025.csv"), ("z", "d/x_05022025.csv"), ("z", "d/x_01032025.csv"), ("a", "d/y_31012025.csv"), ("a", "odd.csv")]
    df = spark.createDataFrame(rows, "source string, path string").withColumn("snapshot_date", snapshots.snapshot_date(F.col("path")))
    kept = snapshots.latest_snapshots(df, 2)
    assert sorted(str(r["snapshot_date"]) for r in kept.collect()) == ["2025-01-31", "2025-02-05", "2025-03-01"]
    month = spark.createDataFrame([("h_202501.xlsx",)], "p string").select(snapshots.snapshot_month(F.col("p")).alias("m"))
    assert str(month.first()["m"]) == "2025-01-01"


def test_neighborhood_mapping(spark):
    names = {
        "Palermo": "PALERMO", "Núñez": "NUNEZ", "Microcentro": "SAN NICOLAS", "La Boca": "SAN TELMO", "Temperley": "FLORES",
        "Abasto": "CABALLITO", "Villa Devoto": "VILLA CRESPO", "Otro": "RETIRO", "Puerto Retiro": "PUERTO MADERO", "Qqqq": "OTRO", None: None,
    }
    df = spark.createDataFrame([(n,) for n in names] * 2, "neighborhood string")
    out = neighborhoods.map_neighborhood(df, into="mapped").collect()
    assert {r["neighborhood"]: r["mapped"] for r in out} == names and len(out) == 2 * len(names)
    short = neighborhoods.map_neighborhood(df, into="mapped", long_aliases=False)
    assert {r["neighborhood"]: r["mapped"] for r in short.collect()}["La Boca"] == "OTRO"
    kept = neighborhoods.drop_unmapped(short, "mapped")
    assert kept.filter("neighborhood is null or neighborhood = 'La Boca'").count() == 0
