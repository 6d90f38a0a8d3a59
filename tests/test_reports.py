"""Trends, places, evaluation and writers against plain Python on small tables."""

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from barriometrics.operators import evaluation, metrics, places, trend_texts, trends
from barriometrics.operators.cleaning import one_hot_neighborhood

COLUMNS = "code string, neighborhood string, price double, total_area double, rooms double, bathrooms double, garages double"


def listings(seed, names, n):
    rng = random.Random(seed)
    return [
        (str(rng.randint(0, 60)), rng.choice(names), float(rng.randint(2000, 9000)), float(rng.randint(15, 110)),
         float(rng.randint(1, 5)), float(rng.randint(1, 2)), float(rng.randint(0, 1)))
        for _ in range(n)
    ]


@pytest.fixture(scope="module")
def snapshots_(spark):
    old = listings(1, ["PALERMO", "RETIRO", "FLORES", "DEVOTO"], 120)
    new = listings(2, ["PALERMO", "RETIRO", "FLORES", "RECOLETA", "NUNEZ"], 150) + [("900", "SAN TELMO", 5000.0, 40.0, 2.0, 1.0, 0.0)]
    return old, new, spark.createDataFrame(old, COLUMNS), spark.createDataFrame(new, COLUMNS)


def mean(values):
    values = list(values)
    return sum(values) / len(values) if values else None


def test_trend_facts_against_plain_python(snapshots_):
    old, new, df_old, df_new = snapshots_
    facts = {r["neighborhood"]: r for r in trends.trend_facts(df_old, df_new).collect()}
    assert set(facts) == {r[1] for r in new}
    city = mean(r[2] / r[3] for r in new)
    sizes = Counter(r[1] for r in new)
    for name, row in facts.items():
        o, n = [r for r in old if r[1] == name], [r for r in new if r[1] == name]
        avg_old, avg_new = mean(r[2] for r in o) or 0, mean(r[2] for r in n)
        assert row["price_change"] == pytest.approx((avg_new - avg_old) / avg_old * 100 if avg_old else 0)
        assert row["m2_diff"] == pytest.approx((mean(r[2] / r[3] for r in n) - city) / city * 100)
        assert row["growth_rate"] == pytest.approx((len(n) - len(o)) / len(o) * 100 if o else 0)
        old_codes, new_codes = {r[0] for r in o}, {r[0] for r in n}
        assert (row["new_codes"], row["removed_codes"]) == (len(new_codes - old_codes), len(old_codes - new_codes))
        by_rooms = Counter(r[4] for r in n)
        ranked = sorted(by_rooms, key=lambda k: (-by_rooms[k], k))
        assert (row["top_rooms"], row["top_n"]) == (ranked[0], by_rooms[ranked[0]])
        assert row["rare_rooms"] == min(by_rooms, key=lambda k: (by_rooms[k], k))
        assert row["inventory_summary"] == ", ".join(f"{int(k)} amb: {by_rooms[k]}" for k in sorted(by_rooms)[:3])
        others = sorted((m for m in sizes if m != name), key=lambda m: (-sizes[m], m))[:3]
        rivals = mean(mean(r[2] for r in new if r[1] == m) for m in others)
        assert row["competitive_position"] == pytest.approx((avg_new - rivals) / rivals * 100)
        cheapest = sorted(r[2] / r[3] for r in n)[: len(n) // 4]
        assert row["best_value_avg"] == (pytest.approx(mean(cheapest)) if cheapest else None)
        prices = sorted(r[2] for r in n)
        at = (len(n) - 1) * 0.25
        edge = prices[math.floor(at)] + (prices[math.ceil(at)] - prices[math.floor(at)]) * (at - math.floor(at))
        assert (row["deals"], row["price_threshold"]) == (sum(p <= edge for p in prices), pytest.approx(edge))
        bands = Counter(sum(r[3] >= e for e in (30, 50, 80)) for r in n)
        assert row["top_band"] == min(bands, key=lambda b: (-bands[b], b)) and row["bands_in_use"] == len(bands)
        assert row["premium_pct"] == pytest.approx(100 * sum(r[5] > 1 or r[6] > 0 for r in n) / len(n))


def test_trend_texts(snapshots_):
    _, new, df_old, df_new = snapshots_
    facts = trends.trend_facts(df_old, df_new)
    rows = trend_texts.trend_rows(facts).collect()
    assert len(rows) == 15 * len({r[1] for r in new})
    assert all(r["title"] and r["description"] and r["value"] for r in rows)
    assert len({r["metric_type"] for r in rows}) == 15
    single = {r["metric_type"]: r for r in rows if r["neighborhood"] == "SAN TELMO"}
    assert single["price_trend"]["value"] == "+0.0%" and "s/d" in single["price_per_m2_trend"]["description"]
    assert single["competition"]["value"] == "1 propiedades"
    documents = trend_texts.trend_documents(facts, "2025-03-09").collect()
    assert {d["date"] for d in documents} == {"03_2025"}
    assert [t["metric_type"] for t in documents[0]["agent_trends"]] == [
        "market_growth", "price_segmentation", "competitive_position", "inventory", "price_per_m2_trend",
    ]


def test_kpi_report_has_all_names(snapshots_):
    _, new, df_old, df_new = snapshots_
    report = {r["neighborhood"]: r for r in metrics.kpi_report(df_old, df_new).collect()}
    assert len(report) == 19 and report["DEVOTO"]["removed_properties_since_last_report_neighborhood"] == 0
    flores = [r[2] for r in new if r[1] == "FLORES"]
    assert report["FLORES"]["average_price_neighborhood"] == int(mean(flores))
    assert report["PALERMO"]["total_properties"] == len(new)


def brute_near(requests, spots, radius):
    out = set()
    for rid, la, lo in requests:
        for pid, pla, plo in spots:
            h = (math.sin(math.radians(pla - la) / 2) ** 2
                 + math.cos(math.radians(la)) * math.cos(math.radians(pla)) * math.sin(math.radians(plo - lo) / 2) ** 2)
            if 2 * 6371000.0 * math.asin(math.sqrt(h)) <= radius:
                out.add((rid, pid))
    return out


@pytest.mark.parametrize("latitude,hot", [(-34.6, 10**6), (-34.6, 20), (78.0, 10**6)])
def test_near_against_all_pairs(spark, monkeypatch, latitude, hot):
    monkeypatch.setattr(places, "HOT_CELL_ROWS", hot)
    rng = random.Random(4)
    spot = lambda: (latitude + rng.uniform(-0.02, 0.02), -58.4 + rng.uniform(-0.05, 0.05))
    requests = [(i, *spot()) for i in range(60)]
    spots = [(i, *spot()) for i in range(150)] + [(1000 + i, latitude + i * 1e-6, -58.4) for i in range(120)]
    found = places.near(
        spark.createDataFrame(requests, "request_id int, lat double, lon double"),
        spark.createDataFrame(spots, "place_id int, lat double, lon double"),
    )
    pairs = [(r["request_id"], r["place_id"]) for r in found.collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == brute_near(requests, spots, 500)


def test_place_groups(spark):
    rows = [({"amenity": "cafe", "name": "x"}, 1.0, 2.0), ({"name": "Línea D"}, None, 2.0), ({}, 1.0, 1.0), ({"amenity": "bank"}, 1.0, 1.0), ({"amenity": "clinic"}, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "tags map<string,string>, lat double, lon double")
    assert {r["place_group"]: r["total"] for r in places.group_totals(df).collect()} == {
        "transporte": 1, "sitios_interes": 0, "edificios_administrativos": 0, "instituciones_educativas": 0, "centros_salud": 1, "restaurantes": 1,
    }
    by_amenity = places.places_by_amenity(df).collect()
    assert Counter(r["amenity"] for r in by_amenity)["Desconocido"] == 2
    assert {r["total"] for r in by_amenity if r["amenity"] == "Desconocido"} == {2}


def test_deviation_classes_are_right_closed(spark):
    values = [-1000.0, -50.0, -49.9, -40.0, 0.0, 0.1, 10.0, 50.0, 50.1, None]
    df = spark.createDataFrame([("X", v) for v in values], "neighborhood string, ohe_deviation double")
    positions = df.select(evaluation.deviation_position(F.col("ohe_deviation")).alias("p")).collect()
    assert [r["p"] for r in positions] == [0, 0, 1, 1, 5, 6, 6, 10, 11, None]
    bins = evaluation.deviation_bins(df, ["ohe"]).collect()
    assert [r["ohe_count"] for r in bins] == [2, 2, 0, 0, 0, 1, 2, 0, 0, 0, 1, 1]
    share = evaluation.accuracy(df, models=["ohe"]).first()[0]
    assert share == pytest.approx(30.0)
    assert evaluation.deviation_outliers(df).count() == 2


def test_evaluate(spark):
    rng = random.Random(9)
    rows = [(rng.uniform(1, 9), rng.uniform(1, 9)) for _ in range(50)]
    out = evaluation.evaluate(spark.createDataFrame(rows, "price double, prediction double")).first()
    sse = sum((a - b) ** 2 for a, b in rows)
    middle = mean(a for a, _ in rows)
    assert out["rmse"] == pytest.approx(math.sqrt(sse / 50))
    assert out["r2"] == pytest.approx(1 - sse / sum((a - middle) ** 2 for a, _ in rows))


def test_distributions(snapshots_):
    _, new, _, df_new = snapshots_
    shares = defaultdict(float)
    for r in metrics.room_distribution(df_new).collect():
        shares[r["neighborhood"]] += r["pct"]
    assert None in shares and all(v == pytest.approx(100) for v in shares.values())
    mix = metrics.room_mix(df_new).collect()
    assert all(sum(r[c] for c in ("pct_1", "pct_2", "pct_3", "pct_4_plus")) == pytest.approx(100) for r in mix)
    areas = metrics.area_distribution(df_new).filter("neighborhood = 'SAN TELMO'").orderBy("position").collect()
    assert [r["n"] for r in areas] == [0, 1, 0, 0]
    city = {r["room_category"]: r["avg_price"] for r in metrics.averages_by_rooms(df_new).filter("neighborhood is null").collect()}
    assert city["4 o más"] == pytest.approx(mean(r[2] for r in new if r[4] >= 4))
    density = metrics.density_histogram(df_new, "price", 10).collect()
    width = (max(r[2] for r in new) - min(r[2] for r in new)) / 10
    assert sum(r["density"] for r in density) * width == pytest.approx(1)


def test_one_hot(spark):
    df = spark.createDataFrame([("Palermo",), ("neighborhood_Belgrano",), (None,)], "neighborhood string")
    rows = one_hot_neighborhood(df).collect()
    assert [sum(v for k, v in r.asDict().items() if k != "neighborhood") for r in rows] == [1, 0, 0]
    assert rows[0]["neighborhood_PALERMO"] == 1


def test_requests_are_answered(spark, snapshots_):
    from barriometrics.operators import models, reports

    old, new, df_old, df_new = snapshots_
    requests = spark.createDataFrame(
        [(1, "FLORES", 2, 1, 5, "30-60", -34.6, -58.4), (2, "FLORES", 9, 1, 5, "30-60", -34.6, -58.4), (3, "DEVOTO", 2, 1, 5, "x", 0.0, 0.0)],
        "request_id int, neighborhood string, rooms int, bedrooms int, antiquity int, total_area string, lat double, lon double",
    )
    around = spark.createDataFrame(
        [({"amenity": "cafe"}, -34.6, -58.4), ({"amenity": "cafe"}, -34.6, -58.4), ({"amenity": "clinic"}, -34.601, -58.4), ({"amenity": "bar"}, -34.7, -58.4)],
        "tags map<string,string>, lat double, lon double",
    )
    rows = df_new.withColumns({"bedrooms": F.col("rooms"), "antiquity": F.lit(5.0)})
    model = models.train_ohe(rows, params={"maxIter": 2, "maxDepth": 2})
    out = {r["request_id"]: r for r in reports.answer_requests(requests, df_old, df_new, around, model).collect()}
    flores = [r for r in new if r[1] == "FLORES"]
    two = [r[2] for r in flores if r[4] == 2]
    assert out[1]["total_properties_neighborhood"] == len(flores) and out[1]["total_properties"] == len(new)
    assert out[1]["total_properties_amb_neighborhood"] == len(two)
    assert out[1]["average_price_amb_neighborhood"] == pytest.approx(mean(two))
    assert out[2]["total_properties_amb_neighborhood"] == 0 and out[3]["total_properties_neighborhood"] == 0
    assert (out[1]["nearby_restaurantes"], out[1]["nearby_centros_salud"], out[3]["nearby_restaurantes"]) == (2, 1, 0)
    assert out[1]["rent_result_min"] > 0 and out[3]["rent_result_min"] is None
    old_codes, new_codes = {r[0] for r in old}, {r[0] for r in new}
    assert out[1]["removed_properties_since_last_report"] == sum(r[0] not in new_codes for r in old)
    assert out[1]["new_properties_since_last_report"] == sum(r[0] not in old_codes for r in new)
