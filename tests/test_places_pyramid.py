"""Places within a radius, from sums of cells, against all distances."""

import math
import random
from collections import defaultdict

import pytest

from barriometrics.operators import places

SCHEMA = "lat double, lon double, kind string"


def metres(a, b):
    p, q = math.radians(a[0]), math.radians(b[0])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6371000.0 * math.asin(min(1.0, math.sqrt(h)))


def check(spark, requests, spots, radius=500.0):
    got = {
        (r["request_id"], r["kind"]): (r["places"], round(r["nearest_m"], 4))
        for r in places.near_counts(
            spark.createDataFrame([(i, *o) for i, o in enumerate(requests)], "request_id long, lat double, lon double"), spark.createDataFrame(spots, SCHEMA), "kind", radius
        ).collect()
    }
    expected = defaultdict(list)
    for i, o in enumerate(requests):
        for lat, lon, kind in spots:
            if None not in (lat, lon, *o) and (m := metres(o, (lat, lon))) <= radius:
                expected[i, kind].append(m)
    assert got == {k: (len(v), round(min(v), 4)) for k, v in expected.items()}
    return got


def around(rng, lat, lon, spread):
    return lat + rng.uniform(-spread, spread), lon + rng.uniform(-spread, spread) / max(0.02, math.cos(math.radians(lat)))


@pytest.mark.parametrize("lat, lon", [(-34.6, -58.4), (0.0, 0.0), (71.0, 179.9995), (-0.002, -179.999)])
def test_counts_and_nearest_match_all_distances(spark, lat, lon):
    rng = random.Random(lat)
    spots = [(*around(rng, lat, lon, 0.012), rng.choice(["a", "b", None])) for _ in range(600)]
    spots = [(y, (x + 180) % 360 - 180, k) for y, x, k in spots] + spots[:40] + [(None, 1.0, "a"), (1.0, None, "b")]
    requests = [around(rng, lat, lon, 0.012) for _ in range(25)] + [spots[3][:2], (None, 2.0)]
    assert len(check(spark, [(y, x if x is None else (x + 180) % 360 - 180) for y, x in requests], spots)) > 40


def test_one_cell_with_most_of_both(spark):
    rng = random.Random(2)
    spots = [(*around(rng, 10.001, 20.001, 0.0003), "a") for _ in range(1_500)] + [(*around(rng, 10.0, 20.0, 0.02), "b") for _ in range(60)]
    requests = [around(rng, 10.001, 20.001, 0.0003) for _ in range(30)] + [around(rng, 10.0, 20.0, 0.01) for _ in range(15)]
    check(spark, requests, spots)


def test_poles_have_few_cells(spark):
    rng = random.Random(7)
    spots = [(rng.choice([-1, 1]) * rng.uniform(89.99, 90.0), rng.uniform(-180, 180), "a") for _ in range(300)]
    requests = [(rng.choice([-1, 1]) * rng.uniform(89.992, 90.0), rng.uniform(-180, 180)) for _ in range(12)] + [(90.0, 0.0), (-90.0, 10.0)]
    check(spark, requests, spots)
    size = 500 / places.METRES_PER_DEGREE
    origins = spark.createDataFrame([*requests, (0.0, 0.0), (60.0, 10.0), (89.9, 0.0)], "lat double, lon double")
    assert max(r["count"] for r in places._cover(origins, 500.0, size).groupBy("lat", "lon").count().collect()) < 1_200


def test_nothing_near(spark):
    assert places.near_counts(spark.createDataFrame([(1, 0.0, 0.0)], "request_id long, lat double, lon double"), spark.createDataFrame([(9.0, 9.0, "a")], SCHEMA), "kind").count() == 0


def test_tiles_dealt_over_groups_and_rows_shuffled_follow_the_rows(spark, monkeypatch):
    monkeypatch.setattr(places, "TILE_ROWS", 40, raising=False)
    monkeypatch.setattr(places, "BLOCK_PAIRS", 100, raising=False)
    rng = random.Random(5)
    spots = [(*around(rng, -34.6, -58.4, 0.003), rng.choice(["a", None])) for _ in range(300)]
    requests = [around(rng, -34.6, -58.4, 0.003) for _ in range(90)]
    check(spark, requests, spots)
    written = {}
    keep = places.materialise
    monkeypatch.setattr(places, "materialise", lambda df, label: written.setdefault(label, keep(df, label)))
    check(spark, requests, spots)
    assert sum(df.count() for df in written.values()) < 2 * (len(spots) + len(requests))
