"""Registered queries: report figures, distributions, places and market trends."""

from __future__ import annotations

from pyspark.sql import functions as F

from barriometrics import dims
from barriometrics.operators import history, metrics, places, reports, snapshots, trend_texts, trends
from barriometrics.plans import driver_tables as dt, flows
from barriometrics.plans.registry import RUN_DATE, USD_RATE, query, rounded
from barriometrics.session import materialise, scratch_path
from barriometrics.sources import writers

MONTH = "08_2001"


def _stored(spark, sf):
    """The two snapshots as stored narrow tables, as the cleaning flow hands them on."""
    columns = ("code", "neighborhood", "price", "total_area", "rooms", "bathrooms", "garages")
    return [materialise(df.select(*columns)) for df in dt.old_and_new(spark, sf)]


def _new(spark, sf):
    return dt.old_and_new(spark, sf)[1]


# ---- report figures -------------------------------------------------------------------------


@query("kpi_city", "SELECT count(*) AS total_properties FROM news", ("facts", "snaps"))
def kpi_city(spark, sf):
    return metrics.kpi_city(_new(spark, sf))


_VALID = ", ".join(f"('{n}')" for n in dims.VALID_NEIGHBORHOODS)
_KPI = f""", valid(neighborhood) AS (VALUES {_VALID}),
kpi AS (SELECT neighborhood, count(*) AS total_properties_neighborhood, CAST(trunc(avg(price)) AS BIGINT) AS average_price_neighborhood,
  CAST(trunc(min(price)) AS BIGINT) AS min_price_neighborhood, CAST(trunc(max(price)) AS BIGINT) AS max_price_neighborhood FROM {{news}} GROUP BY neighborhood),
full_kpi AS (SELECT neighborhood, coalesce(total_properties_neighborhood, 0) AS total_properties_neighborhood, coalesce(average_price_neighborhood, 0) AS average_price_neighborhood,
  coalesce(min_price_neighborhood, 0) AS min_price_neighborhood, coalesce(max_price_neighborhood, 0) AS max_price_neighborhood FROM valid LEFT JOIN kpi USING (neighborhood))
"""
_REPORT = """, nn AS (SELECT neighborhood, count(*) AS c FROM {news} n WHERE NOT EXISTS (SELECT 1 FROM {olds} o WHERE o.code = n.code AND o.neighborhood = n.neighborhood) GROUP BY 1),
rr AS (SELECT neighborhood, count(*) AS c FROM {olds} o WHERE NOT EXISTS (SELECT 1 FROM {news} n WHERE o.code = n.code AND o.neighborhood = n.neighborhood) GROUP BY 1)
SELECT k.neighborhood, (SELECT count(*) FROM {news}) AS total_properties,
  (SELECT count(*) FROM {news} WHERE code NOT IN (SELECT code FROM {olds})) AS new_properties_since_last_report,
  (SELECT count(*) FROM {olds} WHERE code NOT IN (SELECT code FROM {news})) AS removed_properties_since_last_report,
  total_properties_neighborhood, average_price_neighborhood, min_price_neighborhood, max_price_neighborhood,
  CASE WHEN total_properties_neighborhood = 0 THEN 0 ELSE coalesce(nn.c, 0) END AS new_properties_since_last_report_neighborhood,
  CASE WHEN total_properties_neighborhood = 0 THEN 0 ELSE coalesce(rr.c, 0) END AS removed_properties_since_last_report_neighborhood
FROM full_kpi k LEFT JOIN nn ON nn.neighborhood = k.neighborhood LEFT JOIN rr ON rr.neighborhood = k.neighborhood
"""


@query("kpi_neighborhood", _KPI.format(news="news") + "SELECT * FROM full_kpi", ("facts", "snaps"))
def kpi_neighborhood(spark, sf):
    return metrics.kpi_neighborhood(_new(spark, sf))


@query(
    "kpi_neighborhood_rooms",
    """SELECT neighborhood, rooms, count(*) AS total_properties_amb_neighborhood, round(avg(price), 1) AS average_price_amb_neighborhood,
    min(price) AS min_price_amb_neighborhood, max(price) AS max_price_amb_neighborhood FROM news GROUP BY 1, 2""",
    ("facts", "snaps"),
)
def kpi_neighborhood_rooms(spark, sf):
    return rounded(metrics.kpi_neighborhood_rooms(_new(spark, sf)), 1, "average_price_amb_neighborhood")


@query("kpi_report", _KPI.format(news="news") + _REPORT.format(news="news", olds="olds"), ("facts", "snaps"))
def kpi_report(spark, sf):
    return metrics.kpi_report(*dt.old_and_new(spark, sf))


def _cleaned_snapshots(spark, sf):
    """Both RAW snapshots through the report flow, each cleaned on its own."""
    raw = dt.stored(dt.raw_z(spark, sf))
    out = []
    for day in (dt.OLD_SNAPSHOT, dt.NEW_SNAPSHOT):
        rows = raw.filter(F.col("snapshot_date") == F.lit(day).cast("date"))
        out.append(flows.report_listings(rows, USD_RATE).withColumnRenamed("zonaprop_code", "code"))
    return out


@query(
    "kpi_report_from_raw",
    f""", clean_in AS (SELECT * FROM stg_z),
    cleaned AS (SELECT * FROM (VALUES ('{dt.OLD_SNAPSHOT}'), ('{dt.NEW_SNAPSHOT}')) d(day), LATERAL (
      WITH bathed AS (SELECT zonaprop_code AS code, lower(description) AS description, neighborhood AS written, total_area, garages, snapshot_date,
          coalesce(rooms, CASE WHEN contains(lower(description), 'monoambiente') THEN 1 END, CAST(nullif(regexp_extract(lower(description), '([1-9]|10) ?(?:amb|dor)', 1), '') AS DOUBLE)) AS rooms,
          TRY_CAST(regexp_replace(price, '\\.(\\d{{3}})', '\\1', 'g') AS DOUBLE) AS price FROM clean_in WHERE CAST(snapshot_date AS VARCHAR) = d.day)
      SELECT code, written, price, total_area FROM bathed WHERE rooms IS NOT NULL AND price > 1000 AND total_area > 10) c),
    f1 AS (SELECT day, quantile_cont(price, 0.25::DOUBLE) AS q1, quantile_cont(price, 0.75::DOUBLE) AS q3 FROM cleaned GROUP BY day),
    c1 AS (SELECT c.* FROM cleaned c JOIN f1 USING (day) WHERE price BETWEEN q1 - 1.5::DOUBLE * (q3 - q1) AND q3 + 1.5::DOUBLE * (q3 - q1)),
    f2 AS (SELECT day, quantile_cont(total_area, 0.25::DOUBLE) AS q1, quantile_cont(total_area, 0.75::DOUBLE) AS q3 FROM c1 GROUP BY day),
    c2 AS (SELECT c.*, CASE WHEN raw_neighborhood IN ('Palermo Hollywood', 'La Boca') THEN 'OTRO' ELSE n.neighborhood END AS neighborhood FROM c1 c JOIN f2 USING (day)
      JOIN names n ON raw_neighborhood = written WHERE total_area BETWEEN q1 - 1.5::DOUBLE * (q3 - q1) AND q3 + 1.5::DOUBLE * (q3 - q1)),
    olds AS (SELECT * FROM c2 WHERE neighborhood <> 'OTRO' AND day = '{dt.OLD_SNAPSHOT}'), news AS (SELECT * FROM c2 WHERE neighborhood <> 'OTRO' AND day = '{dt.NEW_SNAPSHOT}')
    """ + _KPI.format(news="news") + _REPORT.format(news="news", olds="olds"),
    ("stg_z",),
)
def kpi_report_from_raw(spark, sf):
    return metrics.kpi_report(*_cleaned_snapshots(spark, sf))


@query(
    "write_kpi_json",
    _KPI.format(news="news")
    + _REPORT.format(news="news", olds="olds")
    .replace("SELECT k.neighborhood,", f"SELECT k.neighborhood, '{MONTH}' AS month,")
    .replace(
        "average_price_neighborhood, min_price_neighborhood, max_price_neighborhood,",
        ", ".join(f"CAST({m}_price_neighborhood AS VARCHAR) AS {m}_price_neighborhood" for m in ("average", "min", "max")) + ",",
    ),
    ("facts", "snaps"),
)
def write_kpi_json(spark, sf):
    """The whole document of figures, stored and read back."""
    figures = metrics.kpi_report(*dt.old_and_new(spark, sf))
    path = writers.write_kpi_json(figures, scratch_path(spark, "kpi"), MONTH)
    counts = [c for c in figures.columns if c != "neighborhood" and "_price_" not in c]
    money = [c for c in figures.columns if "_price_" in c]
    schema = ", ".join([*(f"{c} BIGINT" for c in counts), *(f"{c} STRING" for c in money), "month STRING", "neighborhood STRING"])
    return spark.read.schema(schema).json(path)


# ---- snapshots ------------------------------------------------------------------------------


@query(
    "snapshot_new",
    """SELECT neighborhood, count(*) AS new_rows FROM news n WHERE NOT EXISTS (SELECT 1 FROM olds o WHERE o.code = n.code AND o.neighborhood = n.neighborhood) GROUP BY 1
    UNION ALL SELECT NULL, count(*) FROM news WHERE code NOT IN (SELECT code FROM olds)""",
    ("facts", "snaps"),
)
def snapshot_new(spark, sf):
    presence = snapshots.code_presence(*dt.old_and_new(spark, sf), by=["neighborhood"])
    local = snapshots.change_counts(presence, ["neighborhood"])
    city = snapshots.change_counts(snapshots.citywide(presence)).withColumn("neighborhood", F.lit(None).cast("string"))
    return local.filter(F.col("new_rows") > 0).unionByName(city).select("neighborhood", "new_rows")


@query(
    "snapshot_removed",
    """SELECT neighborhood, count(*) AS removed_rows FROM olds o WHERE NOT EXISTS (SELECT 1 FROM news n WHERE o.code = n.code AND o.neighborhood = n.neighborhood) GROUP BY 1
    UNION ALL SELECT NULL, count(*) FROM olds WHERE code NOT IN (SELECT code FROM news)""",
    ("facts", "snaps"),
)
def snapshot_removed(spark, sf):
    presence = snapshots.code_presence(*dt.old_and_new(spark, sf), by=["neighborhood"])
    local = snapshots.change_counts(presence, ["neighborhood"])
    city = snapshots.change_counts(snapshots.citywide(presence)).withColumn("neighborhood", F.lit(None).cast("string"))
    return local.filter(F.col("removed_rows") > 0).unionByName(city).select("neighborhood", "removed_rows")


@query(
    "snapshot_new_rows",
    "SELECT neighborhood, code, price, line FROM news n WHERE NOT EXISTS (SELECT 1 FROM olds o WHERE o.code = n.code AND o.neighborhood = n.neighborhood)",
    ("facts", "snaps"),
)
def snapshot_new_rows(spark, sf):
    old, new = dt.old_and_new(spark, sf)
    return snapshots.only_in(new, old, by=["neighborhood"]).select("neighborhood", "code", "price", "line")


@query(
    "snapshot_set_diff",
    """, a AS (SELECT neighborhood, code FROM news EXCEPT SELECT neighborhood, code FROM olds), r AS (SELECT neighborhood, code FROM olds EXCEPT SELECT neighborhood, code FROM news)
    SELECT neighborhood, coalesce(x.c, 0) AS new_codes, coalesce(y.c, 0) AS removed_codes FROM (SELECT neighborhood, count(*) AS c FROM a GROUP BY 1) x
    FULL JOIN (SELECT neighborhood, count(*) AS c FROM r GROUP BY 1) y USING (neighborhood)""",
    ("facts", "snaps"),
)
def snapshot_set_diff(spark, sf):
    presence = snapshots.code_presence(*dt.old_and_new(spark, sf), by=["neighborhood"])
    counts = snapshots.change_counts(presence, ["neighborhood"])
    return counts.select("neighborhood", "new_codes", "removed_codes").filter("new_codes + removed_codes > 0")


# ---- distributions --------------------------------------------------------------------------

_CAT = "CASE WHEN rooms < 4 THEN CAST(CAST(rooms AS INT) AS VARCHAR) ELSE '4 o más' END"


@query("room_category", f"SELECT code, rooms, {_CAT} AS room_category FROM news", ("facts", "snaps"))
def room_category(spark, sf):
    return metrics.with_room_category(_new(spark, sf)).select("code", "rooms", "room_category")


@query(
    "avg_price_by_rooms",
    f"SELECT neighborhood, {_CAT} AS room_category, round(avg(price), 1) AS avg_price FROM news GROUP BY GROUPING SETS ((neighborhood, {_CAT}), ({_CAT}))",
    ("facts", "snaps"),
)
def avg_price_by_rooms(spark, sf):
    return rounded(metrics.averages_by_rooms(_new(spark, sf)).drop("avg_price_m2"), 1, "avg_price")


@query(
    "avg_price_m2_by_rooms",
    f"SELECT neighborhood, {_CAT} AS room_category, round(avg(price / total_area), 2) AS avg_price_m2 FROM news GROUP BY GROUPING SETS ((neighborhood, {_CAT}), ({_CAT}))",
    ("facts", "snaps"),
)
def avg_price_m2_by_rooms(spark, sf):
    return rounded(metrics.averages_by_rooms(_new(spark, sf)).drop("avg_price"), 2, "avg_price_m2")


@query(
    "room_distribution",
    f"""SELECT neighborhood, {_CAT} AS room_category, count(*) AS n, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (PARTITION BY neighborhood), 4) AS pct FROM news GROUP BY 1, 2
    UNION ALL SELECT NULL, {_CAT}, count(*), round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 4) FROM news GROUP BY 2""",
    ("facts", "snaps"),
)
def room_distribution(spark, sf):
    return rounded(metrics.room_distribution(_new(spark, sf)), 4, "pct")


@query(
    "area_distribution",
    """, cats(position, area_category) AS (VALUES (0, '0-30 m²'), (1, '30-60 m²'), (2, '60-100 m²'), (3, '>100 m²')),
    c AS (SELECT neighborhood, CASE WHEN total_area <= 30 THEN 0 WHEN total_area <= 60 THEN 1 WHEN total_area <= 100 THEN 2 ELSE 3 END AS position, count(*) AS n FROM news GROUP BY 1, 2),
    t AS (SELECT neighborhood, sum(n) AS total FROM c GROUP BY 1)
    SELECT t.neighborhood, cats.position, area_category, coalesce(n, 0) AS n, round(coalesce(n, 0) * 100.0::DOUBLE / total, 4) AS pct
    FROM t CROSS JOIN cats LEFT JOIN c ON c.neighborhood = t.neighborhood AND c.position = cats.position""",
    ("facts", "snaps"),
)
def area_distribution(spark, sf):
    return rounded(metrics.area_distribution(_new(spark, sf)), 4, "pct")


@query(
    "room_mix_pivot",
    """SELECT neighborhood, round(count_if(rooms = 1) * 100.0::DOUBLE / count(*), 4) AS pct_1, round(count_if(rooms = 2) * 100.0::DOUBLE / count(*), 4) AS pct_2,
    round(count_if(rooms = 3) * 100.0::DOUBLE / count(*), 4) AS pct_3, round(count_if(rooms >= 4) * 100.0::DOUBLE / count(*), 4) AS pct_4_plus FROM news GROUP BY 1""",
    ("facts", "snaps"),
)
def room_mix_pivot(spark, sf):
    return rounded(metrics.room_mix(_new(spark, sf)), 4, "pct_1", "pct_2", "pct_3", "pct_4_plus")


_SERIES = f"""SELECT CAST(strptime(mes || '-01', '%Y-%m-%d') AS DATE) AS month, barrio AS neighborhood, round(avg({{c}}), 1) AS mean_value FROM historic
WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH') AND mes >= strftime(DATE '{RUN_DATE}' - INTERVAL 12 MONTH, '%Y-%m') GROUP BY 1, 2"""


@query("historic_price_m2_series", _SERIES.format(c="per_m2"), ("historic",))
def historic_price_m2_series(spark, sf):
    return rounded(history.price_m2_series(dt.historic(spark, sf), RUN_DATE), 1, "mean_value")


@query("historic_price_series", _SERIES.format(c="price"), ("historic",))
def historic_price_series(spark, sf):
    return rounded(history.price_series(dt.historic(spark, sf), RUN_DATE), 1, "mean_value")


@query("listings_per_neighborhood", "SELECT neighborhood, count(*) AS listings FROM mapped GROUP BY 1", ("facts", "snaps"))
def listings_per_neighborhood(spark, sf):
    return metrics.listings_per_neighborhood(dt.facts(spark, sf).filter(F.col("neighborhood") != dims.UNMAPPED))


@query(
    "price_box_stats",
    """WITH q AS (SELECT event_type, count(*) AS n, quantile_cont(value, 0.25::DOUBLE) AS q1, quantile_cont(value, 0.5::DOUBLE) AS median, quantile_cont(value, 0.75::DOUBLE) AS q3 FROM events GROUP BY 1)
    SELECT e.event_type, any_value(n) AS n, round(any_value(q1), 4) AS q1, round(any_value(median), 4) AS median, round(any_value(q3), 4) AS q3,
    min(value) AS whisker_low, max(value) AS whisker_high FROM events e JOIN q USING (event_type) WHERE value BETWEEN q1 - 1.5::DOUBLE * (q3 - q1) AND q3 + 1.5::DOUBLE * (q3 - q1) GROUP BY 1""",
)
def price_box_stats(spark, sf):
    stats = metrics.price_box_stats(dt.read(spark, sf, "events"), "value", ["event_type"])
    return rounded(stats, 4, "q1", "median", "q3")


@query(
    "density_histogram",
    """WITH s AS (SELECT min(value) AS lo, max(value) AS hi, count(value) AS n FROM events)
    SELECT CAST(least(floor((value - lo) / ((hi - lo) / 50)), 49) AS INT) AS bin, round(any_value(lo) + CAST(least(floor((value - lo) / ((hi - lo) / 50)), 49) AS INT) * ((any_value(hi) - any_value(lo)) / 50), 4) AS lower_edge,
    count(*) AS n, round(count(*) / (any_value(s.n) * ((any_value(hi) - any_value(lo)) / 50)), 6) AS density FROM events, s GROUP BY 1""",
)
def density_histogram(spark, sf):
    bins = metrics.density_histogram(dt.read(spark, sf, "events"), "value")
    return rounded(rounded(bins, 4, "lower_edge"), 6, "density")


@query("area_price_points", "SELECT total_area, price, neighborhood FROM mapped", ("facts", "snaps"))
def area_price_points(spark, sf):
    return metrics.area_price_points(dt.facts(spark, sf).filter(F.col("neighborhood") != dims.UNMAPPED))


# ---- places and reports ---------------------------------------------------------------------


@query(
    "poi_by_category",
    """, g(place_group) AS (VALUES ('transporte'), ('sitios_interes'), ('edificios_administrativos'), ('instituciones_educativas'), ('centros_salud'), ('restaurantes'))
    SELECT g.place_group, count(grouped.place_id) AS total FROM g LEFT JOIN grouped USING (place_group) GROUP BY 1""",
    ("places",),
)
def poi_by_category(spark, sf):
    return places.group_totals(dt.places(spark, sf))


@query("poi_rows_by_category", "SELECT place_id, place_group, name, lat, lon FROM grouped WHERE place_group IS NOT NULL", ("places",))
def poi_rows_by_category(spark, sf):
    return places.grouped_places(dt.places(spark, sf)).select("place_id", "place_group", "name", "lat", "lon")


@query("poi_group_by_amenity", "SELECT place_id, amenity, name, lat, lon, count(*) OVER (PARTITION BY amenity) AS total FROM places", ("places",))
def poi_group_by_amenity(spark, sf):
    return places.places_by_amenity(dt.places(spark, sf))


# Embedding dimensions as coordinates: 1 and 2 place the requests, 3 and 4 the places, some 8 km wide.
_LAT, _LON, _SPREAD = -34.6, -58.4, 0.1


def _spot(i, base):
    return F.lit(base) + F.element_at("embedding", i).cast("double") * _SPREAD


def _requests_and_places(spark, sf):
    vectors = dt.read(spark, sf, "embeddings")
    requests = vectors.select(F.col("vec_id").alias("request_id"), _spot(1, _LAT).alias("lat"), _spot(2, _LON).alias("lon"))
    spots = vectors.select("label", _spot(3, _LAT).alias("lat"), _spot(4, _LON).alias("lon"))
    return requests, spots


@query(
    "places_within_radius",
    """WITH r AS (SELECT vec_id AS request_id, -34.6::DOUBLE + embedding[1]::DOUBLE * 0.1::DOUBLE AS lat, -58.4::DOUBLE + embedding[2]::DOUBLE * 0.1::DOUBLE AS lon FROM embeddings),
    p AS (SELECT label, -34.6::DOUBLE + embedding[3]::DOUBLE * 0.1::DOUBLE AS lat, -58.4::DOUBLE + embedding[4]::DOUBLE * 0.1::DOUBLE AS lon FROM embeddings),
    d AS (SELECT request_id, label, 2 * 6371000.0::DOUBLE * asin(sqrt(pow(sin(radians(p.lat - r.lat) / 2), 2) + cos(radians(r.lat)) * cos(radians(p.lat)) * pow(sin(radians(p.lon - r.lon) / 2), 2))) AS m FROM r, p)
    SELECT request_id, label, count(*) AS places, round(min(m), 3) AS nearest_m FROM d WHERE m <= 500 GROUP BY 1, 2""",
)
def places_within_radius(spark, sf):
    found = places.near_counts(*_requests_and_places(spark, sf), "label")
    return rounded(found, 3, "nearest_m")


def report_requests(spark, sf):
    """A request per order: its customer's nation asks for a flat of the order's size."""
    orders, customers = dt.read(spark, sf, "orders"), dt.read(spark, sf, "customer")
    names = dims.constant_table(spark, dt.NATION_NEIGHBORHOODS, "c_nationkey, raw_neighborhood, neighborhood")
    size = F.floor(F.col("o_totalprice") / 10000).cast("int") + 15
    return (
        orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .join(names, "c_nationkey")
        .select(
            F.col("o_orderkey").alias("request_id"), "neighborhood",
            F.when(F.col("o_orderstatus") == "F", 1).otherwise(3).alias("rooms"),
            F.lit(1).alias("bedrooms"), F.lit(20).alias("antiquity"),
            F.concat_ws("-", size.cast("string"), (size + 10).cast("string")).alias("total_area"),
            (F.lit(_LAT) + F.col("c_acctbal") / 1e5).alias("lat"), F.lit(_LON).alias("lon"),
        )
    )


_ANSWERS = """, req AS (SELECT o_orderkey AS request_id, neighborhood, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 3 END::DOUBLE AS rooms,
      CAST(floor(o_totalprice / 10000) AS INT) + 15 AS area_min FROM orders JOIN customer ON o_custkey = c_custkey JOIN names ON c_nationkey = nk),
    k AS (SELECT neighborhood, count(*) AS n, round(avg(price), 1) AS a, min(price) AS lo, max(price) AS hi FROM news GROUP BY 1),
    kr AS (SELECT neighborhood, rooms, count(*) AS n, round(avg(price), 1) AS a FROM news GROUP BY 1, 2),
    nn AS (SELECT neighborhood, count(*) AS c FROM news n WHERE NOT EXISTS (SELECT 1 FROM olds o WHERE o.code = n.code AND o.neighborhood = n.neighborhood) GROUP BY 1)
    SELECT request_id, req.neighborhood, area_min, area_min + 10 AS area_max, (SELECT count(*) FROM news) AS total_properties, coalesce(k.n, 0) AS total_properties_neighborhood,
    k.a AS average_price_neighborhood, k.lo AS min_price_neighborhood, k.hi AS max_price_neighborhood, coalesce(kr.n, 0) AS total_properties_amb_neighborhood, kr.a AS average_price_amb_neighborhood,
    coalesce(nn.c, CASE WHEN k.n > 0 THEN 0 END) AS new_properties_since_last_report_neighborhood
    FROM req LEFT JOIN k USING (neighborhood) LEFT JOIN kr ON kr.neighborhood = req.neighborhood AND kr.rooms = req.rooms LEFT JOIN nn ON nn.neighborhood = req.neighborhood"""


@query("report_request", _ANSWERS, ("facts", "snaps"))
def report_request(spark, sf):
    requests = report_requests(spark, sf)
    answers = reports.area_bounds(reports.answer_requests(requests, *dt.old_and_new(spark, sf)))
    return rounded(answers, 1, "average_price_neighborhood", "average_price_amb_neighborhood").select(
        "request_id", "neighborhood", "area_min", "area_max", "total_properties", "total_properties_neighborhood", "average_price_neighborhood",
        "min_price_neighborhood", "max_price_neighborhood", "total_properties_amb_neighborhood", "average_price_amb_neighborhood",
        "new_properties_since_last_report_neighborhood",
    )


@query("write_report", _ANSWERS.replace("SELECT request_id, req.neighborhood", "SELECT count(*) OVER () AS reports, request_id, req.neighborhood"), ("facts", "snaps"))
def write_report(spark, sf):
    """Every answer as it is stored, with the number of report ids."""
    answers = report_request(spark, sf)
    path = scratch_path(spark, "reports")
    writers.write_report(report_requests(spark, sf), answers, path)
    stored = spark.read.schema(f"report_id STRING, {_columns(answers)}").json(f"{path}/output_data")
    count = stored.agg(F.count_distinct("report_id")).scalar()
    return stored.select(*answers.columns, count.alias("reports"))


def _columns(df):
    return ", ".join(f"{name} {kind}" for name, kind in df.dtypes)


# ---- market trends --------------------------------------------------------------------------

_PART = """, part AS (SELECT neighborhood, n.c AS n_new, coalesce(o.c, 0) AS n_old, n.p AS avg_price_new, coalesce(o.p, 0) AS avg_price_old, n.m AS price_m2_new, coalesce(o.m, 0) AS price_m2_old
  FROM (SELECT neighborhood, count(*) AS c, avg(price) AS p, avg(price / total_area) AS m FROM news GROUP BY 1) n
  LEFT JOIN (SELECT neighborhood, count(*) AS c, avg(price) AS p, avg(price / total_area) AS m FROM olds GROUP BY 1) o USING (neighborhood)),
chg AS (SELECT *, CASE WHEN avg_price_old > 0 THEN (avg_price_new - avg_price_old) / avg_price_old * 100 ELSE 0 END AS price_change,
  CASE WHEN n_old > 0 THEN (n_new - n_old)::DOUBLE / n_old * 100 ELSE 0 END AS growth_rate,
  CASE WHEN price_m2_old > 0 THEN (price_m2_new - price_m2_old) / price_m2_old * 100 ELSE 0 END AS m2_trend FROM part)
"""
_SEG = """, seg AS (SELECT neighborhood, rooms, count(*) AS n, avg(price) AS p FROM news GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY neighborhood ORDER BY n DESC, rooms) AS k, row_number() OVER (PARTITION BY neighborhood ORDER BY rooms) AS kr,
  row_number() OVER (PARTITION BY neighborhood ORDER BY n, rooms) AS ks, sum(n) OVER (PARTITION BY neighborhood) AS total FROM seg)
"""
_CODES = """, a AS (SELECT neighborhood, count(*) AS c FROM (SELECT neighborhood, code FROM news EXCEPT SELECT neighborhood, code FROM olds) GROUP BY 1),
r AS (SELECT neighborhood, count(*) AS c FROM (SELECT neighborhood, code FROM olds EXCEPT SELECT neighborhood, code FROM news) GROUP BY 1),
od AS (SELECT neighborhood, count(DISTINCT code) AS c FROM olds GROUP BY 1),
codes AS (SELECT b.neighborhood, coalesce(a.c, 0) AS new_codes, coalesce(r.c, 0) AS removed_codes, coalesce(od.c, 0) AS old_codes FROM (SELECT DISTINCT neighborhood FROM news) b
  LEFT JOIN a USING (neighborhood) LEFT JOIN r USING (neighborhood) LEFT JOIN od USING (neighborhood))
"""
_V = ("facts", "snaps")


@query("price_trend", _PART + "SELECT neighborhood, round(avg_price_new, 1) AS avg_price_new, round(avg_price_old, 1) AS avg_price_old, round(price_change, 4) AS price_change FROM chg", _V)
def price_trend(spark, sf):
    return rounded(rounded(trends.price_trend(*dt.old_and_new(spark, sf)), 1, "avg_price_new", "avg_price_old"), 4, "price_change")


@query(
    "competition",
    _SEG + """SELECT neighborhood, CAST(total AS BIGINT) AS total_properties, rooms AS modal_rooms, n AS similar_properties, round(n * 100.0::DOUBLE / total, 4) AS competition_rate,
    CASE WHEN n * 100.0 / total > 40 THEN 'alta' WHEN n * 100.0 / total > 25 THEN 'moderada' ELSE 'baja' END AS competition_level FROM ranked WHERE k = 1""",
    _V,
)
def competition(spark, sf):
    return rounded(trends.competition(_new(spark, sf)), 4, "competition_rate")


@query(
    "price_per_m2",
    """, g AS (SELECT avg(price / total_area) AS c FROM news) SELECT neighborhood, round(avg(price / total_area), 2) AS price_m2, round(any_value(c), 2) AS price_m2_city,
    round((avg(price / total_area) - any_value(c)) / any_value(c) * 100, 4) AS m2_diff FROM news, g GROUP BY 1""",
    _V,
)
def price_per_m2(spark, sf):
    return rounded(rounded(trends.price_per_m2(*dt.old_and_new(spark, sf)), 2, "price_m2", "price_m2_city"), 4, "m2_diff")


_RATE = "CASE WHEN old_codes > 0 THEN ({x}) * 100.0::DOUBLE / old_codes ELSE 0 END"
_ROT = _RATE.format(x="new_codes + removed_codes")
_REM = _RATE.format(x="removed_codes")


@query(
    "market_rotation",
    _CODES + f"SELECT neighborhood, new_codes, removed_codes, round({_ROT}, 4) AS rotation_rate, CASE WHEN {_ROT} > 30 THEN 'rápida' WHEN {_ROT} > 15 THEN 'moderada' ELSE 'lenta' END AS market_speed FROM codes",
    _V,
)
def market_rotation(spark, sf):
    return rounded(trends.market_rotation(*dt.old_and_new(spark, sf)), 4, "rotation_rate")


@query(
    "top_segment",
    _SEG + "SELECT neighborhood, rooms AS top_rooms, n AS top_n, round(n * 100.0::DOUBLE / total, 4) AS top_pct, round(p, 1) AS top_price FROM ranked WHERE k = 1",
    _V,
)
def top_segment(spark, sf):
    return rounded(rounded(trends.top_segment(_new(spark, sf)), 4, "top_pct"), 1, "top_price")


@query(
    "market_growth",
    _PART + """SELECT neighborhood, n_new, n_old, round(growth_rate, 4) AS growth_rate, CASE WHEN growth_rate > 5 THEN 'creciendo' WHEN growth_rate > -5 THEN 'estable' ELSE 'contrayéndose' END AS growth_status,
    CASE WHEN abs(growth_rate) > 10 THEN 'Alta' WHEN abs(growth_rate) > 5 THEN 'Moderada' ELSE 'Estable' END AS opportunity_level FROM chg""",
    _V,
)
def market_growth(spark, sf):
    return rounded(trends.market_growth(*dt.old_and_new(spark, sf)), 4, "growth_rate")


@query(
    "price_segmentation",
    _SEG + """SELECT t.neighborhood, t.rooms AS top_rooms, t.n AS top_n, round(t.p, 1) AS top_price, round(coalesce((t.p - s.p) / s.p * 100, 0), 4) AS price_gap
    FROM ranked t LEFT JOIN ranked s ON s.neighborhood = t.neighborhood AND s.k = 2 WHERE t.k = 1""",
    _V,
)
def price_segmentation(spark, sf):
    return rounded(rounded(trends.price_segmentation(_new(spark, sf)), 1, "top_price"), 4, "price_gap")


@query(
    "competitive_position",
    _PART + """, pairs AS (SELECT x.neighborhood, x.avg_price_new AS own, y.avg_price_new AS other, row_number() OVER (PARTITION BY x.neighborhood ORDER BY y.n_new DESC, y.neighborhood) AS k
      FROM part x JOIN part y ON x.neighborhood <> y.neighborhood),
    c AS (SELECT neighborhood, any_value(own) AS own, avg(other) AS other FROM pairs WHERE k <= 3 GROUP BY 1), d AS (SELECT *, (own - other) / other * 100 AS pos FROM c)
    SELECT neighborhood, round(own, 1) AS avg_price_new, round(other, 1) AS avg_price_competitors, round(pos, 4) AS competitive_position,
    CASE WHEN pos < -5 THEN 'más económico' WHEN abs(pos) <= 5 THEN 'similar' ELSE 'más premium' END AS position_level FROM d""",
    _V,
)
def competitive_position(spark, sf):
    rows = trends.competitive_position(*dt.old_and_new(spark, sf))
    return rounded(rounded(rows, 1, "avg_price_new", "avg_price_competitors"), 4, "competitive_position")


@query(
    "inventory",
    _SEG + """SELECT t.neighborhood, CAST(t.total AS BIGINT) AS total_properties, i.s AS inventory_summary, t.rooms AS rare_rooms, t.n AS rare_n, round(t.n * 100.0::DOUBLE / t.total, 4) AS rare_pct
    FROM ranked t JOIN (SELECT neighborhood, string_agg(CAST(rooms AS INT) || ' amb: ' || n, ', ' ORDER BY rooms) AS s FROM ranked WHERE kr <= 3 GROUP BY 1) i USING (neighborhood) WHERE t.ks = 1""",
    _V,
)
def inventory(spark, sf):
    return rounded(trends.inventory(_new(spark, sf)), 4, "rare_pct")


@query(
    "price_per_m2_trend",
    _PART + """, o AS (SELECT neighborhood, price / total_area AS m2, row_number() OVER (PARTITION BY neighborhood ORDER BY price / total_area) AS k, count(*) OVER (PARTITION BY neighborhood) AS n FROM news),
    b AS (SELECT neighborhood, avg(m2) AS best FROM o WHERE k <= floor(n * 0.25) GROUP BY 1)
    SELECT neighborhood, round(price_m2_new, 2) AS price_m2_new, round(price_m2_old, 2) AS price_m2_old, round(m2_trend, 4) AS m2_trend, round(best, 2) AS best_value_avg FROM chg LEFT JOIN b USING (neighborhood)""",
    _V,
)
def price_per_m2_trend(spark, sf):
    rows = trends.price_per_m2_trend(*dt.old_and_new(spark, sf))
    return rounded(rounded(rows, 2, "price_m2_new", "price_m2_old", "best_value_avg"), 4, "m2_trend")


@query(
    "timing",
    _PART + """SELECT neighborhood, round(avg_price_new, 1) AS avg_price_new, round(avg_price_old, 1) AS avg_price_old, round(price_change, 4) AS price_change,
    CASE WHEN price_change < 0 THEN 'favorable' WHEN price_change > 5 THEN 'menos favorable' ELSE 'neutral' END AS timing_status FROM chg""",
    _V,
)
def timing(spark, sf):
    return rounded(rounded(trends.timing(*dt.old_and_new(spark, sf)), 1, "avg_price_new", "avg_price_old"), 4, "price_change")


@query(
    "availability",
    _CODES + """SELECT neighborhood, t.c AS total_available, new_codes, CASE WHEN t.c > 50 THEN 'alta' WHEN t.c > 20 THEN 'moderada' ELSE 'limitada' END AS availability_level
    FROM codes JOIN (SELECT neighborhood, count(*) AS c FROM news GROUP BY 1) t USING (neighborhood)""",
    _V,
)
def availability(spark, sf):
    return trends.availability(*dt.old_and_new(spark, sf))


@query(
    "best_deals",
    """, q AS (SELECT neighborhood, quantile_cont(price, 0.25::DOUBLE) AS t, avg(price) AS p FROM news GROUP BY 1),
    d AS (SELECT neighborhood, any_value(t) AS t, any_value(p) AS p, count(*) AS c, avg(price) AS a, avg(price / total_area) AS m FROM news JOIN q USING (neighborhood) WHERE price <= t GROUP BY 1)
    SELECT neighborhood, round(t, 1) AS price_threshold, c AS deals, round(a, 1) AS deals_avg_price, round(m, 2) AS deals_avg_m2, round(p, 1) AS avg_price, round((p - a) / p * 100, 4) AS savings_pct FROM d""",
    _V,
)
def best_deals(spark, sf):
    rows = trends.best_deals(_new(spark, sf))
    return rounded(rounded(rounded(rows, 1, "price_threshold", "deals_avg_price", "avg_price"), 2, "deals_avg_m2"), 4, "savings_pct")


_BANDED = """, w AS (SELECT *, CASE WHEN total_area < 30 THEN 0 WHEN total_area < 50 THEN 1 WHEN total_area < 80 THEN 2 ELSE 3 END AS band FROM news),
b AS (SELECT neighborhood, band, count(*) AS n, avg(rooms) AS r, avg(bathrooms) AS bt FROM w GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY neighborhood ORDER BY n DESC, band) AS k, count(*) OVER (PARTITION BY neighborhood) AS used FROM b),
t AS (SELECT neighborhood, count(*) AS total, count_if(band = 0)::BIGINT AS n0, count_if(band = 1)::BIGINT AS n1, count_if(band = 2)::BIGINT AS n2, count_if(band = 3)::BIGINT AS n3,
  count_if(bathrooms > 1 OR garages > 0)::BIGINT AS premium FROM w GROUP BY 1)
"""


@query(
    "property_profile",
    _BANDED + """SELECT neighborhood, total, n0, n1, n2, n3, band AS top_band, n AS top_band_n, round(n * 100.0::DOUBLE / total, 4) AS top_band_pct, round(r, 4) AS top_band_rooms,
    round(bt, 4) AS top_band_bathrooms, CAST(used AS INT) AS bands_in_use, round(premium * 100.0::DOUBLE / total, 4) AS premium_pct FROM t JOIN k USING (neighborhood) WHERE k.k = 1""",
    _V,
)
def property_profile(spark, sf):
    return rounded(trends.property_profile(_new(spark, sf)), 4, "top_band_pct", "top_band_rooms", "top_band_bathrooms", "premium_pct")


@query(
    "market_speed",
    _CODES + f"""SELECT neighborhood, removed_codes, old_codes, round({_REM}, 4) AS removal_rate, CASE WHEN {_REM} > 40 THEN 'muy dinámico' WHEN {_REM} > 25 THEN 'dinámico' ELSE 'pausado' END AS speed_level,
    CASE WHEN {_REM} > 40 THEN 'alta' WHEN {_REM} > 25 THEN 'moderada' ELSE 'baja' END AS urgency FROM codes""",
    _V,
)
def market_speed(spark, sf):
    return rounded(trends.market_speed(*dt.old_and_new(spark, sf)), 4, "removal_rate")


_MONEY = "'$' || format('{{:,}}', CAST(round_even({x}, 0) AS BIGINT))"
_SHARE = "printf('{f}', round_even({x}, 1)) || '%'"


def _money(x: str) -> str:
    return _MONEY.format(x=x)


def _share(x: str, form: str = "%.1f") -> str:
    return _SHARE.format(f=form, x=x)


_VALUES = {
    ("owner", "price_trend"): _share("price_change", "%+.1f"),
    ("owner", "competition"): "n_new || ' propiedades'",
    ("owner", "price_per_m2"): _money("price_m2_new") + " || '/m²'",
    ("owner", "market_rotation"): _share(_ROT) + " || ' rotación'",
    ("owner", "top_segment"): "CAST(top_rooms AS INT) || ' ambientes'",
    ("agent", "market_growth"): _share("growth_rate", "%+.1f"),
    ("agent", "price_segmentation"): _money("top_price"),
    ("agent", "competitive_position"): _share("pos", "%+.1f"),
    ("agent", "inventory"): "n_new || ' unidades'",
    ("agent", "price_per_m2_trend"): _money("price_m2_new") + " || '/m²'",
    ("tenant", "timing"): _share("price_change", "%+.1f"),
    ("tenant", "availability"): "n_new || ' propiedades'",
    ("tenant", "best_deals"): _money("deals_price"),
    ("tenant", "property_profile"): "band_n || ' en segmento principal'",
    ("tenant", "market_speed"): _share(_REM) + " || ' rotación'",
}
_TREND_VALUES = _PART + _SEG + _CODES + _BANDED.replace("t AS (", "tot AS (") + """, pairs AS (SELECT x.neighborhood, x.avg_price_new AS own, y.avg_price_new AS other, row_number() OVER (PARTITION BY x.neighborhood ORDER BY y.n_new DESC, y.neighborhood) AS rk
  FROM part x JOIN part y ON x.neighborhood <> y.neighborhood),
comp AS (SELECT neighborhood, (any_value(own) - avg(other)) / avg(other) * 100 AS pos FROM pairs WHERE rk <= 3 GROUP BY 1),
q AS (SELECT neighborhood, quantile_cont(price, 0.25::DOUBLE) AS t FROM news GROUP BY 1),
deal AS (SELECT neighborhood, avg(price) AS deals_price FROM news JOIN q USING (neighborhood) WHERE price <= t GROUP BY 1),
top AS (SELECT neighborhood, rooms AS top_rooms, p AS top_price FROM ranked WHERE ranked.k = 1),
bandtop AS (SELECT neighborhood, n AS band_n FROM k WHERE k.k = 1),
allv AS (SELECT * FROM chg JOIN comp USING (neighborhood) JOIN deal USING (neighborhood) JOIN top USING (neighborhood) JOIN bandtop USING (neighborhood) JOIN codes USING (neighborhood))
""" + " UNION ALL ".join(f"SELECT neighborhood, '{who}' AS audience, '{kind}' AS metric_type, {sql} AS value FROM allv" for (who, kind), sql in _VALUES.items())


@query("trend_values", _TREND_VALUES, _V)
def trend_values(spark, sf):
    """The headline value of all fifteen metrics per neighbourhood, as printed."""
    rows = trend_texts.trend_rows(trends.trend_facts(*_stored(spark, sf)))
    return rows.select("neighborhood", "audience", "metric_type", "value")


@query("trend_rows")
def trend_rows(spark, sf):
    """All fifteen metrics of every neighbourhood with their texts."""
    return trend_texts.trend_rows(trends.trend_facts(*_stored(spark, sf)))


@query(
    "write_trends_json",
    f"SELECT neighborhood, '{MONTH}' AS month, CAST(5 AS INT) AS owner, CAST(5 AS INT) AS agent, CAST(5 AS INT) AS tenant FROM (SELECT DISTINCT neighborhood FROM news)",
    _V,
)
def write_trends_json(spark, sf):
    documents = trend_texts.trend_documents(trends.trend_facts(*_stored(spark, sf)), RUN_DATE)
    path = writers.write_trends_json(documents, scratch_path(spark, "trends"), MONTH)
    entry = "ARRAY<STRUCT<title: STRING, description: STRING, value: STRING, metric_type: STRING>>"
    stored = spark.read.schema(f"owner_trends {entry}, agent_trends {entry}, tenant_trends {entry}, month STRING, neighborhood STRING").json(path)
    sizes = [F.size(f"{who}_trends").alias(who) for who in ("owner", "agent", "tenant")]
    return stored.select("neighborhood", "month", *sizes)
