"""Registered queries: sources and sinks, extraction, staging, cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from barriometrics import dims, schemas
from barriometrics.functions import text
from barriometrics.operators import cleaning, crawl, extract, neighborhoods, snapshots, staging
from barriometrics.plans import driver_tables as dt, flows
from barriometrics.plans.registry import RUN_DATE, USD_RATE, query, rounded
from barriometrics.session import scratch_path
from barriometrics.sources import readers, writers

RAW_Z_COLUMNS = schemas.RAW_Z.fieldNames()

# ---- sources and sinks ----------------------------------------------------------------------


@query("scan_raw_csv", "SELECT property_url, zonaprop_code, price, expenses, address, location, features, description FROM raw_z", ("raw_z",))
def scan_raw_csv(spark, sf):
    path = writers.write_raw_csv(dt.raw_z(spark, sf).select(*RAW_Z_COLUMNS), scratch_path(spark, "raw-csv"))
    return readers.scan_raw_csv(spark, path)


@query(
    "scan_kv_items",
    """SELECT zonaprop_code, property_url, price, coalesce(expenses, 'nan') AS expenses,
    CAST(rooms AS VARCHAR) AS rooms FROM (SELECT zonaprop_code, property_url, price, expenses,
    coalesce(CAST(rooms AS VARCHAR), 'nan') AS rooms FROM stg_z)""",
    ("stg_z",),
)
def scan_kv_items(spark, sf):
    columns = ["zonaprop_code", "property_url", "price", "expenses", "rooms"]
    rows = staging.stage_z(dt.raw_z(spark, sf), USD_RATE).select(*columns)
    return readers.scan_kv_items(spark, writers.write_kv_items(rows, scratch_path(spark, "kv")), columns)


@query(
    "scan_historic",
    """SELECT mes AS "Mes", barrio AS "Barrio", CASE o_orderpriority WHEN '1-URGENT' THEN 'Oficina' WHEN '2-HIGH' THEN 'Local' ELSE 'Departamento' END AS "Inmueble",
    per_m2 AS mediana_por_m2, price AS mediana_precio FROM historic""",
    ("historic",),
)
def scan_historic(spark, sf):
    path = writers.write_raw_csv(dt.historic(spark, sf), scratch_path(spark, "historic"))
    return readers.scan_historic(spark, path)


@query(
    "snapshot_date_from_path",
    "SELECT CAST(l_shipdate AS DATE) AS snapshot_date, CAST(date_trunc('month', l_shipdate) AS DATE) AS snapshot_month, count(*) AS files FROM lineitem GROUP BY 1, 2",
)
def snapshot_date_from_path(spark, sf):
    day = F.date_format("l_shipdate", "ddMMyyyy")
    month = F.date_format("l_shipdate", "yyyyMM")
    paths = dt.read(spark, sf, "lineitem").select(
        F.concat(F.lit("data/raw/portal_"), day, F.lit(".csv")).alias("csv"),
        F.concat(F.lit("data/historic_"), month, F.lit(".xlsx")).alias("xlsx"),
    )
    dated = paths.select(
        snapshots.snapshot_date(F.col("csv")).alias("snapshot_date"), snapshots.snapshot_month(F.col("xlsx")).alias("snapshot_month")
    )
    return dated.groupBy("snapshot_date", "snapshot_month").agg(F.count("*").alias("files"))


@query(
    "latest_snapshots",
    """, d AS (SELECT DISTINCT l_linestatus AS source, CAST(date_trunc('month', shipped) AS DATE) AS snapshot_date FROM facts),
    r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY snapshot_date DESC) AS k FROM d)
    SELECT f.l_linestatus AS source, r.snapshot_date, f.code, f.price, f.line FROM facts f
    JOIN r ON r.source = f.l_linestatus AND r.snapshot_date = CAST(date_trunc('month', f.shipped) AS DATE) WHERE k <= 2""",
    ("facts",),
)
def latest_snapshots(spark, sf):
    rows = dt.facts(spark, sf).select(
        F.col("l_linestatus").alias("source"), F.trunc("shipped", "MM").alias("snapshot_date"), "code", "price", "line"
    )
    return snapshots.latest_snapshots(rows, 2)


@query("write_snapshot", "SELECT code, price, total_area, rooms, snapshot_date FROM facts", ("facts",))
def write_snapshot(spark, sf):
    rows = dt.facts(spark, sf).select("code", "price", "total_area", "rooms", "snapshot_date")
    path = writers.write_snapshot(rows, scratch_path(spark, "snapshot"))
    return spark.read.schema(rows.schema).parquet(path)


@query(
    "upsert_by_key",
    """, o AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY shipped DESC, price DESC, line DESC, part DESC, supplier DESC) AS k FROM facts)
    SELECT code, shipped, price, line, part, supplier FROM o WHERE k = 1""",
    ("facts",),
)
def upsert_by_key(spark, sf):
    rows = dt.facts(spark, sf).select("code", "shipped", "price", "line", "part", "supplier", "snapshot_date")
    old = rows.filter(F.col("snapshot_date") == F.lit(dt.OLD_SNAPSHOT).cast("date")).drop("snapshot_date")
    new = rows.filter(F.col("snapshot_date") == F.lit(dt.NEW_SNAPSHOT).cast("date")).drop("snapshot_date")
    return writers.upsert_by_key(old, new, "code", "shipped")


# ---- pages to RAW ---------------------------------------------------------------------------

_CARD = "page_url STRING, page_pos INT, property_url STRING, code STRING, price STRING, expenses STRING, address STRING, location STRING, features STRING, description STRING"


def _flat_cards(cards):
    return cards.drop("page").withColumn("features", F.array_join("features", "|"))


@query(
    "extract_cards_z",
    f""" SELECT url AS page_url, CAST(pos AS INT) AS page_pos, '{dt.SITE_Z}' || href || '-' || (pos + 100) || '.html' AS property_url,
    split_part(CAST(pos + 100 AS VARCHAR), '.', 1) AS code, '$ ' || (pos + 1) || '.000' AS price, '$ 5.000 Expensas' AS expenses,
    CAST(NULL AS VARCHAR) AS address, trim(label || ', Capital Federal') AS location, '45 m² tot. 2 amb.' AS features, 'Luminoso & amplio' AS description FROM cards""",
    ("cards",),
)
def extract_cards_z(spark, sf):
    return _flat_cards(extract.extract_cards(dt.card_pages(spark, sf, "Z"), "Z"))


@query(
    "extract_cards_a",
    f""" SELECT url AS page_url, CAST(pos AS INT) AS page_pos, '{dt.SITE_A}' || href || '--' || (pos + 100) AS property_url,
    CAST(pos + 100 AS VARCHAR) AS code, '$ ' || (pos + 1) || '.000' AS price, '$5.000 expensas' AS expenses,
    'Calle 1' AS address, 'Departamento en Alquiler en ' || label || ', Capital Federal' AS location,
    '45 m² cubie.|' || (pos + 1) || ' ambientes' AS features, 'Depto & balcón' AS description FROM cards""",
    ("cards",),
)
def extract_cards_a(spark, sf):
    return _flat_cards(extract.extract_cards(dt.card_pages(spark, sf, "A"), "A"))


@query("listing_code_from_url", "SELECT property_url, code FROM (SELECT property_url, zonaprop_code AS code FROM raw_z UNION ALL SELECT property_url, argenprop_code FROM raw_a)", ("raw_z", "raw_a"))
def listing_code_from_url(spark, sf):
    urls = dt.raw_z(spark, sf).select("property_url").unionAll(dt.raw_a(spark, sf).select("property_url"))
    return urls.select("property_url", text.listing_code(F.col("property_url")).alias("code"))


@query(
    "page_listing_ids",
    "SELECT p.url AS page_url, coalesce(string_agg(code, ',' ORDER BY code), '') AS ids, count(code) AS n FROM pages p LEFT JOIN (SELECT DISTINCT page_id, CAST(pos + 100 AS VARCHAR) AS code FROM cards) c USING (page_id) GROUP BY p.page_id, p.url",
    ("cards",),
)
def page_listing_ids(spark, sf):
    ids = extract.page_listing_ids(dt.card_pages(spark, sf, "A").select("url", "html"))
    return ids.select(F.col("url").alias("page_url"), F.array_join("ids", ",").alias("ids"), F.size("ids").cast("bigint").alias("n"))


@query(
    "detect_repeated_pages",
    """WITH p AS (SELECT CAST(o_custkey AS VARCHAR) AS barrio, o_orderkey AS page, o_orderstatus AS ids FROM orders),
    q AS (SELECT *, coalesce(ids = lag(ids) OVER (PARTITION BY barrio ORDER BY page), false) AS repeated FROM p)
    SELECT barrio, page, repeated, repeated AND coalesce(lag(repeated) OVER (PARTITION BY barrio ORDER BY page), false) AS stops FROM q""",
)
def detect_repeated_pages(spark, sf):
    pages = dt.crawl_log(spark, sf).select("barrio", "page", "ids")
    return crawl.repeated_pages(pages).select("barrio", "page", "repeated", "stops")


@query(
    "end_of_results",
    """WITH p AS (SELECT CAST(o_custkey AS VARCHAR) AS barrio, o_orderkey AS page,
      o_orderkey > 1 AND (o_orderpriority = '5-LOW' OR CAST(floor(o_totalprice) AS BIGINT) < o_orderkey) AS past FROM orders),
    c AS (SELECT barrio, min(page) AS cut FROM p WHERE past GROUP BY barrio)
    SELECT p.barrio, p.page FROM p LEFT JOIN c USING (barrio) WHERE cut IS NULL OR page < cut""",
)
def end_of_results(spark, sf):
    pages = dt.crawl_log(spark, sf).select("barrio", "page", "final_url")
    kept = crawl.keep_before_stop(pages, crawl.past_the_end(F.col("page"), F.col("final_url")))
    return kept.select("barrio", "page")


@query(
    "dedup_by_code",
    """, o AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY shipped, part, supplier, line, price) AS k FROM facts)
    SELECT code, shipped, part, supplier, line, price FROM o WHERE k = 1""",
    ("facts",),
)
def dedup_by_code(spark, sf):
    rows = dt.facts(spark, sf).select("code", "shipped", "part", "supplier", "line", "price")
    return crawl.first_per_code(rows, "code", ["shipped"])


@query(
    "finished_crawl",
    """, p AS (SELECT split_part(split_part(url, '/', 3), '.', 1) AS barrio, page_id AS page, length(html) AS shown, len(regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a></li>', 1)) AS n FROM pages),
    f AS (SELECT *, coalesce(n > 0 AND n = lag(n) OVER (PARTITION BY barrio ORDER BY page), false) AS repeated FROM p),
    g AS (SELECT *, repeated AND coalesce(lag(repeated) OVER (PARTITION BY barrio ORDER BY page), false) AS stops FROM f),
    c AS (SELECT barrio, min(page) AS cut FROM g WHERE stops OR (page > 1 AND (n = 0 OR shown < page)) GROUP BY 1)
    SELECT g.barrio, g.page, n AS listings FROM g LEFT JOIN c USING (barrio) WHERE cut IS NULL OR page < cut""",
    ("cards",),
)
def finished_crawl(spark, sf):
    """The benchmark's pages as one crawl per host; the page's length plays the number in its final address."""
    shown = dt.read(spark, sf, "pages").select("page_id", F.length("html").alias("shown"))
    pages = dt.card_pages(spark, sf, "A").join(shown, "page_id").select(
        F.substring_index(F.element_at(F.split("url", "/"), 3), ".", 1).alias("barrio"),
        F.col("page_id").alias("page"),
        F.concat(F.lit("https://host/x?pagina-"), F.col("shown").cast("string")).alias("final_url"),
        "html",
    )
    return flows.finished_crawl(pages).select("barrio", "page", F.size("ids").cast("bigint").alias("listings"))


@query("rename_code_column", "SELECT zonaprop_code AS argenprop_code, price FROM raw_z", ("raw_z",))
def rename_code_column(spark, sf):
    return crawl.fix_code_column(dt.raw_z(spark, sf).select("zonaprop_code", "price"))


@query("dedup_report", "SELECT count(*) AS rows_before, count(DISTINCT code) AS rows_after FROM facts", ("facts",))
def dedup_report(spark, sf):
    return crawl.dedup_report(dt.facts(spark, sf), "code")


@query(
    "pages_to_raw",
    f""", k AS (SELECT *, row_number() OVER (PARTITION BY pos ORDER BY url, href, label) AS k FROM cards)
    SELECT CAST(pos + 100 AS VARCHAR) AS zonaprop_code, '$ ' || (pos + 1) || '.000' AS price FROM k WHERE k = 1""",
    ("cards",),
)
def pages_to_raw(spark, sf):
    return flows.pages_to_raw(dt.card_pages(spark, sf, "Z"), "Z").select("zonaprop_code", "price")


# ---- RAW to STG -----------------------------------------------------------------------------


@query("split_location", "SELECT zonaprop_code, split_part(location, ',', 1) AS neighborhood, split_part(location, ',', 2) AS city FROM raw_z", ("raw_z",))
def split_location(spark, sf):
    return staging.split_location(dt.raw_z(spark, sf)).select("zonaprop_code", "neighborhood", "city")


@query("normalise_neighborhood_a", "SELECT argenprop_code, location, raw_neighborhood AS neighborhood FROM raw_a", ("raw_a",))
def normalise_neighborhood_a(spark, sf):
    return dt.raw_a(spark, sf).select(
        "argenprop_code", "location", text.neighborhood_of_listing_a(F.col("location")).alias("neighborhood")
    )


@query("expenses_regex_z", r"SELECT zonaprop_code, regexp_extract(expenses, '(\d{1,3}(?:\.\d{3})*)', 1) AS expenses FROM raw_z", ("raw_z",))
def expenses_regex_z(spark, sf):
    return dt.raw_z(spark, sf).select("zonaprop_code", text.expenses_z(F.col("expenses")).alias("expenses"))


@query("expenses_strip_a", "SELECT argenprop_code, trim(replace(replace(replace(expenses, '$', ''), '.', ''), 'expensas', '')) AS expenses FROM raw_a", ("raw_a",))
def expenses_strip_a(spark, sf):
    return dt.raw_a(spark, sf).select("argenprop_code", text.expenses_a(F.col("expenses")).alias("expenses"))


@query("split_price", "SELECT zonaprop_code, split_part(price, ' ', 1) AS currency, split_part(price, ' ', 2) AS amount FROM raw_z", ("raw_z",))
def split_price(spark, sf):
    return staging.split_price(dt.raw_z(spark, sf)).select("zonaprop_code", "currency", "amount")


@query(
    "filter_unpriced",
    """SELECT 'Z' AS portal, zonaprop_code AS code, split_part(price, ' ', 2) AS amount FROM raw_z WHERE split_part(price, ' ', 2) <> 'precio'
    UNION ALL SELECT 'A', argenprop_code, split_part(price, ' ', 2) FROM raw_a WHERE split_part(price, ' ', 2) <> 'None'""",
    ("raw_z", "raw_a"),
)
def filter_unpriced(spark, sf):
    z = staging.split_price(dt.raw_z(spark, sf)).filter(staging.priced_z(F.col("amount")))
    a = staging.split_price(dt.raw_a(spark, sf)).filter(staging.priced_a(F.col("amount")))
    return z.select(F.lit("Z").alias("portal"), F.col("zonaprop_code").alias("code"), "amount").unionAll(
        a.select(F.lit("A").alias("portal"), F.col("argenprop_code").alias("code"), "amount")
    )


@query(
    "fx_normalise",
    f"""SELECT zonaprop_code, split_part(price, ' ', 1) AS currency,
    CASE WHEN split_part(price, ' ', 1) <> 'USD' THEN split_part(price, ' ', 2) END AS pesos_text,
    CASE WHEN split_part(price, ' ', 1) = 'USD' THEN TRY_CAST(replace(split_part(price, ' ', 2), '.', '') AS DOUBLE) * {USD_RATE}::DOUBLE END AS dollars_in_pesos FROM raw_z""",
    ("raw_z",),
)
def fx_normalise(spark, sf):
    parts = staging.split_price(dt.raw_z(spark, sf))
    converted = text.to_pesos(F.col("currency"), F.col("amount"), F.lit(USD_RATE))
    usd = F.col("currency") == "USD"
    return parts.select(
        "zonaprop_code", "currency", F.when(~usd, converted).alias("pesos_text"), F.when(usd, converted.cast("double")).alias("dollars_in_pesos")
    )


@query("features_regex_z", "SELECT zonaprop_code, total_area, rooms, bedrooms, bathrooms, garages FROM stg_z UNION ALL SELECT zonaprop_code, NULL, NULL, NULL, NULL, NULL FROM stg_z WHERE false", ("stg_z",))
def features_regex_z(spark, sf):
    return staging.stage_z(dt.raw_z(spark, sf), USD_RATE).select("zonaprop_code", *text.FEATURE_PATTERNS)


def _feature_a(name, function, sql):
    @query(f"feature_{name}_a", f"SELECT argenprop_code, {sql} AS {name} FROM raw_a", ("raw_a",))
    def run(spark, sf):
        return dt.raw_a(spark, sf).select("argenprop_code", function(F.col("features")).alias(name))


_feature_a("area", text.area_a, "CAST(CAST(total_area AS INT) AS VARCHAR)")
_feature_a("rooms", text.rooms_a, "CAST(CAST(rooms AS INT) AS VARCHAR)")
_feature_a("bedrooms", text.bedrooms_a, "CASE WHEN l_linestatus = 'F' THEN CAST(CAST(bedrooms AS INT) AS VARCHAR) END")
_feature_a("bathrooms", text.bathrooms_a, "CAST(CAST(bathrooms AS INT) AS VARCHAR)")
_feature_a("antiquity", text.antiquity_a, "CASE WHEN l_returnflag = 'A' THEN '0' WHEN bathrooms > 1 THEN '2 b' WHEN l_returnflag = 'N' THEN CAST(CAST(floor(antiquity) AS INT) AS VARCHAR) END")


@query("null_column", "SELECT code, CAST(NULL AS DOUBLE) AS antiquity FROM facts", ("facts",))
def null_column(spark, sf):
    return staging.null_column(dt.facts(spark, sf).select("code"), "antiquity")


@query("drop_columns", "SELECT zonaprop_code, price, location FROM raw_z", ("raw_z",))
def drop_columns(spark, sf):
    rows = dt.raw_z(spark, sf).select(*RAW_Z_COLUMNS)
    return staging.drop_columns(rows, "property_url", "expenses", "address", "features", "description", "created_at", "updated_at")


@query("stamp_audit_dates", f"SELECT zonaprop_code, '{RUN_DATE}' AS created_at, '{RUN_DATE}' AS updated_at FROM raw_z", ("raw_z",))
def stamp_audit_dates(spark, sf):
    return staging.stamp_audit_dates(dt.raw_z(spark, sf).select("zonaprop_code"), RUN_DATE)


@query(
    "cast_all_string",
    "SELECT code, CAST(price AS VARCHAR) AS price, CAST(total_area AS VARCHAR) AS total_area, CAST(line AS VARCHAR) AS line, CAST(snapshot_date AS VARCHAR) AS snapshot_date FROM facts",
    ("facts",),
)
def cast_all_string(spark, sf):
    return staging.cast_all_string(dt.facts(spark, sf).select("code", "price", "total_area", "line", "snapshot_date"))


# ---- cleaning and imputation ----------------------------------------------------------------

_STG = "property_url, price, neighborhood, description, total_area, rooms, bedrooms, bathrooms, garages, antiquity"


def _stg_z(spark, sf):
    return staging.stage_z(dt.raw_z(spark, sf), USD_RATE)


@query(
    "union_portals",
    f"SELECT zonaprop_code, CAST(NULL AS VARCHAR) AS argenprop_code, {_STG} FROM stg_z UNION ALL SELECT NULL, argenprop_code, {_STG} FROM stg_a",
    ("stg_z", "stg_a"),
)
def union_portals(spark, sf):
    both = cleaning.union_portals(_stg_z(spark, sf), staging.stage_a(dt.raw_a(spark, sf), USD_RATE))
    return both.select("zonaprop_code", "argenprop_code", *_STG.split(", "))


@query(
    "parse_price_text",
    f"""SELECT code AS zonaprop_code, CASE l_returnflag WHEN 'A' THEN floor(price / 100) * {USD_RATE}::DOUBLE ELSE floor(price * 10) END AS price
    FROM facts WHERE l_returnflag <> 'R'""",
    ("facts",),
)
def parse_price_text(spark, sf):
    return cleaning.parse_price_text(_stg_z(spark, sf)).select("zonaprop_code", "price")


@query(
    "parse_price_text_literal",
    "SELECT zonaprop_code, TRY_CAST(replace(replace(price, '.000', '000'), '.0', '') AS DOUBLE) AS price FROM stg_z",
    ("stg_z",),
)
def parse_price_text_literal(spark, sf):
    return cleaning.parse_price_text(_stg_z(spark, sf), literal=True).select("zonaprop_code", "price")


@query(
    "coerce_numeric",
    """SELECT code, CASE WHEN line < 7 THEN rooms END AS rooms, CASE WHEN l_returnflag = 'N' THEN price END AS price, total_area FROM facts""",
    ("facts",),
)
def coerce_numeric(spark, sf):
    as_text = dt.facts(spark, sf).select(
        "code",
        F.when(F.col("line") < 7, F.col("rooms").cast("string")).otherwise(F.lit("7 amb")).alias("rooms"),
        F.when(F.col("l_returnflag") == "N", F.col("price").cast("string")).otherwise(F.lit("consultar")).alias("price"),
        F.col("total_area").cast("string").alias("total_area"),
    )
    return cleaning.coerce_numeric(as_text, ["rooms", "price", "total_area"])


@query("fill_garages_zero", "SELECT zonaprop_code, coalesce(garages, 0) AS garages FROM stg_z", ("stg_z",))
def fill_garages_zero(spark, sf):
    return cleaning.fill_garages_zero(_stg_z(spark, sf)).select("zonaprop_code", "garages")


@query(
    "drop_missing_price_area",
    """, gaps AS (SELECT code, CASE WHEN rooms <> 3 THEN price END AS price, CASE WHEN rooms <> 5 THEN total_area END AS total_area FROM facts)
    SELECT code, price, total_area FROM gaps WHERE price IS NOT NULL AND total_area IS NOT NULL""",
    ("facts",),
)
def drop_missing_price_area(spark, sf):
    """The listings have neither gap, so prices and areas are blanked for two room numbers first."""
    gaps = dt.facts(spark, sf).withColumns(
        {"price": F.when(F.col("rooms") != 3, F.col("price")), "total_area": F.when(F.col("rooms") != 5, F.col("total_area"))}
    )
    return cleaning.drop_missing(gaps, "price", "total_area").select("code", "price", "total_area")


@query("lowercase_description", "SELECT zonaprop_code, lower(description) AS description FROM stg_z", ("stg_z",))
def lowercase_description(spark, sf):
    return cleaning.lowercase_description(_stg_z(spark, sf)).select("zonaprop_code", "description")


_STUDIO = """, low AS (SELECT * REPLACE (lower(description) AS description) FROM stg_z),
studio AS (SELECT * REPLACE (CASE WHEN contains(description, 'monoambiente') THEN coalesce(bedrooms, 1) ELSE bedrooms END AS bedrooms,
  CASE WHEN contains(description, 'monoambiente') THEN coalesce(rooms, 1) ELSE rooms END AS rooms,
  CASE WHEN contains(description, 'monoambiente') THEN coalesce(bathrooms, 1) ELSE bathrooms END AS bathrooms) FROM low),
roomed AS (SELECT * REPLACE (coalesce(rooms, CAST(nullif(regexp_extract(description, '([1-9]|10) ?(?:amb|dor)', 1), '') AS DOUBLE)) AS rooms) FROM studio),
kept AS (SELECT * FROM roomed WHERE rooms IS NOT NULL),
bedded AS (SELECT * REPLACE (CASE coalesce(bedrooms, rooms - 1) WHEN 0 THEN 1 ELSE coalesce(bedrooms, rooms - 1) END AS bedrooms) FROM kept),
bathed AS (SELECT * REPLACE (coalesce(bathrooms, CASE WHEN rooms IN (1, 2, 3) THEN 1 WHEN rooms IN (4, 5, 6) THEN 2 ELSE 3 END) AS bathrooms) FROM bedded)
"""


def _studio(spark, sf):
    return cleaning.fill_studio(cleaning.lowercase_description(_stg_z(spark, sf)))


def _with_rooms(spark, sf):
    return cleaning.drop_missing(cleaning.fill_rooms_from_text(_studio(spark, sf)), "rooms")


@query("fill_studio", _STUDIO + "SELECT zonaprop_code, rooms, bedrooms, bathrooms FROM studio", ("stg_z",))
def fill_studio(spark, sf):
    return _studio(spark, sf).select("zonaprop_code", "rooms", "bedrooms", "bathrooms")


@query("fill_rooms_from_text", _STUDIO + "SELECT zonaprop_code, description, rooms FROM roomed", ("stg_z",))
def fill_rooms_from_text(spark, sf):
    return cleaning.fill_rooms_from_text(_studio(spark, sf)).select("zonaprop_code", "description", "rooms")


@query("drop_missing_rooms", _STUDIO + "SELECT zonaprop_code, rooms FROM kept", ("stg_z",))
def drop_missing_rooms(spark, sf):
    return _with_rooms(spark, sf).select("zonaprop_code", "rooms")


@query("derive_bedrooms", _STUDIO + "SELECT zonaprop_code, rooms, bedrooms FROM bedded", ("stg_z",))
def derive_bedrooms(spark, sf):
    return cleaning.derive_bedrooms(_with_rooms(spark, sf)).select("zonaprop_code", "rooms", "bedrooms")


@query("derive_bathrooms", _STUDIO + "SELECT zonaprop_code, rooms, bathrooms FROM bathed", ("stg_z",))
def derive_bathrooms(spark, sf):
    return cleaning.derive_bathrooms(_with_rooms(spark, sf)).select("zonaprop_code", "rooms", "bathrooms")


@query(
    "impute_group_mean",
    "SELECT code, raw_neighborhood, ceil(coalesce(antiquity, avg(antiquity) OVER (PARTITION BY raw_neighborhood))) AS antiquity FROM facts",
    ("facts",),
)
def impute_group_mean(spark, sf):
    rows = dt.facts(spark, sf).select("code", "raw_neighborhood", "antiquity")
    return cleaning.impute_group_mean(rows, "antiquity", "raw_neighborhood")


_AGES = ", ".join(f"('{name}', {age})" for name, age in dims.TYPICAL_AGE.items())


@query(
    "impute_lookup",
    f""", ages(raw_neighborhood, age) AS (VALUES {_AGES})
    SELECT code, raw_neighborhood, coalesce(antiquity, age, 50) AS antiquity FROM facts LEFT JOIN ages USING (raw_neighborhood)""",
    ("facts",),
)
def impute_lookup(spark, sf):
    rows = dt.facts(spark, sf).select("code", "raw_neighborhood", "antiquity")
    return cleaning.impute_lookup(rows, "antiquity", "raw_neighborhood")


@query("map_neighborhood", "SELECT code, raw_neighborhood, neighborhood FROM facts", ("facts",))
def map_neighborhood(spark, sf):
    rows = dt.facts(spark, sf).select("code", "raw_neighborhood")
    return neighborhoods.map_neighborhood(rows, "raw_neighborhood", "neighborhood")


@query(
    "map_neighborhood_short",
    "SELECT code, raw_neighborhood, CASE WHEN raw_neighborhood IN ('Palermo Hollywood', 'La Boca') THEN 'OTRO' ELSE neighborhood END AS neighborhood FROM facts",
    ("facts",),
)
def map_neighborhood_short(spark, sf):
    rows = dt.facts(spark, sf).select("code", "raw_neighborhood")
    return neighborhoods.map_neighborhood(rows, "raw_neighborhood", "neighborhood", long_aliases=False)


@query("drop_unmapped", "SELECT code, neighborhood FROM facts WHERE neighborhood <> 'OTRO'", ("facts",))
def drop_unmapped(spark, sf):
    return neighborhoods.drop_unmapped(dt.facts(spark, sf).select("code", "neighborhood"))


@query("min_value_filter", "SELECT code, price, total_area FROM facts WHERE price > 1000 AND total_area > 10", ("facts",))
def min_value_filter(spark, sf):
    return cleaning.min_value_filter(dt.facts(spark, sf).select("code", "price", "total_area"))


_FENCE = """SELECT q1 - 1.5::DOUBLE * (q3 - q1) AS lo, q3 + 1.5::DOUBLE * (q3 - q1) AS hi FROM (SELECT quantile_cont({c}, 0.25::DOUBLE) AS q1, quantile_cont({c}, 0.75::DOUBLE) AS q3 FROM {t})"""


@query("iqr_outlier_filter", f"WITH b AS ({_FENCE.format(c='value', t='events')}) SELECT event_id, event_type, value FROM events, b WHERE value BETWEEN lo AND hi")
def iqr_outlier_filter(spark, sf):
    events = dt.read(spark, sf, "events").select("event_id", "event_type", "value")
    return cleaning.iqr_outlier_filter(events, "value")


@query(
    "iqr_price_then_area",
    f""", m AS (SELECT * FROM facts WHERE price > 1000 AND total_area > 10), b1 AS ({_FENCE.format(c='price', t='m')}),
    p AS (SELECT m.* FROM m, b1 WHERE price BETWEEN lo AND hi), b2 AS ({_FENCE.format(c='total_area', t='p')})
    SELECT code, price, total_area FROM p, b2 WHERE total_area BETWEEN lo AND hi""",
    ("facts",),
)
def iqr_price_then_area(spark, sf):
    return flows.without_outliers(dt.facts(spark, sf).select("code", "price", "total_area"))


@query(
    "outlier_count",
    f"""WITH b AS ({_FENCE.format(c='value', t='events')}) SELECT round(any_value(lo), 4) AS lower_bound, round(any_value(hi), 4) AS upper_bound,
    count_if(value < lo OR value > hi)::BIGINT AS outliers, count(*) AS rows_before, count_if(value BETWEEN lo AND hi)::BIGINT AS rows_after FROM events, b""",
)
def outlier_count(spark, sf):
    return rounded(cleaning.outlier_report(dt.read(spark, sf, "events"), "value"), 4, "lower_bound", "upper_bound")


_FLAGS = ", ".join(f"CAST(neighborhood = '{n}' AS INT) AS \"neighborhood_{n}\"" for n in dims.VALID_NEIGHBORHOODS)


@query("one_hot_neighborhood", f"SELECT code, {_FLAGS} FROM facts", ("facts",))
def one_hot_neighborhood(spark, sf):
    return cleaning.one_hot_neighborhood(dt.facts(spark, sf).select("code", "neighborhood")).drop("neighborhood")


STOCK_SQL = """, stock AS (SELECT code AS "Codigo", CASE WHEN line = 6 THEN 0 WHEN line < 6 THEN price END AS amount, l_returnflag = 'A' AS usd, l_linestatus = 'F' AS rental,
  neighborhood <> 'OTRO' AS located, garages = 0 AS home, total_area AS covered, CASE WHEN bathrooms > 1 THEN total_area + 5 END AS total, line, rooms, antiquity, raw_neighborhood FROM facts),
kept AS (SELECT * FROM stock WHERE amount IS NOT NULL AND amount <> 0 AND rental AND located AND home),
area AS (SELECT *, coalesce(total, covered) AS a FROM kept WHERE coalesce(total, covered) <> 0),
roomed AS (SELECT *, CASE WHEN line IN (2, 3) THEN CASE WHEN a < 30 THEN 1 WHEN a < 50 THEN 2 WHEN a < 80 THEN 3 WHEN a < 120 THEN 4 WHEN a < 200 THEN 5 ELSE 6 END ELSE rooms END::DOUBLE AS r FROM area)
"""


@query("stock_filters", STOCK_SQL + 'SELECT "Codigo", amount AS "MontoOperacion", covered AS "SuperficieCubierta" FROM kept', ("facts",))
def stock_filters(spark, sf):
    return cleaning.stock_filters(dt.stock(spark, sf)).select("Codigo", "MontoOperacion", "SuperficieCubierta")


@query("coalesce_area", STOCK_SQL + 'SELECT "Codigo", a AS "PropiedadSuperficieTotal" FROM area', ("facts",))
def coalesce_area(spark, sf):
    return cleaning.coalesce_area(cleaning.stock_filters(dt.stock(spark, sf))).select("Codigo", "PropiedadSuperficieTotal")


def _roomed_stock(spark, sf):
    return cleaning.rooms_from_area(cleaning.coalesce_area(cleaning.stock_filters(dt.stock(spark, sf))))


@query("rooms_from_area", STOCK_SQL + 'SELECT "Codigo", a AS "PropiedadSuperficieTotal", r AS "CantidadDormitorios" FROM roomed', ("facts",))
def rooms_from_area(spark, sf):
    return _roomed_stock(spark, sf).select("Codigo", "PropiedadSuperficieTotal", "CantidadDormitorios")


@query(
    "stock_defaults",
    STOCK_SQL + 'SELECT "Codigo", r AS rooms, CASE WHEN r = 1 THEN 2 ELSE r - 1 END::DOUBLE AS bedrooms, 1 AS bathrooms, 1 AS garages FROM roomed',
    ("facts",),
)
def stock_defaults(spark, sf):
    rows = _roomed_stock(spark, sf).select("Codigo", F.col("CantidadDormitorios").alias("rooms"))
    return cleaning.stock_defaults(rows)


@query(
    "stock_listings",
    STOCK_SQL + """, aged AS (SELECT *, ceil(coalesce(antiquity, avg(antiquity) OVER (PARTITION BY raw_neighborhood))) AS age FROM kept)
    SELECT aged."Codigo" AS argenprop_code, CASE WHEN usd THEN amount * 1225 ELSE amount END::DOUBLE AS original_price, coalesce(total, covered) AS total_area, age AS antiquity, n.neighborhood
    FROM aged JOIN names n USING (raw_neighborhood) WHERE coalesce(total, covered) <> 0""",
    ("facts",),
)
def stock_listings(spark, sf):
    return flows.stock_listings(dt.stock(spark, sf)).select("argenprop_code", "original_price", "total_area", "antiquity", "neighborhood")


_CLEAN = f"""{_STUDIO}, short AS (SELECT nk, raw_neighborhood, CASE WHEN raw_neighborhood IN ('Palermo Hollywood', 'La Boca') THEN 'OTRO' ELSE neighborhood END AS mapped FROM names),
ages(neighborhood, age) AS (VALUES {_AGES}),
clean AS (SELECT zonaprop_code, snapshot_date, neighborhood AS written, TRY_CAST(regexp_replace(price, '\\.(\\d{{3}})', '\\1', 'g') AS DOUBLE) AS price, total_area, rooms, bedrooms, bathrooms,
  coalesce(garages, 0) AS garages, coalesce(age, 50)::DOUBLE AS antiquity FROM bathed LEFT JOIN ages USING (neighborhood)),
m AS (SELECT * FROM clean WHERE price > 1000 AND total_area > 10), b1 AS ({_FENCE.format(c='price', t='m')}),
p AS (SELECT m.* FROM m, b1 WHERE price BETWEEN lo AND hi), b2 AS ({_FENCE.format(c='total_area', t='p')}),
done AS (SELECT p.*, mapped FROM p JOIN b2 ON total_area BETWEEN lo AND hi JOIN short ON raw_neighborhood = written WHERE mapped <> 'OTRO')
"""


@query(
    "report_listings",
    _CLEAN + "SELECT zonaprop_code, mapped AS neighborhood, price, total_area, rooms, bedrooms, bathrooms, garages, antiquity FROM done",
    ("stg_z",),
)
def report_listings(spark, sf):
    rows = flows.report_listings(dt.stored(dt.raw_z(spark, sf)), USD_RATE)
    return rows.select("zonaprop_code", "neighborhood", "price", "total_area", "rooms", "bedrooms", "bathrooms", "garages", "antiquity")


_BOTH = ", both_ AS (SELECT * EXCLUDE (zonaprop_code) FROM stg_z UNION ALL BY NAME SELECT * EXCLUDE (argenprop_code) FROM stg_a)" + _STUDIO.replace("FROM stg_z)", "FROM both_)")


@query(
    "training_table",
    _BOTH + f""", ages(neighborhood, age) AS (VALUES {_AGES}),
    clean AS (SELECT neighborhood AS written, TRY_CAST(regexp_replace(price, '\\.(\\d{{3}})', '\\1', 'g') AS DOUBLE) AS price, total_area, rooms, bedrooms, bathrooms, coalesce(garages, 0) AS garages,
      coalesce(ceil(coalesce(antiquity, avg(antiquity) OVER (PARTITION BY neighborhood))), age, 50)::DOUBLE AS antiquity FROM bathed LEFT JOIN ages USING (neighborhood)),
    m AS (SELECT clean.*, names.neighborhood FROM clean JOIN names ON raw_neighborhood = written WHERE names.neighborhood <> 'OTRO' AND price > 1000 AND total_area > 10), b1 AS ({_FENCE.format(c='price', t='m')}),
    p AS (SELECT m.* FROM m, b1 WHERE price BETWEEN lo AND hi), b2 AS ({_FENCE.format(c='total_area', t='p')})
    SELECT neighborhood, price, total_area, rooms, bedrooms, bathrooms, garages, antiquity FROM p, b2 WHERE total_area BETWEEN lo AND hi""",
    ("stg_z", "stg_a"),
)
def training_table(spark, sf):
    stg_z = staging.stage_z(dt.stored(dt.raw_z(spark, sf)), USD_RATE)
    stg_a = staging.stage_a(dt.stored(dt.raw_a(spark, sf)), USD_RATE)
    table = flows.training_table(stg_z, stg_a)
    return table.select("neighborhood", "price", "total_area", "rooms", "bedrooms", "bathrooms", "garages", "antiquity")
