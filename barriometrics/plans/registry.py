"""Named queries over the benchmark tables, each with the SQL that checks it where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from barriometrics.plans import driver_tables as dt

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
USD_RATE = 1027.5
RUN_DATE = "2001-08-01"

_NAMES = ", ".join(f"({k}, '{raw}', '{name}')" for k, raw, name in dt.NATION_NEIGHBORHOODS)

# The same derivations as driver_tables, in SQL.
VIEWS = {
    "names": f"names(nk, raw_neighborhood, neighborhood) AS (VALUES {_NAMES})",
    "facts": f"""facts AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS code, raw_neighborhood, neighborhood, l_extendedprice AS price,
    l_quantity * 3 AS total_area, CAST(l_linenumber AS DOUBLE) AS rooms,
    CASE WHEN l_linestatus = 'F' THEN CAST(l_linenumber AS DOUBLE) - 1 END AS bedrooms,
    CASE WHEN l_tax >= 0.05 THEN CAST(2 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS bathrooms,
    CASE WHEN l_discount > 0.07 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS garages,
    CASE WHEN l_returnflag <> 'R' THEN l_quantity + CAST(0.5 AS DOUBLE) END AS antiquity,
    CASE WHEN l_shipdate < TIMESTAMP '{dt.SNAPSHOT_SPLIT}' THEN DATE '{dt.OLD_SNAPSHOT}' ELSE DATE '{dt.NEW_SNAPSHOT}' END AS snapshot_date,
    l_returnflag, l_linestatus, l_linenumber AS line, l_partkey AS part, l_suppkey AS supplier, l_shipdate AS shipped
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN names ON s_nationkey = nk)""",
    "snaps": f"""mapped AS (SELECT * FROM facts WHERE neighborhood <> 'OTRO'),
olds AS (SELECT * FROM mapped WHERE snapshot_date = DATE '{dt.OLD_SNAPSHOT}'),
news AS (SELECT * FROM mapped WHERE snapshot_date = DATE '{dt.NEW_SNAPSHOT}')""",
    "raw_z": f"""raw_z AS (
  SELECT '{dt.SITE_Z}/propiedades/depto-' || part || '-' || code || '.html' AS property_url, code AS zonaprop_code,
    CASE l_returnflag WHEN 'R' THEN 'Consultar precio'
      WHEN 'A' THEN 'USD ' || replace(format('{{:,}}', CAST(floor(price / 100) AS BIGINT)), ',', '.')
      ELSE '$ ' || replace(format('{{:,}}', CAST(floor(price * 10) AS BIGINT)), ',', '.') END AS price,
    CASE WHEN l_linestatus = 'F' THEN '$ ' || replace(format('{{:,}}', CAST(floor(price) AS BIGINT)), ',', '.') || ' Expensas' END AS expenses,
    CAST(NULL AS VARCHAR) AS address, raw_neighborhood || ', Capital Federal' AS location,
    concat_ws(' ', CAST(total_area AS INT) || ' m² tot.',
      CASE WHEN l_linestatus = 'F' THEN CAST(rooms AS INT) || ' amb.' END,
      CASE WHEN l_returnflag = 'N' THEN CAST(bedrooms AS INT) || ' dorm.' END,
      CASE WHEN garages > 0 THEN CAST(bathrooms AS INT) || ' baños' END,
      CASE WHEN garages > 0 THEN CAST(garages AS INT) || ' coch.' END) AS features,
    CASE line WHEN 1 THEN 'Monoambiente luminoso' WHEN 7 THEN 'Gran departamento'
      ELSE 'Depto ' || CAST(rooms AS INT) || ' Amb con balcón' END AS description,
    snapshot_date, part, supplier, line, shipped
  FROM facts)""",
    "raw_a": f"""raw_a AS (
  SELECT '{dt.SITE_A}/depto-' || part || '--' || code AS property_url, code AS argenprop_code,
    CASE l_returnflag WHEN 'R' THEN 'None None'
      WHEN 'A' THEN 'USD ' || replace(format('{{:,}}', CAST(floor(price / 100) AS BIGINT)), ',', '.')
      ELSE '$ ' || replace(format('{{:,}}', CAST(floor(price * 10) AS BIGINT)), ',', '.') END AS price,
    CASE WHEN l_linestatus = 'F' THEN '$' || replace(format('{{:,}}', CAST(floor(price) AS BIGINT)), ',', '.') || ' expensas' END AS expenses,
    'Calle ' || supplier AS address,
    CASE WHEN garages > 0 THEN 'Departamento en Alquiler en Zona, ' || raw_neighborhood
      ELSE 'Departamento en Alquiler en ' || raw_neighborhood || ', Capital Federal' END AS location,
    list_filter([CAST(total_area AS INT) || ' m² cubie.',
      CASE WHEN line = 1 THEN 'Monoam.' ELSE CAST(rooms AS INT) || ' ambientes' END,
      CASE WHEN l_linestatus = 'F' THEN CAST(bedrooms AS INT) || ' dorm.' END,
      CAST(bathrooms AS INT) || CASE WHEN bathrooms > 1 THEN ' baños' ELSE ' baño' END,
      CASE l_returnflag WHEN 'N' THEN CAST(floor(antiquity) AS INT) || ' años' WHEN 'A' THEN 'A Estrenar' END],
      lambda x: x IS NOT NULL) AS features,
    CASE WHEN line = 1 THEN 'Monoambiente' ELSE 'Departamento' END AS description,
    snapshot_date, part, supplier, line, shipped, l_returnflag, l_linestatus, total_area, rooms, bedrooms, bathrooms,
    garages, antiquity, raw_neighborhood
  FROM facts)""",
    "stg_z": f"""stg_z AS (
  SELECT zonaprop_code, property_url,
    CASE WHEN split_part(price, ' ', 1) = 'USD' THEN
      CASE WHEN usd = floor(usd) THEN CAST(CAST(usd AS BIGINT) AS VARCHAR) || '.0' ELSE regexp_replace(CAST(CAST(usd AS DECIMAL(24,2)) AS VARCHAR), '0+$', '') END
      ELSE split_part(price, ' ', 2) END AS price,
    regexp_extract(expenses, '(\\d{{1,3}}(?:\\.\\d{{3}})*)', 1) AS expenses, address,
    split_part(location, ',', 2) AS location, split_part(location, ',', 1) AS neighborhood, description,
    CAST(nullif(regexp_extract(features, '(\\d+)\\s?m²', 1), '') AS DOUBLE) AS total_area,
    CAST(nullif(regexp_extract(features, '(\\d+)\\s?amb\\.?', 1), '') AS DOUBLE) AS rooms,
    CAST(nullif(regexp_extract(features, '(\\d+)\\s?dorm\\.?', 1), '') AS DOUBLE) AS bedrooms,
    CAST(nullif(regexp_extract(features, '(\\d+)\\s?bañ(?:os|o)', 1), '') AS DOUBLE) AS bathrooms,
    CAST(nullif(regexp_extract(features, '(\\d+)\\s?coch\\.?', 1), '') AS DOUBLE) AS garages,
    CAST(NULL AS DOUBLE) AS antiquity, snapshot_date
  FROM (SELECT *, TRY_CAST(replace(split_part(price, ' ', 2), '.', '') AS DOUBLE) * {USD_RATE}::DOUBLE AS usd FROM raw_z)
  WHERE split_part(price, ' ', 2) <> 'precio')""",
    "stg_a": f"""stg_a AS (
  SELECT argenprop_code, property_url,
    CASE WHEN split_part(price, ' ', 1) = 'USD' THEN
      CASE WHEN usd = floor(usd) THEN CAST(CAST(usd AS BIGINT) AS VARCHAR) || '.0' ELSE regexp_replace(CAST(CAST(usd AS DECIMAL(24,2)) AS VARCHAR), '0+$', '') END
      ELSE split_part(price, ' ', 2) END AS price,
    trim(regexp_replace(expenses, '[$.]|expensas', '', 'g')) AS expenses, address, 'Capital Federal' AS location,
    raw_neighborhood AS neighborhood, description, total_area,
    rooms, bedrooms, bathrooms, CAST(NULL AS DOUBLE) AS garages,
    CASE WHEN l_returnflag = 'A' THEN CAST(0 AS DOUBLE) WHEN l_returnflag = 'N' AND bathrooms = 1 THEN floor(antiquity) END AS antiquity, snapshot_date
  FROM (SELECT *, TRY_CAST(replace(split_part(price, ' ', 2), '.', '') AS DOUBLE) * {USD_RATE}::DOUBLE AS usd FROM raw_a)
  WHERE split_part(price, ' ', 2) <> 'None')""",
    "cards": """cards AS (
  SELECT page_id, url, unnest(hrefs) AS href, unnest(labels) AS label, unnest(range(len(hrefs))) AS pos
  FROM (SELECT page_id, url, regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a></li>', 1) AS hrefs,
    regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a></li>', 2) AS labels FROM pages))""",
    "historic": """historic AS (
  SELECT strftime(o_orderdate, '%Y-%m') AS mes, c_mktsegment AS barrio, o_orderpriority,
    o_totalprice / 40 AS per_m2, o_totalprice AS price
  FROM orders JOIN customer ON o_custkey = c_custkey)""",
    "places": """raw_places AS (
  SELECT event_id AS place_id, CASE event_type WHEN 'view' THEN 'library' WHEN 'signup' THEN 'courthouse' WHEN 'click' THEN 'cafe'
      WHEN 'purchase' THEN 'bank' END AS amenity, CAST(json_extract_string(props, '$.k') AS INT) AS k, value, user_id FROM events),
places AS (
  SELECT place_id, coalesce(amenity, 'Desconocido') AS amenity,
    CASE WHEN k < 50 THEN 'Línea ' || k WHEN k < 80 THEN 'Lugar ' || k ELSE 'Sin nombre' END AS name,
    CASE WHEN k < 90 THEN value ELSE CAST(0 AS DOUBLE) END AS lat, CAST(user_id AS DOUBLE) AS lon FROM raw_places),
grouped AS (
  SELECT *, CASE WHEN amenity = 'Desconocido' AND contains(name, 'Línea') THEN 'transporte' WHEN amenity = 'library' THEN 'sitios_interes'
      WHEN amenity = 'courthouse' THEN 'edificios_administrativos' WHEN amenity = 'cafe' THEN 'restaurantes' END AS place_group FROM places)""",
    "predictions": """predictions AS (
  SELECT code, neighborhood, total_area, rooms, price AS original_price,
    price * (0.35::DOUBLE + rooms * 0.17::DOUBLE) AS simple_prediction,
    price + (total_area - 75) * 200 AS ohe_prediction,
    price * (1 + (rooms - 4) * 0.1::DOUBLE + garages * 0.05::DOUBLE) AS neighborhood_prediction FROM facts),
deviations AS (
  SELECT *, (simple_prediction - original_price) / original_price * 100 AS simple_deviation,
    (ohe_prediction - original_price) / original_price * 100 AS ohe_deviation,
    (neighborhood_prediction - original_price) / original_price * 100 AS neighborhood_deviation FROM predictions)""",
}
_NEEDS = {
    "facts": ("names",), "snaps": ("facts",), "raw_z": ("facts",), "raw_a": ("facts",), "stg_z": ("raw_z",),
    "stg_a": ("raw_a",), "predictions": ("facts",),
}


def with_views(*names: str) -> str:
    """A WITH clause holding the named views and what they need."""
    order: list[str] = []

    def add(name: str) -> None:
        for need in _NEEDS.get(name, ()):
            add(need)
        if name not in order:
            order.append(name)

    for name in names:
        add(name)
    return "WITH " + ",\n".join(VIEWS[n] for n in order) + "\n" if order else ""


def query(name: str, sql: str | None = None, views: tuple[str, ...] = ()) -> Callable[[Query], Query]:
    """Registers a query; ``sql`` may start with further CTEs after a leading comma."""
    def register(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = function
        if sql is not None:
            head = with_views(*views)
            ORACLES[name] = head + sql.strip() if head else sql.strip()
        return function

    return register


def rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n), digits) for n in names})
