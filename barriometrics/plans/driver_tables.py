"""Listing-shaped views over the benchmark tables.

The benchmark ships orders, line items, events and pages rather than rental listings. Each view
here reads whole tables and only renames, joins or formats columns, so an operator meets the same
number of rows as the table it reads.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from barriometrics.dims import constant_table
from barriometrics.session import materialise
from barriometrics.sources.readers import spread

# Nation key -> (neighbourhood as a listing writes it, reported neighbourhood).
NATION_NEIGHBORHOODS = (
    (0, "Palermo", "PALERMO"),
    (1, "Palermo Hollywood", "PALERMO"),
    (2, "Recoleta", "RECOLETA"),
    (3, "Belgrano", "BELGRANO"),
    (4, "Belgrano R", "BELGRANO"),
    (5, "Caballito Norte", "CABALLITO"),
    (6, "Almagro", "ALMAGRO"),
    (7, "Villa Crespo", "VILLA CRESPO"),
    (8, "Núñez", "NUNEZ"),
    (9, "Puerto Madero", "PUERTO MADERO"),
    (10, "Retiro", "RETIRO"),
    (11, "San Telmo", "SAN TELMO"),
    (12, "Balvanera", "BALVANERA"),
    (13, "Villa Urquiza", "VILLA URQUIZA"),
    (14, "Colegiales", "COLEGIALES"),
    (15, "Flores Sur", "FLORES"),
    (16, "Centro / Microcentro", "SAN NICOLAS"),
    (17, "Monserrat", "MONTSERRAT"),
    (18, "La Boca", "SAN TELMO"),
    (19, "Villa Devoto", "VILLA CRESPO"),
    (20, "Abasto", "CABALLITO"),
    (21, "Barrio Norte", "RECOLETA"),
    (22, "Parque Chas", "PARQUE PATRICIOS"),
    (23, "Quilmes", "OTRO"),
    (24, "Almagro Norte", "ALMAGRO"),
)
SNAPSHOT_SPLIT = "1998-07-01"
OLD_SNAPSHOT, NEW_SNAPSHOT = "1998-06-30", "2001-12-31"
SITE_Z = "https://www.zonaprop.com.ar"
SITE_A = "https://www.argenprop.com"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def facts(spark: SparkSession, sf_dir: str, for_texts: bool = False) -> DataFrame:
    """One typed row per line item: the listing that the text views below spell out."""
    names = constant_table(spark, NATION_NEIGHBORHOODS, "s_nationkey, raw_neighborhood, neighborhood")
    items = read(spark, sf_dir, "lineitem")
    if for_texts:
        items = spread(items)
    suppliers = read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    number = lambda c: F.col(c).cast("double")
    return (
        items.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(names, "s_nationkey")
        .select(
            F.col("l_orderkey").cast("string").alias("code"),
            "raw_neighborhood",
            "neighborhood",
            F.col("l_extendedprice").alias("price"),
            (F.col("l_quantity") * 3).alias("total_area"),
            number("l_linenumber").alias("rooms"),
            F.when(F.col("l_linestatus") == "F", number("l_linenumber") - 1).alias("bedrooms"),
            F.when(F.col("l_tax") >= 0.05, 2.0).otherwise(1.0).alias("bathrooms"),
            F.when(F.col("l_discount") > 0.07, 1.0).otherwise(0.0).alias("garages"),
            F.when(F.col("l_returnflag") != "R", F.col("l_quantity") + 0.5).alias("antiquity"),
            F.when(F.col("l_shipdate") < F.lit(SNAPSHOT_SPLIT).cast("timestamp"), F.lit(OLD_SNAPSHOT))
            .otherwise(F.lit(NEW_SNAPSHOT))
            .cast("date")
            .alias("snapshot_date"),
            "l_returnflag",
            "l_linestatus",
            F.col("l_linenumber").alias("line"),
            F.col("l_partkey").alias("part"),
            F.col("l_suppkey").alias("supplier"),
            F.col("l_shipdate").alias("shipped"),
        )
    )


def old_and_new(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The two snapshots of the mapped listings; every line item is in one of them."""
    mapped = facts(spark, sf_dir).filter(F.col("neighborhood") != "OTRO")
    is_new = F.col("snapshot_date") == F.lit(NEW_SNAPSHOT).cast("date")
    return mapped.filter(~is_new), mapped.filter(is_new)


def stored(texts: DataFrame) -> DataFrame:
    """Texts as a written RAW table, which the flows start from; filters then meet columns, not
    the expressions that spell the texts."""
    return materialise(texts, "raw")


def _dotted(amount) -> object:
    return F.replace(F.format_number(amount, 0), F.lit(","), F.lit("."))


def raw_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Portal Z texts: thousands with dots, dollars for some, 'Consultar precio' for some."""
    pesos = F.floor(F.col("price") * 10)
    dollars = F.floor(F.col("price") / 100)
    whole = lambda c: F.col(c).cast("int").cast("string")
    return facts(spark, sf_dir, for_texts=True).select(
        F.concat(F.lit(f"{SITE_Z}/propiedades/depto-"), "part", F.lit("-"), "code", F.lit(".html")).alias("property_url"),
        F.col("code").alias("zonaprop_code"),
        F.when(F.col("l_returnflag") == "R", F.lit("Consultar precio"))
        .when(F.col("l_returnflag") == "A", F.concat(F.lit("USD "), _dotted(dollars)))
        .otherwise(F.concat(F.lit("$ "), _dotted(pesos)))
        .alias("price"),
        F.when(F.col("l_linestatus") == "F", F.concat(F.lit("$ "), _dotted(F.floor(F.col("price"))), F.lit(" Expensas"))).alias("expenses"),
        F.lit(None).cast("string").alias("address"),
        F.concat("raw_neighborhood", F.lit(", Capital Federal")).alias("location"),
        F.concat_ws(
            " ",
            F.concat(whole("total_area"), F.lit(" m² tot.")),
            F.when(F.col("l_linestatus") == "F", F.concat(whole("rooms"), F.lit(" amb."))),
            F.when(F.col("l_returnflag") == "N", F.concat(whole("bedrooms"), F.lit(" dorm."))),
            F.when(F.col("garages") > 0, F.concat(whole("bathrooms"), F.lit(" baños"))),
            F.when(F.col("garages") > 0, F.concat(whole("garages"), F.lit(" coch."))),
        ).alias("features"),
        F.when(F.col("line") == 1, F.lit("Monoambiente luminoso"))
        .when(F.col("line") == 7, F.lit("Gran departamento"))
        .otherwise(F.concat(F.lit("Depto "), whole("rooms"), F.lit(" Amb con balcón")))
        .alias("description"),
        "snapshot_date",
        "part", "supplier", "line", "shipped",
    )


def raw_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Portal A texts: the neighbourhood may stand behind the comma, features are a list."""
    pesos = F.floor(F.col("price") * 10)
    dollars = F.floor(F.col("price") / 100)
    whole = lambda c: F.col(c).cast("int").cast("string")
    return facts(spark, sf_dir, for_texts=True).select(
        F.concat(F.lit(f"{SITE_A}/depto-"), "part", F.lit("--"), "code").alias("property_url"),
        F.col("code").alias("argenprop_code"),
        F.when(F.col("l_returnflag") == "R", F.lit("None None"))
        .when(F.col("l_returnflag") == "A", F.concat(F.lit("USD "), _dotted(dollars)))
        .otherwise(F.concat(F.lit("$ "), _dotted(pesos)))
        .alias("price"),
        F.when(F.col("l_linestatus") == "F", F.concat(F.lit("$"), _dotted(F.floor(F.col("price"))), F.lit(" expensas"))).alias("expenses"),
        F.concat(F.lit("Calle "), F.col("supplier").cast("string")).alias("address"),
        F.when(F.col("garages") > 0, F.concat(F.lit("Departamento en Alquiler en Zona, "), "raw_neighborhood"))
        .otherwise(F.concat(F.lit("Departamento en Alquiler en "), "raw_neighborhood", F.lit(", Capital Federal")))
        .alias("location"),
        F.array_compact(
            F.array(
                F.concat(whole("total_area"), F.lit(" m² cubie.")),
                F.when(F.col("line") == 1, F.lit("Monoam.")).otherwise(F.concat(whole("rooms"), F.lit(" ambientes"))),
                F.when(F.col("l_linestatus") == "F", F.concat(whole("bedrooms"), F.lit(" dorm."))),
                F.concat(whole("bathrooms"), F.when(F.col("bathrooms") > 1, F.lit(" baños")).otherwise(F.lit(" baño"))),
                F.when(F.col("l_returnflag") == "N", F.concat(whole("antiquity"), F.lit(" años"))).when(
                    F.col("l_returnflag") == "A", F.lit("A Estrenar")
                ),
            )
        ).alias("features"),
        F.when(F.col("line") == 1, F.lit("Monoambiente")).otherwise(F.lit("Departamento")).alias("description"),
        "snapshot_date",
        "part", "supplier", "line", "shipped",
    )


def page_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with the links of their menu: ``items`` is an array of (href, label)."""
    pages = spread(read(spark, sf_dir, "pages"))
    link = r'<li><a href="([^"]*)">([^<]*)</a></li>'
    return pages.select(
        "page_id",
        "url",
        F.arrays_zip(
            F.regexp_extract_all("html", F.lit(link), 1).alias("href"),
            F.regexp_extract_all("html", F.lit(link), 2).alias("label"),
        ).alias("items"),
    )


def card_pages(spark: SparkSession, sf_dir: str, portal: str) -> DataFrame:
    """Result pages of a portal whose cards are the menu links of the benchmark's pages."""
    def card_z(item, i):
        return F.concat(
            F.lit('<div class="postingCardLayout-module__posting-card-container x1"><div class="p" data-qa="POSTING_CARD_PRICE"> $ '),
            (i + 1).cast("string"),
            F.lit('.000 </div><div data-qa="expensas">$ 5.000 Expensas</div><h2 data-qa="POSTING_CARD_LOCATION">'),
            item.label,
            F.lit(', Capital Federal</h2><h3 data-qa="POSTING_CARD_FEATURES"><span>45 m² tot.</span> <span>2 amb.</span></h3>'
                  '<h3 class="postingCard-module__posting-description" data-qa="POSTING_CARD_DESCRIPTION"><a href="'),
            item.href, F.lit("-"), (i + 100).cast("string"), F.lit('.html">Luminoso &amp; amplio<br></a></h3></div>'),
        )

    def card_a(item, i):
        return F.concat(
            F.lit('<div class="listing__item x1"><a class="card" href="'),
            item.href, F.lit("--"), (i + 100).cast("string"),
            F.lit('"><p class="card__price"><span class="card__currency">$</span> '),
            (i + 1).cast("string"),
            F.lit('.000 <span class="card__expenses"> + $5.000 expensas</span></p><p class="card__address">Calle 1</p>'
                  '<p class="card__title--primary show">Departamento en Alquiler en '),
            item.label,
            F.lit(', Capital Federal</p><ul class="card__main-features"><li>45 m² cubie.</li><li> '),
            (i + 1).cast("string"),
            F.lit(' ambientes</li></ul><h2 class="card__title">Depto &amp; balcón</h2></a></div>'),
        )

    container = "postingsList-module__postings-container" if portal == "Z" else "listing-container"
    card = card_z if portal == "Z" else card_a
    return page_items(spark, sf_dir).select(
        "page_id",
        "url",
        F.concat(
            F.lit(f'<html><body><div class="{container}">'),
            F.array_join(F.transform("items", card), ""),
            F.lit("</div></body></html>"),
        ).alias("html"),
    )


def crawl_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result pages in crawl order: the customer's neighbourhood is the crawl, the order the page."""
    orders = read(spark, sf_dir, "orders")
    return orders.select(
        (F.col("o_custkey")).cast("string").alias("barrio"),
        F.col("o_orderkey").alias("page"),
        F.when(F.col("o_orderpriority") == "5-LOW", F.lit("https://host/x"))
        .otherwise(F.concat(F.lit("https://host/x?pagina-"), F.floor(F.col("o_totalprice")).cast("string")))
        .alias("final_url"),
        F.array(F.col("o_orderstatus")).alias("ids"),
    )


def historic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly median prices: the order priority plays the property type."""
    orders = read(spark, sf_dir, "orders")
    customers = read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select(
        F.date_format("o_orderdate", "yyyy-MM").alias("Mes"),
        F.col("c_mktsegment").alias("Barrio"),
        F.when(F.col("o_orderpriority") == "1-URGENT", F.lit("Oficina"))
        .when(F.col("o_orderpriority") == "2-HIGH", F.lit("Local"))
        .otherwise(F.lit("Departamento"))
        .alias("Inmueble"),
        (F.col("o_totalprice") / 40).alias("mediana_por_m2"),
        F.col("o_totalprice").alias("mediana_precio"),
    )


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Map elements with tags; failed events carry no amenity, few of them a transit name."""
    events = read(spark, sf_dir, "events")
    kind = F.col("event_type")
    k = F.get_json_object("props", "$.k").cast("int")
    amenity = F.when(kind == "view", "library").when(kind == "signup", "courthouse").when(kind == "click", "cafe").when(
        kind == "purchase", "bank"
    )
    name = F.when(k < 50, F.concat(F.lit("Línea "), k.cast("string"))).when(k < 80, F.concat(F.lit("Lugar "), k.cast("string")))
    return events.select(
        F.col("event_id").alias("place_id"),
        F.map_filter(
            F.create_map(F.lit("amenity"), amenity, F.lit("name"), name), lambda _, v: v.isNotNull()
        ).alias("tags"),
        F.when(k < 90, F.col("value")).alias("lat"),
        F.col("user_id").cast("double").alias("lon"),
    )


def stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A portal's own stock table, with the gaps the cleaning has to fill."""
    f = facts(spark, sf_dir)
    return f.select(
        F.col("code").alias("Codigo"),
        F.when(F.col("line") == 6, F.lit(0.0)).when(F.col("line") < 6, F.col("price")).alias("MontoOperacion"),
        F.when(F.col("l_returnflag") == "A", F.lit("Dolares")).otherwise(F.lit("Pesos")).alias("Nombre"),
        F.when(F.col("l_linestatus") == "F", F.lit("Alquiler")).otherwise(F.lit("Venta")).alias("TipoOperacion"),
        F.lit("Argentina").alias("Pais"),
        F.lit("Capital Federal").alias("Provincia"),
        F.when(F.col("neighborhood") != "OTRO", F.col("raw_neighborhood")).alias("Barrio"),
        F.when(F.col("garages") > 0, F.lit("Local")).otherwise(F.lit("Departamento")).alias("TipoPropiedad"),
        F.col("total_area").alias("SuperficieCubierta"),
        F.when(F.col("bathrooms") > 1, F.col("total_area") + 5).alias("PropiedadSuperficieTotal"),
        F.when(F.col("line") == 2, F.lit(0.0)).when(F.col("line") != 3, F.col("rooms")).alias("CantidadDormitorios"),
        F.col("antiquity").alias("Antiguedad"),
    )
