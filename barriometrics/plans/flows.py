"""The three end-to-end flows, composed from the operators."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F

from barriometrics.operators import cleaning, crawl, evaluation, extract, models, neighborhoods, staging
from barriometrics.operators.boosting import BoostedTrees
from barriometrics.operators.lookups import attach
from barriometrics.session import materialise

LISTING_COLUMNS = ("price", "neighborhood", "total_area", "rooms", "bedrooms", "bathrooms", "garages", "antiquity")


def finished_crawl(pages: DataFrame, portal: str = "A") -> DataFrame:
    """Pages (barrio, page, final_url, html) up to where each neighbourhood's crawl ends, with their ids.

    It ends at the first page that was redirected to an earlier one, repeats the page before a
    second time in a row, or shows no listing at all.
    """
    flagged = materialise(crawl.repeated_pages(extract.page_listing_ids(pages, portal)))
    empty = (F.col("page") > 1) & (F.size("ids") == 0)
    ends = crawl.past_the_end(F.col("page"), F.col("final_url")) | F.col("stops") | empty
    return crawl.keep_before_stop(flagged, ends).drop("repeated", "stops")


def pages_to_raw(pages: DataFrame, portal: str) -> DataFrame:
    """Crawled pages to RAW rows, one per listing code, first seen kept (by page, address, position)."""
    code = "zonaprop_code" if portal == "Z" else "argenprop_code"
    cards = crawl.first_per_code(extract.extract_cards(pages, portal), "code", ["page", "page_url", "page_pos"])
    raw = cards.withColumnRenamed("code", code).drop("page", "page_url", "page_pos")
    if portal == "Z":
        raw = raw.withColumn("features", F.try_element_at("features", F.lit(1)))
    return raw


def clean_stg(stg: DataFrame, literal_prices: bool = False) -> DataFrame:
    """STG rows to listings that lack nothing but antiquity, names still as written. ``literal_prices`` reads price texts
    the older way, dollar prices included (they come out as missing).

    The narrow rows are written before those with gaps are dropped: a filter above the texts' expressions would be moved below
    them and spell each out once more for every use. The result is a filter on the written table.
    """
    df = cleaning.parse_price_text(stg, literal_prices)
    df = cleaning.coerce_numeric(df)
    df = cleaning.fill_garages_zero(df)
    df = cleaning.lowercase_description(df)
    df = cleaning.fill_studio(df)
    df = cleaning.fill_rooms_from_text(df)
    df = cleaning.derive_bedrooms(df)
    df = cleaning.derive_bathrooms(df)
    keep = [c for c in ("zonaprop_code", "argenprop_code", "snapshot_date") if c in df.columns]
    rows = materialise(df.select(*keep, *LISTING_COLUMNS), "cleaned")
    return cleaning.drop_missing(rows, "price", "total_area", "rooms")


def fill_and_map(cleaned: DataFrame, long_aliases: bool = True) -> DataFrame:
    """Antiquity filled and names mapped by one lookup with a row per name as written.

    ``cleaned`` is read twice, as a filter on a written table: the lookup is folded from it and then joined to it.
    """
    names = materialise(cleaning.group_means(cleaned, "antiquity", "neighborhood"), "names")
    mapping = neighborhoods.name_mapping(names, "neighborhood", long_aliases)
    df = attach(cleaned, names.join(mapping, "neighborhood", "left"), ["neighborhood"])
    df = cleaning.impute_lookup(cleaning.fill_from_mean(df, "antiquity"), "antiquity", "neighborhood")
    return df.withColumn("neighborhood", F.col("_mapped")).drop("_mapped")


def without_outliers(df: DataFrame) -> DataFrame:
    """Minimum values, then price fences, then area fences over what is left.

    The rows are written once; each fence is worked out once from them, and both are plain numbers.
    """
    rows = materialise(cleaning.min_value_filter(df), "listings")
    priced = cleaning.within(rows, "price", cleaning.iqr_fence(rows, "price"))
    return cleaning.within(priced, "total_area", cleaning.iqr_fence(priced, "total_area"))


def training_table(stg_z: DataFrame, stg_a: DataFrame) -> DataFrame:
    """Both portals' newest STG to the model table (names mapped before the outlier rules)."""
    cleaned = clean_stg(cleaning.union_portals(stg_z, stg_a))
    return without_outliers(neighborhoods.drop_unmapped(fill_and_map(cleaned)))


def report_listings(
    raw: DataFrame, usd_rate: float, map_first: bool = False, literal_prices: bool = False
) -> DataFrame:
    """One portal Z RAW snapshot to report listings: outliers out, names mapped by the short table.

    ``map_first`` drops unmapped names before the outlier rules instead of after them.
    ``literal_prices`` loses dollar prices, as the older reports did. The result is a filter on a
    written table, so every report figure can read it again.
    """
    if literal_prices:
        raw = raw.filter(~F.startswith("price", F.lit("USD ")))
    cleaned = clean_stg(staging.stage_z(raw, usd_rate), literal_prices)
    mapped = fill_and_map(cleaned, long_aliases=False)
    if map_first:
        return without_outliers(neighborhoods.drop_unmapped(mapped))
    return neighborhoods.drop_unmapped(without_outliers(mapped))


def stock_listings(stock: DataFrame, usd_rate: float = 1225.0) -> DataFrame:
    """A portal's own stock table to scoring inputs with the asking price."""
    df = cleaning.stock_filters(stock)
    df = cleaning.impute_group_mean(df, "Antiguedad", "Barrio")
    df = cleaning.impute_lookup(df, "Antiguedad", "Barrio")
    df = neighborhoods.map_neighborhood(df, "Barrio", "neighborhood")
    df = cleaning.price_to_pesos(df, rate=usd_rate)
    df = cleaning.rooms_from_area(cleaning.coalesce_area(df))
    df = df.select(
        F.col("Codigo").alias("argenprop_code"),
        F.col("MontoOperacion").alias("original_price"),
        F.col("PropiedadSuperficieTotal").alias("total_area"),
        F.col("CantidadDormitorios").alias("rooms"),
        F.col("Antiguedad").alias("antiquity"),
        "neighborhood",
    )
    return cleaning.stock_defaults(df)


def scored_stock(
    listings: DataFrame, simple: BoostedTrees, ohe: BoostedTrees, by_neighborhood: Mapping[str, BoostedTrees],
    below: float = 5_000_000,
) -> DataFrame:
    """Stock listings with the three predictions, their deviations and deviation classes."""
    scored = models.predict_ohe(models.predict_simple(listings, simple), ohe)
    scored = models.predict_by_neighborhood(scored, by_neighborhood)
    return evaluation.with_categories(evaluation.with_deviations(evaluation.price_band(scored, below)))
