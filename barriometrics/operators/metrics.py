"""Listing counts, prices and distributions for the city and its neighbourhoods."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from barriometrics import dims
from barriometrics.functions import text
from barriometrics.operators.lookups import attach
from barriometrics.operators.order_stats import quantiles
from barriometrics.operators.snapshots import change_counts, citywide, code_presence

def price_m2() -> Column:
    return F.try_divide(F.col("price"), F.col("total_area"))


def _price_summary(suffix: str, whole: bool) -> list[Column]:
    """Count and mean, minimum and maximum price; ``whole`` truncates the prices."""
    shown = lambda c: c.cast("bigint") if whole else c
    return [
        F.count("*").alias(f"total_properties{suffix}"),
        shown(F.avg("price")).alias(f"average_price{suffix}"),
        shown(F.min("price")).alias(f"min_price{suffix}"),
        shown(F.max("price")).alias(f"max_price{suffix}"),
    ]


def kpi_city(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("total_properties"))


def kpi_neighborhood(df: DataFrame) -> DataFrame:
    """Count and truncated mean, minimum and maximum price; all 19 names, zeros where empty."""
    stats = df.groupBy("neighborhood").agg(*_price_summary("_neighborhood", whole=True))
    return dims.valid_neighborhoods(df.sparkSession).join(stats, "neighborhood", "left").na.fill(0)


def price_summary(df: DataFrame) -> DataFrame:
    """Untruncated neighbourhood figures, as the single-request report prints them."""
    return df.groupBy("neighborhood").agg(*_price_summary("_neighborhood", whole=False))


def kpi_neighborhood_rooms(df: DataFrame) -> DataFrame:
    return df.groupBy("neighborhood", "rooms").agg(*_price_summary("_amb_neighborhood", whole=False))


def kpi_report(old: DataFrame, new: DataFrame) -> DataFrame:
    """The ten report fields per neighbourhood: city totals, neighbourhood totals, changes."""
    presence = code_presence(old, new, by=["neighborhood"])
    city = change_counts(citywide(presence)).select(F.struct("new_rows", "removed_rows").alias("c")).scalar()
    total = kpi_city(new).scalar()
    local = change_counts(presence, ["neighborhood"]).select(
        "neighborhood",
        F.col("new_rows").alias("new_properties_since_last_report_neighborhood"),
        F.col("removed_rows").alias("removed_properties_since_last_report_neighborhood"),
    )
    report = kpi_neighborhood(new).join(local, "neighborhood", "left").na.fill(0)
    empty = F.col("total_properties_neighborhood") == 0
    return report.select(
        "neighborhood",
        total.alias("total_properties"),
        city["new_rows"].alias("new_properties_since_last_report"),
        city["removed_rows"].alias("removed_properties_since_last_report"),
        "total_properties_neighborhood",
        "average_price_neighborhood",
        "min_price_neighborhood",
        "max_price_neighborhood",
        *[
            F.when(empty, F.lit(0)).otherwise(F.col(c)).cast("bigint").alias(c)
            for c in (
                "new_properties_since_last_report_neighborhood",
                "removed_properties_since_last_report_neighborhood",
            )
        ],
    )


def with_room_category(df: DataFrame) -> DataFrame:
    return df.withColumn("room_category", text.room_category(F.col("rooms")))


def averages_by_rooms(df: DataFrame) -> DataFrame:
    """Mean price and mean price per m² per room class, for each neighbourhood and the city.

    Listings are folded once to (neighbourhood, class) sums; the city rows (NULL neighbourhood)
    are grouping sets over those sums.
    """
    folded = (
        with_room_category(df)
        .groupBy("neighborhood", "room_category")
        .agg(
            F.sum("price").alias("p"), F.count("price").alias("pn"),
            F.sum(price_m2()).alias("m"), F.count(price_m2()).alias("mn"),
        )
    )
    sets = [[F.col("neighborhood"), F.col("room_category")], [F.col("room_category")]]
    return folded.groupingSets(sets, F.col("neighborhood"), F.col("room_category")).agg(
        F.try_divide(F.sum("p"), F.sum("pn")).alias("avg_price"),
        F.try_divide(F.sum("m"), F.sum("mn")).alias("avg_price_m2"),
    )


def room_distribution(df: DataFrame) -> DataFrame:
    """Listings and share per room class, for each neighbourhood and the city (NULL neighbourhood)."""
    folded = with_room_category(df).groupBy("neighborhood", "room_category").agg(F.count("*").alias("n"))
    sets = [[F.col("neighborhood"), F.col("room_category")], [F.col("room_category")]]
    counts = folded.groupingSets(sets, F.col("neighborhood"), F.col("room_category")).agg(
        F.sum("n").alias("n"), F.grouping("neighborhood").alias("city")
    )
    totals = counts.groupBy("city", "neighborhood").agg(F.sum("n").alias("total")).withColumnsRenamed(
        {"city": "_city", "neighborhood": "_name"}
    )
    same = (F.col("city") == F.col("_city")) & F.col("neighborhood").eqNullSafe(F.col("_name"))
    return counts.join(totals, same).select(
        "neighborhood", "room_category", "n", (F.col("n") * 100.0 / F.col("total")).alias("pct")
    )


def area_distribution(df: DataFrame) -> DataFrame:
    """Listings and share per size class; every class of a neighbourhood appears, in fixed order."""
    label = text.area_category(F.col("total_area"))
    counts = df.groupBy("neighborhood").agg(
        F.count("*").alias("total"), *[F.count_if(label == name).alias(f"c{i}") for i, name in enumerate(dims.AREA_CATEGORIES)]
    )
    entries = F.array(
        *[
            F.struct(F.lit(i).alias("position"), F.lit(name).alias("area_category"), F.col(f"c{i}").alias("n"))
            for i, name in enumerate(dims.AREA_CATEGORIES)
        ]
    )
    return counts.select("neighborhood", "total", F.inline(entries)).select(
        "neighborhood", "position", "area_category", "n", (F.col("n") * 100.0 / F.col("total")).alias("pct")
    )


def room_mix(df: DataFrame) -> DataFrame:
    """Share of each room class per neighbourhood, one column per class."""
    counts = with_room_category(df).groupBy("neighborhood").pivot("room_category", list(dims.ROOM_CATEGORIES)).count().na.fill(0)
    total = sum((F.col(f"`{c}`") for c in dims.ROOM_CATEGORIES), F.lit(0))
    names = ("pct_1", "pct_2", "pct_3", "pct_4_plus")
    return counts.select(
        "neighborhood", *[(F.col(f"`{c}`") * 100.0 / total).alias(n) for c, n in zip(dims.ROOM_CATEGORIES, names)]
    )


def listings_per_neighborhood(df: DataFrame) -> DataFrame:
    counts = df.groupBy("neighborhood").agg(F.count("*").alias("listings"))
    return counts.orderBy(F.desc("listings"), "neighborhood")


def price_box_stats(df: DataFrame, value: str = "price", by: Sequence[str] = ("neighborhood",)) -> DataFrame:
    """Quartiles and whiskers: the extreme values within 1.5 interquartile ranges of the box."""
    keys = list(by)
    boxes = quantiles(df, F.col(value), {"q1": 0.25, "median": 0.5, "q3": 0.75}, keys)
    reach = (F.col("q3") - F.col("q1")) * 1.5
    x = F.col(value)
    inside = F.when((x >= F.col("q1") - reach) & (x <= F.col("q3") + reach), x)
    return (
        attach(df.select(*keys, value), boxes, keys, "inner")
        .groupBy(*keys)
        .agg(
            *[F.max(c).alias(c) for c in ("n", "q1", "median", "q3")],
            F.min(inside).alias("whisker_low"),
            F.max(inside).alias("whisker_high"),
        )
    )


def density_histogram(df: DataFrame, value: str, bins: int = 50) -> DataFrame:
    """Equal-width bins between the extremes: bin, lower edge, count and density (area one)."""
    span = df.agg(F.struct(F.min(value).alias("lo"), F.max(value).alias("hi"), F.count(value).alias("n")).alias("s"))
    s = span.scalar()
    x = df.filter(F.col(value).isNotNull()).select(F.col(value).alias("x"), s.alias("s"))
    width = (F.col("s.hi") - F.col("s.lo")) / bins
    position = F.coalesce(F.floor(F.try_divide(F.col("x") - F.col("s.lo"), width)), F.lit(0))
    counts = x.groupBy(F.least(position, F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    return counts.select("*", s.alias("s")).select(
        "bin",
        (F.col("s.lo") + F.col("bin") * width).alias("lower_edge"),
        "n",
        F.try_divide(F.col("n").cast("double"), F.col("s.n") * width).alias("density"),
    )


def area_price_points(df: DataFrame) -> DataFrame:
    return df.select("total_area", "price", "neighborhood")
