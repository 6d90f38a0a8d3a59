"""Fifteen market-trend metrics per neighbourhood from an old and a new snapshot.

The listings are folded by a handful of aggregates whose results have one row per neighbourhood
(or per neighbourhood and room number); everything after that works on those small tables.
Neighbourhoods without new listings have no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from barriometrics.operators.lookups import attach
from barriometrics.operators.metrics import price_m2
from barriometrics.operators.order_stats import order_statistics, quantiles
from barriometrics.operators.snapshots import change_counts, code_presence
from barriometrics.session import materialise

KEY = "neighborhood"


def change_pct(new: Column, old: Column) -> Column:
    """Relative change in percent; 0 where there is nothing to compare with."""
    return F.when(old > 0, (new - old) / old * 100).otherwise(F.lit(0.0))


def share_pct(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part * 100.0 / whole).otherwise(F.lit(0.0))


def price_part(old: DataFrame, new: DataFrame) -> DataFrame:
    """Counts and mean prices of both snapshots in one aggregate."""
    cols = [KEY, "price", price_m2().alias("m2")]
    both = old.select(*cols, F.lit(False).alias("is_new")).unionByName(new.select(*cols, F.lit(True).alias("is_new")))
    is_new = F.col("is_new")
    folded = both.groupBy(KEY).agg(
        F.count_if(is_new).alias("n_new"),
        F.count_if(~is_new).alias("n_old"),
        F.avg(F.when(is_new, F.col("price"))).alias("avg_price_new"),
        F.coalesce(F.avg(F.when(~is_new, F.col("price"))), F.lit(0.0)).alias("avg_price_old"),
        F.sum(F.when(is_new, F.col("m2"))).alias("m2_sum"),
        F.count(F.when(is_new, F.col("m2"))).alias("m2_rows"),
        F.avg(F.when(is_new, F.col("m2"))).alias("price_m2_new"),
        F.coalesce(F.avg(F.when(~is_new, F.col("m2"))), F.lit(0.0)).alias("price_m2_old"),
    )
    return folded.filter(F.col("n_new") > 0)


def price_trend(old: DataFrame, new: DataFrame) -> DataFrame:
    """Change of the mean price; also the tenants' timing metric."""
    return price_part(old, new).select(
        KEY, "avg_price_new", "avg_price_old",
        change_pct(F.col("avg_price_new"), F.col("avg_price_old")).alias("price_change"),
    )


def segments(new: DataFrame) -> DataFrame:
    """Listings and mean price per room number, ranked by size (fewer rooms first on ties)."""
    folded = new.groupBy(KEY, "rooms").agg(F.count("*").alias("n"), F.avg("price").alias("avg_price"))
    w = Window.partitionBy(KEY)
    return folded.filter(F.col("rooms").isNotNull()).select(
        "*",
        F.row_number().over(w.orderBy(F.desc("n"), "rooms")).alias("by_size"),
        F.row_number().over(w.orderBy("rooms")).alias("by_rooms"),
        F.row_number().over(w.orderBy("n", "rooms")).alias("by_rarity"),
        F.sum("n").over(w).alias("total"),
    )


def segment_part(new: DataFrame) -> DataFrame:
    """Largest, second and rarest segment and the first three, one row per neighbourhood."""
    at = lambda rank, k, c: F.max(F.when(F.col(rank) == k, F.col(c)))
    first_three = F.collect_list(F.when(F.col("by_rooms") <= 3, F.struct("rooms", "n")))
    return (
        segments(new)
        .groupBy(KEY)
        .agg(
            F.max("total").alias("total"),
            at("by_size", 1, "rooms").alias("top_rooms"),
            at("by_size", 1, "n").alias("top_n"),
            at("by_size", 1, "avg_price").alias("top_price"),
            at("by_size", 2, "avg_price").alias("second_price"),
            at("by_rarity", 1, "rooms").alias("rare_rooms"),
            at("by_rarity", 1, "n").alias("rare_n"),
            F.array_sort(first_three).alias("first_three"),
        )
        .select(
            "*",
            share_pct(F.col("top_n"), F.col("total")).alias("top_pct"),
            share_pct(F.col("rare_n"), F.col("total")).alias("rare_pct"),
            F.coalesce((F.col("top_price") - F.col("second_price")) / F.col("second_price") * 100, F.lit(0.0)).alias("price_gap"),
            F.array_join(
                F.transform(
                    "first_three",
                    lambda s: F.concat(s.rooms.cast("int").cast("string"), F.lit(" amb: "), s.n.cast("string")),
                ),
                ", ",
            ).alias("inventory_summary"),
        )
        .drop("first_three")
    )


def competition(new: DataFrame) -> DataFrame:
    return segment_part(new).select(
        KEY, F.col("total").alias("total_properties"), F.col("top_rooms").alias("modal_rooms"),
        F.col("top_n").alias("similar_properties"), F.col("top_pct").alias("competition_rate"),
        level(F.col("top_pct"), 40, 25, "alta", "moderada", "baja").alias("competition_level"),
    )


def level(value: Column, high: float, middle: float, *names: str) -> Column:
    return F.when(value > high, names[0]).when(value > middle, names[1]).otherwise(names[2])


def price_per_m2(old: DataFrame, new: DataFrame) -> DataFrame:
    """Mean price per m² against the city's."""
    return _against_city(price_part(old, new))


def _against_city(parts: DataFrame) -> DataFrame:
    city = parts.agg(F.sum("m2_sum") / F.sum("m2_rows")).scalar()
    return parts.select(KEY, F.col("price_m2_new").alias("price_m2"), city.alias("price_m2_city")).withColumn(
        "m2_diff", (F.col("price_m2") - F.col("price_m2_city")) / F.col("price_m2_city") * 100
    )


def change_part(old: DataFrame, new: DataFrame, code: str = "code") -> DataFrame:
    """Distinct codes that came and went, with rates over the old distinct codes."""
    counts = change_counts(code_presence(old, new, code, [KEY]), [KEY]).filter(F.col("all_new_codes") > 0)
    return counts.select(
        KEY, "new_codes", "removed_codes", "old_codes",
        share_pct(F.col("new_codes") + F.col("removed_codes"), F.col("old_codes")).alias("rotation_rate"),
        share_pct(F.col("removed_codes"), F.col("old_codes")).alias("removal_rate"),
    )


def market_rotation(old: DataFrame, new: DataFrame, code: str = "code") -> DataFrame:
    return change_part(old, new, code).select(
        KEY, "new_codes", "removed_codes", "rotation_rate",
        level(F.col("rotation_rate"), 30, 15, "rápida", "moderada", "lenta").alias("market_speed"),
    )


def top_segment(new: DataFrame) -> DataFrame:
    return segment_part(new).select(KEY, "top_rooms", "top_n", "top_pct", "top_price")


def market_growth(old: DataFrame, new: DataFrame) -> DataFrame:
    growth = change_pct(F.col("n_new").cast("double"), F.col("n_old"))
    return price_part(old, new).select(KEY, "n_new", "n_old", growth.alias("growth_rate")).select(
        "*",
        level(F.col("growth_rate"), 5, -5, "creciendo", "estable", "contrayéndose").alias("growth_status"),
        level(F.abs("growth_rate"), 10, 5, "Alta", "Moderada", "Estable").alias("opportunity_level"),
    )


def price_segmentation(new: DataFrame) -> DataFrame:
    return segment_part(new).select(KEY, "top_rooms", "top_n", "top_price", "price_gap")


def competitive_position(old: DataFrame, new: DataFrame) -> DataFrame:
    """Mean price against the plain mean over the three largest other neighbourhoods."""
    return _against_largest(price_part(old, new))


def _against_largest(parts: DataFrame) -> DataFrame:
    """The three are among the four largest overall, a four-row scalar that every row filters for itself."""
    largest = parts.orderBy(F.desc("n_new"), KEY).limit(4)
    entry = F.struct((-F.col("n_new")).alias("order"), F.col(KEY).alias("name"), F.col("avg_price_new").alias("price"))
    ranked = largest.agg(F.array_sort(F.collect_list(entry)))
    own = F.col("avg_price_new")
    others = F.slice(F.filter("ranked", lambda s: s["name"] != F.col(KEY)), 1, 3)
    mean = F.aggregate(others, F.lit(0.0), lambda acc, s: acc + s["price"]) / F.size(others)
    compared = parts.select(KEY, own, ranked.scalar().alias("ranked")).select(
        KEY, own, F.when(F.size(others) > 0, mean).otherwise(own).alias("avg_price_competitors")
    )
    position = (own - F.col("avg_price_competitors")) / F.col("avg_price_competitors") * 100
    return compared.withColumn("competitive_position", position).withColumn(
        "position_level",
        F.when(F.col("competitive_position") < -5, "más económico")
        .when(F.abs("competitive_position") <= 5, "similar")
        .otherwise("más premium"),
    )


def inventory(new: DataFrame) -> DataFrame:
    return segment_part(new).select(
        KEY, F.col("total").alias("total_properties"), "inventory_summary", "rare_rooms", "rare_n", "rare_pct"
    )


def _quarter_edge(rows: DataFrame) -> DataFrame:
    """Size of the cheapest quarter by price per m², rounded down, and its last value."""
    edge = order_statistics(rows, F.col("m2"), {"edge": lambda n: F.floor(n * 0.25)}, [KEY])
    return edge.withColumn("k", F.floor(F.col("n") * 0.25)).drop("n")


def _quarter_sums() -> list[Column]:
    below = F.col("m2") < F.col("edge")
    return [
        F.coalesce(F.sum(F.when(below, F.col("m2"))), F.lit(0.0)).alias("s"),
        F.count_if(below).alias("c"), F.max("edge").alias("edge"), F.max("k").alias("k"),
    ]


def _quarter_mean() -> Column:
    total = F.col("s") + (F.col("k") - F.col("c")) * F.col("edge")
    return F.when(F.col("k") > 0, total / F.col("k")).alias("best_value_avg")


def _deal_edge(rows: DataFrame) -> DataFrame:
    return quantiles(rows, F.col("price"), {"price_threshold": 0.25}, [KEY]).drop("n")


def _deal_sums() -> list[Column]:
    deal = F.col("price") <= F.col("price_threshold")
    return [
        F.max("price_threshold").alias("price_threshold"),
        F.count_if(deal).alias("deals"),
        F.coalesce(F.avg(F.when(deal, F.col("price"))), F.lit(0.0)).alias("deals_avg_price"),
        F.coalesce(F.avg(F.when(deal, F.col("m2"))), F.lit(0.0)).alias("deals_avg_m2"),
        F.avg("price").alias("avg_price"),
    ]


def _deal_columns() -> list[str | Column]:
    saving = F.when(
        F.col("deals_avg_price") > 0, (F.col("avg_price") - F.col("deals_avg_price")) / F.col("avg_price") * 100
    ).otherwise(F.lit(0.0))
    return ["price_threshold", "deals", "deals_avg_price", "deals_avg_m2", "avg_price", saving.alias("savings_pct")]


def _prices(new: DataFrame) -> DataFrame:
    return new.select(KEY, "price", price_m2().alias("m2"))


def cheapest_quarter(new: DataFrame) -> DataFrame:
    """Mean price per m² over the cheapest quarter (rounded down) of each neighbourhood.

    The quarter's last value is an exact order statistic; the mean then is a plain aggregate.
    """
    rows = _prices(new)
    return attach(rows, _quarter_edge(rows), [KEY], "inner").groupBy(KEY).agg(*_quarter_sums()).select(KEY, _quarter_mean())


def best_deals(new: DataFrame) -> DataFrame:
    """Listings up to the neighbourhood's first price quartile against its mean."""
    rows = _prices(new)
    return attach(rows, _deal_edge(rows), [KEY], "inner").groupBy(KEY).agg(*_deal_sums()).select(KEY, *_deal_columns())


def bargain_part(new: DataFrame) -> DataFrame:
    """``cheapest_quarter`` and ``best_deals`` in one pass over the listings."""
    rows = _prices(new)
    edges = _deal_edge(rows).join(_quarter_edge(rows), KEY, "left")
    folded = attach(rows, edges, [KEY], "inner").groupBy(KEY).agg(*_deal_sums(), *_quarter_sums())
    return folded.select(KEY, *_deal_columns(), _quarter_mean())


def price_per_m2_trend(old: DataFrame, new: DataFrame) -> DataFrame:
    change = change_pct(F.col("price_m2_new"), F.col("price_m2_old"))
    parts = price_part(old, new).select(KEY, "price_m2_new", "price_m2_old", change.alias("m2_trend"))
    return parts.join(cheapest_quarter(new), KEY, "left")


def timing(old: DataFrame, new: DataFrame) -> DataFrame:
    status = (
        F.when(F.col("price_change") < 0, "favorable").when(F.col("price_change") > 5, "menos favorable").otherwise("neutral")
    )
    return price_trend(old, new).withColumn("timing_status", status)


def availability(old: DataFrame, new: DataFrame, code: str = "code") -> DataFrame:
    counts = price_part(old, new).select(KEY, F.col("n_new").alias("total_available"))
    return counts.join(change_part(old, new, code).select(KEY, "new_codes"), KEY).withColumn(
        "availability_level", level(F.col("total_available"), 50, 20, "alta", "moderada", "limitada")
    )


def property_profile(new: DataFrame) -> DataFrame:
    """Size bands: the largest with its means, the number of bands in use, share of premium flats."""
    area = F.col("total_area")
    bands = [area < 30, (area >= 30) & (area < 50), (area >= 50) & (area < 80), area >= 80]
    folded = new.groupBy(KEY).agg(
        F.count("*").alias("total"),
        F.count_if((F.col("bathrooms") > 1) | (F.col("garages") > 0)).alias("premium"),
        *[F.count_if((area >= 0) & b).alias(f"n{i}") for i, b in enumerate(bands)],
        *[F.avg(F.when((area >= 0) & b, F.col("rooms"))).alias(f"r{i}") for i, b in enumerate(bands)],
        *[F.avg(F.when((area >= 0) & b, F.col("bathrooms"))).alias(f"b{i}") for i, b in enumerate(bands)],
    )
    largest = F.array_max(
        F.array(
            *[
                F.struct(
                    F.col(f"n{i}").alias("n"), F.lit(-i).alias("order"),
                    F.col(f"r{i}").alias("rooms"), F.col(f"b{i}").alias("baths"),
                )
                for i in range(len(bands))
            ]
        )
    )
    used = sum((F.when(F.col(f"n{i}") > 0, 1).otherwise(0) for i in range(len(bands))), F.lit(0))
    return folded.withColumn("_top", largest).select(
        KEY, "total", *[f"n{i}" for i in range(len(bands))],
        (-F.col("_top.order")).alias("top_band"),
        F.col("_top.n").alias("top_band_n"),
        share_pct(F.col("_top.n"), F.col("total")).alias("top_band_pct"),
        F.col("_top.rooms").alias("top_band_rooms"),
        F.col("_top.baths").alias("top_band_bathrooms"),
        used.alias("bands_in_use"),
        share_pct(F.col("premium"), F.col("total")).alias("premium_pct"),
    )


def market_speed(old: DataFrame, new: DataFrame, code: str = "code") -> DataFrame:
    return change_part(old, new, code).select(
        KEY, "removed_codes", "old_codes", "removal_rate",
        level(F.col("removal_rate"), 40, 25, "muy dinámico", "dinámico", "pausado").alias("speed_level"),
        level(F.col("removal_rate"), 40, 25, "alta", "moderada", "baja").alias("urgency"),
    )


def trend_facts(old: DataFrame, new: DataFrame, code: str = "code") -> DataFrame:
    """All numbers behind the fifteen metrics, one row per neighbourhood."""
    parts = materialise(price_part(old, new), "price-part")
    facts = parts.select(
        "*",
        change_pct(F.col("avg_price_new"), F.col("avg_price_old")).alias("price_change"),
        change_pct(F.col("n_new").cast("double"), F.col("n_old")).alias("growth_rate"),
        change_pct(F.col("price_m2_new"), F.col("price_m2_old")).alias("m2_trend"),
    )
    return (
        facts.join(_against_city(parts).select(KEY, "price_m2_city", "m2_diff"), KEY)
        .join(_against_largest(parts).select(KEY, "avg_price_competitors", "competitive_position"), KEY)
        .join(segment_part(new).drop("total"), KEY, "left")
        .join(change_part(old, new, code), KEY, "left")
        .join(bargain_part(new).drop("avg_price"), KEY, "left")
        .join(property_profile(new).drop("total", "n0", "n1", "n2", "n3"), KEY, "left")
    )
