"""Answering report requests from the listing tables, the nearby places and a price model."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from barriometrics import dims
from barriometrics.operators.boosting import BoostedTrees
from barriometrics.operators.lookups import attach
from barriometrics.operators.metrics import kpi_city, kpi_neighborhood_rooms, price_summary
from barriometrics.operators.models import predict_ohe
from barriometrics.operators.places import grouped_places, near_counts
from barriometrics.operators.snapshots import change_counts, citywide, code_presence


def area_bounds(requests: DataFrame) -> DataFrame:
    """``total_area`` 'min-max' to two whole numbers."""
    side = lambda i: F.try_element_at(F.split("total_area", "-"), F.lit(i)).try_cast("int")
    return requests.withColumns({"area_min": side(1), "area_max": side(2)})


def rent_range(requests: DataFrame, model: BoostedTrees) -> DataFrame:
    """Predicted rent at both ends of the requested area, one row per request."""
    ends = area_bounds(requests).select(
        "request_id", "neighborhood",
        *[F.col(c).cast("double").alias(c) for c in ("rooms", "bedrooms", "antiquity")],
        F.inline(
            F.array(
                F.struct(F.lit("min").alias("end"), F.col("area_min").cast("double").alias("total_area")),
                F.struct(F.lit("max").alias("end"), F.col("area_max").cast("double").alias("total_area")),
            )
        ),
    )
    scored = predict_ohe(ends, model, "rent")
    at = lambda end: F.max(F.when(F.col("end") == end, F.col("rent")))
    return scored.groupBy("request_id").agg(at("min").alias("rent_result_min"), at("max").alias("rent_result_max"))


def answer_requests(
    requests: DataFrame, old: DataFrame, new: DataFrame, places: DataFrame | None = None, model: BoostedTrees | None = None
) -> DataFrame:
    """One row per request: city, neighbourhood and room-class figures, changes, places, rent range.

    Requests carry request_id, neighborhood, rooms, bedrooms, antiquity, total_area and lat/lon.
    """
    presence = code_presence(old, new, by=["neighborhood"])
    city = change_counts(citywide(presence)).select(F.struct("new_rows", "removed_rows").alias("c")).scalar()
    local = change_counts(presence, ["neighborhood"]).select(
        "neighborhood",
        F.col("new_rows").alias("new_properties_since_last_report_neighborhood"),
        F.col("removed_rows").alias("removed_properties_since_last_report_neighborhood"),
    )
    # One row per neighbourhood, and per neighbourhood and room number: checked, then broadcast, so
    # requests are not shuffled on their few neighbourhoods.
    figures = price_summary(new).join(local, "neighborhood", "left")
    answer = attach(requests.withColumn("rooms", F.col("rooms").cast("double")), figures, ["neighborhood"])
    answer = attach(answer, kpi_neighborhood_rooms(new), ["neighborhood", "rooms"])
    answer = answer.select(
        "*",
        kpi_city(new).scalar().alias("total_properties"),
        city["new_rows"].alias("new_properties_since_last_report"),
        city["removed_rows"].alias("removed_properties_since_last_report"),
    ).na.fill(0, ["total_properties_neighborhood", "total_properties_amb_neighborhood"])
    if places is not None:
        counts = near_counts(requests.select("request_id", "lat", "lon"), grouped_places(places), "place_group")
        nearby = counts.groupBy("request_id").agg(
            *[
                F.coalesce(F.sum(F.when(F.col("place_group") == g, F.col("places"))), F.lit(0)).alias(f"nearby_{g}")
                for g in dims.PLACE_GROUPS
            ]
        )
        answer = answer.join(nearby, "request_id", "left").na.fill(0, [f"nearby_{g}" for g in dims.PLACE_GROUPS])
    if model is not None:
        answer = answer.join(rent_range(requests, model), "request_id", "left")
    return answer
