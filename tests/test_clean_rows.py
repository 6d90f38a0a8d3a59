"""Cleaning of STG rows to listings."""

from barriometrics.plans import flows


def test_cleaned_rows_are_a_filter_on_a_written_table(spark):
    schema = "zonaprop_code string, price string, neighborhood string, description string, total_area double, rooms double, bedrooms double, bathrooms double, garages double, antiquity double"
    data = [
        ("whole", "1.500.000", "Palermo", "", 40.0, 2.0, None, None, None, 3.0),
        ("studio", "900", "Palermo", "MONOAMBIENTE", 30.0, None, None, None, 1.0, None),
        ("from text", "1200.5", "Palermo", "Depto 3 Amb", 30.0, None, None, None, None, None),
        ("no price", "Consultar", "Palermo", "2 amb", 30.0, 2.0, 1.0, 1.0, 0.0, 1.0),
        ("null price", None, "Palermo", "2 amb", 30.0, 2.0, 1.0, 1.0, 0.0, 1.0),
        ("no area", "1000", "Palermo", "2 amb", None, 2.0, 1.0, 1.0, 0.0, 1.0),
        ("nan area", "1000", "Palermo", "2 amb", float("nan"), 2.0, 1.0, 1.0, 0.0, 1.0),
        ("no rooms", "1000", None, None, 30.0, None, 1.0, 1.0, 0.0, 1.0),
    ]
    cleaned = flows.clean_stg(spark.createDataFrame(data, schema))
    found = {r["zonaprop_code"]: tuple(r[c] for c in ("price", "rooms", "bedrooms", "bathrooms", "garages", "antiquity")) for r in cleaned.collect()}
    assert found == {
        "whole": (1500000.0, 2.0, 1.0, 1.0, 0.0, 3.0), "studio": (900.0, 1.0, 1.0, 1.0, 1.0, None), "from text": (1200.5, 3.0, 2.0, 1.0, 0.0, None),
    }
    # Above the texts' expressions the filter would spell each of them out again.
    assert "regexp" not in cleaned._jdf.queryExecution().optimizedPlan().toString()
