"""Declared schemas; nothing is inferred from files."""

from pyspark.sql import types as T


def _strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


RAW_Z = _strings(
    "property_url", "zonaprop_code", "price", "expenses", "address", "location", "features", "description"
)
RAW_A_TEXT = _strings(
    "property_url", "argenprop_code", "price", "expenses", "address", "location", "features", "description"
)
RAW_A = T.StructType(
    [f if f.name != "features" else T.StructField("features", T.ArrayType(T.StringType())) for f in RAW_A_TEXT]
)
CARD = T.StructType(
    [
        T.StructField("page", T.LongType()),
        T.StructField("page_url", T.StringType()),
        T.StructField("page_pos", T.IntegerType()),
        T.StructField("property_url", T.StringType()),
        T.StructField("code", T.StringType()),
        T.StructField("price", T.StringType()),
        T.StructField("expenses", T.StringType()),
        T.StructField("address", T.StringType()),
        T.StructField("location", T.StringType()),
        T.StructField("features", T.ArrayType(T.StringType())),
        T.StructField("description", T.StringType()),
    ]
)
HISTORIC = T.StructType(
    [
        T.StructField("Mes", T.StringType()),
        T.StructField("Barrio", T.StringType()),
        T.StructField("Inmueble", T.StringType()),
        T.StructField("mediana_por_m2", T.DoubleType()),
        T.StructField("mediana_precio", T.DoubleType()),
    ]
)
KV_ITEM = T.MapType(T.StringType(), T.MapType(T.StringType(), T.StringType()))

NUMERIC_LISTING_COLUMNS = (
    "total_area", "rooms", "bedrooms", "bathrooms", "garages", "price", "antiquity",
)
STG_COLUMNS = (
    "property_url", "price", "expenses", "address", "location", "neighborhood", "description",
    "total_area", "rooms", "bedrooms", "bathrooms", "garages", "antiquity",
)
