import random

from pyspark.sql import functions as F

from barriometrics.functions import text
from barriometrics.operators import cleaning, staging


def values(df, column):
    return [row[column] for row in df.collect()]


def column_of(spark, items, kind="string"):
    return spark.createDataFrame([(i, x) for i, x in enumerate(items)], f"i int, x {kind}").orderBy("i")


def test_codes_and_pages(spark):
    df = column_of(spark, ["https://host/x-54947860.html", "https://host/y--16181043", None])
    assert values(df.select(text.listing_code(F.col("x")).alias("c")), "c") == ["54947860", "16181043", None]
    df = column_of(spark, ["https://host/a?pagina-12", "https://host/a", None])
    assert values(df.select(text.page_number(F.col("x")).alias("c")), "c") == [12, None, None]


def test_price_texts(spark):
    amounts = ["850.000", "1.050.000", "1.200.000", "950.500", "667875.0", "667875.5", "precio", None, "900"]
    df = column_of(spark, amounts)
    assert values(df.select(text.price_number(F.col("x")).alias("c")), "c") == [
        850000.0, 1050000.0, 1200000.0, 950500.0, 667875.0, 667875.5, None, None, 900.0,
    ]
    literal = values(df.select(text.price_number_literal(F.col("x")).alias("c")), "c")

    def as_before(amount):
        if amount is None:
            return None
        try:
            return float(amount.replace(".000", "000").replace(".0", ""))
        except ValueError:
            return None

    assert literal == [as_before(a) for a in amounts]
    assert literal[1] == 150000.0  # the known loss of the literal reading


def test_dollars_become_pesos(spark):
    rows = [("USD", "650"), ("USD", "1.200"), ("$", "850.000"), ("USD", None), ("USD", "consultar")]
    df = spark.createDataFrame(rows, "cur string, amount string")
    out = values(df.select(text.to_pesos(F.col("cur"), F.col("amount"), F.lit(1027.5)).alias("p")), "p")
    assert out == ["667875.0", "1233000.0", "850.000", None, None]
    odd = df.select(text.to_pesos(F.col("cur"), F.col("amount"), F.lit(1000.25)).alias("p"))
    assert values(odd, "p")[0] == "650162.5"


def test_stage_z(spark):
    rows = [
        ("u", "1", "USD 650", "$ 85.000 Expensas", None, "Palermo Hollywood, Palermo", "45 m² tot. 2 amb. 1 dorm. 1 baño 1 coch.", "d"),
        ("u", "2", "Consultar precio", None, None, "Retiro, Capital Federal", "30m² tot.", "d"),
        ("u", "3", "$ 1.050.000", "120000", None, "Boedo", "2 baños", "d"),
        ("u", "4", None, None, None, "a, b, c", None, "d"),
    ]
    from barriometrics import schemas

    out = {r["zonaprop_code"]: r for r in staging.stage_z(spark.createDataFrame(rows, schemas.RAW_Z), 1000.0).collect()}
    assert sorted(out) == ["1", "3", "4"]
    first = out["1"]
    assert (first["price"], first["expenses"], first["neighborhood"], first["location"]) == ("650000.0", "85.000", "Palermo Hollywood", " Palermo")
    assert [first[c] for c in ("total_area", "rooms", "bedrooms", "bathrooms", "garages", "antiquity")] == [45, 2, 1, 1, 1, None]
    assert (out["3"]["expenses"], out["3"]["bathrooms"], out["3"]["location"]) == ("120", 2, None)
    assert (out["4"]["price"], out["4"]["total_area"]) == (None, None)


def test_stage_a(spark):
    from barriometrics import schemas

    rows = [
        ("u", "1", "$ 850.000", "$85.000 expensas", "x", "Departamento en Alquiler en Palermo, Capital Federal", ["45 m² cubie.", "2 ambientes", "1 dorm.", "1 baño", "20 años"], "d"),
        ("u", "2", "None None", None, "x", "Zona, Recoleta", ["Monoam."], "d"),
        ("u", "3", "USD 500", None, "x", "Departamento en Alquiler en Zona, Recoleta", ["45 m²", "Monoam.", "2 baños", "A Estrenar"], "d"),
        ("u", "4", "$ 1", None, "x", "Departamento en Alquiler en Boedo", None, "d"),
    ]
    out = {r["argenprop_code"]: r for r in staging.stage_a(spark.createDataFrame(rows, schemas.RAW_A), 1000.0).collect()}
    assert sorted(out) == ["1", "3", "4"]
    one, three, four = out["1"], out["3"], out["4"]
    assert (one["neighborhood"], one["location"], one["expenses"]) == ("Palermo", "Capital Federal", "85000")
    assert [one[c] for c in ("total_area", "rooms", "bedrooms", "bathrooms", "garages", "antiquity")] == [45, 2, 1, 1, None, 20]
    assert (three["neighborhood"], three["price"], three["rooms"], three["total_area"], three["antiquity"]) == ("Recoleta", "500000.0", 1, None, 0)
    assert (four["neighborhood"], four["rooms"]) == (None, None)  # no second part: the other part is the name


def test_rooms_in_text_against_brute_force(spark):
    words = [" amb", "amb", " dor", "dorm", "  ambientes", " ambiente", "x", " ", "1", "2", "10", "12", "0", "9", " dormitorios", "m"]
    rng = random.Random(5)
    texts = ["".join(rng.choice(words) for _ in range(rng.randint(0, 6))) for _ in range(3000)]
    endings = ["{} ambientes", "{} amb", "{} dormitorios", "{} dorm", "{} ambiente", "{}amb", "{} dor", "{}dorm", "{}  ambientes"]

    def expected(description):
        hits = [i for i in range(1, 11) if any(e.format(i) in description for e in endings)]
        return float(min(hits)) if hits else None

    df = column_of(spark, texts)
    assert values(df.select(text.rooms_in_text(F.col("x")).alias("c")), "c") == [expected(t) for t in texts]


def test_fills_and_defaults(spark):
    rows = [
        ("Monoambiente", None, None, None, None), ("3 amb con balcon", None, None, None, 1.0),
        ("nada", None, 2.0, 2.0, None), ("nada", 5.0, None, None, None), ("nada", 8.0, 0.0, None, None), (None, 1.0, None, None, 0.0),
    ]
    df = spark.createDataFrame(rows, "description string, rooms double, bedrooms double, bathrooms double, garages double")
    df = cleaning.fill_garages_zero(cleaning.fill_studio(cleaning.lowercase_description(df)))
    df = cleaning.drop_missing(cleaning.fill_rooms_from_text(df), "rooms")
    out = cleaning.derive_bathrooms(cleaning.derive_bedrooms(df)).collect()
    got = [(r["rooms"], r["bedrooms"], r["bathrooms"], r["garages"]) for r in out]
    assert got == [(1, 1, 1, 0), (3, 2, 1, 1), (5, 4, 2, 0), (8, 1, 3, 0), (1, 1, 1, 0)]


def test_coerce_numeric(spark):
    df = spark.createDataFrame([("1.5", 2.0), ("x", None), (None, 3.0)], "a string, b double")
    assert [tuple(r) for r in cleaning.coerce_numeric(df, ["a", "b"]).collect()] == [(1.5, 2.0), (None, None), (None, 3.0)]
