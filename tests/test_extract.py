from pyspark.sql import functions as F

from barriometrics.operators.extract import extract_cards, read_cards
from barriometrics.plans import flows

CARD_Z = """<div class="postingCardLayout-module__posting-card-container abc">
<div data-qa="POSTING_CARD_PRICE"><b>USD</b> 650<div>x</div></div><h2 data-qa="POSTING_CARD_LOCATION"> Palermo, CABA </h2>
<img src="a.png"><h3 data-qa="POSTING_CARD_FEATURES"><span>45 m&sup2; tot.</span> <span>2 amb.</span></h3>
<h3 class="postingCard-module__posting-description" data-qa="POSTING_CARD_DESCRIPTION"><a href="/p/depto-{code}.html">Luz &amp; aire<br/>sur</a></h3></div>"""
PAGE_Z = '<html><body><div class="a postingsList-module__postings-container">' + CARD_Z.format(code=11) + CARD_Z.format(code=22) + "</div></body></html>"
CARD_A = """<div class="listing__item x"><a class="card" href="/depto--{code}"><p class="card__price">{price}</p>
<p class="card__address">Calle 1</p><p class="card__title--primary show">Departamento en Alquiler en Palermo, Capital Federal</p>
{features}<h2 class="card__title">Lindo</h2></a></div>"""


def test_portal_z():
    cards = read_cards(PAGE_Z, "Z")
    assert [c["code"] for c in cards] == ["11", "22"]
    card = cards[0]
    assert card["property_url"] == "https://www.zonaprop.com.ar/p/depto-11.html"
    assert (card["price"], card["location"]) == ("USD 650x", "Palermo, CABA")
    assert (card["features"], card["description"]) == (["45 m² tot. 2 amb."], "Luz & airesur")
    assert card["expenses"] is None and card["address"] is None


def test_no_container_no_cards():
    assert read_cards(CARD_Z.format(code=1), "Z") == []
    assert read_cards("", "A") == [] and read_cards(None, "A") == []


def test_portal_a(spark):
    priced = '<span class="card__currency">USD</span> 500 <span class="card__expenses"> + $5.000 expensas</span>'
    listed = '<ul class="card__main-features"><li> 45 m² cubie.</li><li>2 ambientes<i></i></li></ul>'
    page = '<div class="listing-container">' + CARD_A.format(code=7, price=priced, features=listed) + CARD_A.format(code=8, price="Consultar", features="") + "</div>"
    first, second = read_cards(page, "A")
    assert (first["code"], first["price"], first["expenses"]) == ("7", "USD 500", "$5.000 expensas")
    assert first["features"] == ["45 m² cubie.", "2 ambientes"] and first["address"] == "Calle 1"
    assert (second["price"], second["features"], second["expenses"]) == ("None None", None, None)
    pages = spark.createDataFrame([("p1", page)], "url string, html string")
    shared = extract_cards(pages, "A", features_from_first_card=True).orderBy("page_pos").collect()
    assert [r["features"] for r in shared] == [first["features"]] * 2


def test_unclosed_tags_stay_inside_their_card():
    page = '<div class="listing-container"><div class="listing__item"><a class="card" href="/x--1"><p class="card__address">A<p>B</a></div><p class="card__address">no</p></div>'
    (card,) = read_cards(page, "A")
    assert card["address"].startswith("A") and "no" not in card["address"]


def test_pages_to_raw_keeps_the_first(spark):
    pages = spark.createDataFrame([("b", PAGE_Z.replace("650", "999")), ("a", PAGE_Z)], "url string, html string")
    raw = flows.pages_to_raw(pages, "Z").orderBy("zonaprop_code").collect()
    assert [(r["zonaprop_code"], r["price"]) for r in raw] == [("11", "USD 650x"), ("22", "USD 650x")]
    assert raw[0]["features"] == "45 m² tot. 2 amb."


def test_crawl_order_beats_address_order(spark):
    pages = spark.createDataFrame([("a", 2, PAGE_Z.replace("650", "999")), ("b", 1, PAGE_Z)], "url string, page int, html string")
    raw = flows.pages_to_raw(pages, "Z").collect()
    assert {r["price"] for r in raw} == {"USD 650x"}


def test_crawl_ends(spark):
    page = lambda *codes: '<div class="listing-container">' + "".join(CARD_A.format(code=c, price="", features="") for c in codes) + "</div>"
    rows = [
        ("dup", 1, "h", page(1, 2)), ("dup", 2, "h?pagina-2", page(2, 1)), ("dup", 3, "h?pagina-3", page(1, 2)), ("dup", 4, "h?pagina-4", page(9)),
        ("back", 1, "h", page(1)), ("back", 2, "h?pagina-1", page(2)), ("none", 1, "h", page(1)), ("none", 2, "h?pagina-2", page()), ("none", 3, "h?pagina-3", page(3)),
    ]
    pages = spark.createDataFrame(rows, "barrio string, page int, final_url string, html string")
    kept = flows.finished_crawl(pages).collect()
    assert sorted((r["barrio"], r["page"], r["ids"]) for r in kept) == [
        ("back", 1, ["1"]), ("dup", 1, ["1", "2"]), ("dup", 2, ["1", "2"]), ("none", 1, ["1"]),
    ]


def test_stream_appends_each_page_once(spark, tmp_path):
    from barriometrics.streaming.ingest import page_stream, write_cards

    folder, out, state = (str(tmp_path / n) for n in ("pages", "out", "state"))
    for name in ("a", "b"):
        spark.createDataFrame([(name, PAGE_Z)], "url string, html string").write.mode("append").parquet(folder)
        write_cards(page_stream(spark, folder), "Z", out, state).awaitTermination()
    counts = spark.read.parquet(out).groupBy("page_url").agg(F.count("*").alias("n")).collect()
    assert sorted((r["page_url"], r["n"]) for r in counts) == [("a", 2), ("b", 2)]


def _card(code, price):
    return f'<div class="listing__item"><a class="card" href="/depto--{code}"><p class="card__price"><span class="card__currency">USD</span> {price}</p></a>'


def test_wrapped_nested_and_cut_off_cards_are_kept():
    from barriometrics.operators.extract import read_cards

    three = "".join(_card(c, 100 + c) + "</div>" for c in (1, 2, 3))
    wrapped = read_cards(f'<div class="listing-container"><div class="listing__items">{three}</div></div>', "A")
    assert [c["code"] for c in wrapped] == ["1", "1", "2", "3"] and [c["price"] for c in wrapped[1:]] == ["USD 101", "USD 102", "USD 103"]
    cut = read_cards(f'<div class="listing-container">{_card(1, 5)}</div>{_card(2, 6)}', "A")
    assert [(c["code"], c["price"]) for c in cut] == [("1", "USD 5"), ("2", "USD 6")]
    nested = read_cards(f'<div class="listing-container">{_card(1, 5)}{_card(2, 6)}</div></div>', "A")
    assert [c["code"] for c in nested] == ["1", "2"]
