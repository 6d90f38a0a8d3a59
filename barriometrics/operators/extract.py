"""Listing cards out of result pages.

``extract_cards`` is a partition-wise scan: pages stream through it and nothing is shuffled. The
markup is read with the standard library's tokenizer; the portal's layout is a small rule table.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from barriometrics import schemas

ROWS_PER_BATCH = 5000
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())


@dataclass(frozen=True)
class Rule:
    """Where a value sits: tag plus one attribute that equals, starts with or lists ``value``."""

    tag: str
    attr: str
    value: str
    prefix: bool = False

    def holds(self, tag: str, attrs: dict[str, str]) -> bool:
        if tag != self.tag or self.attr not in attrs:
            return False
        found = attrs[self.attr] or ""
        if self.prefix:
            return found.startswith(self.value)
        return self.value in found.split() if self.attr == "class" else found == self.value


@dataclass(frozen=True)
class Layout:
    site: str
    container: Rule
    card: Rule
    link: Rule
    fields: dict[str, Rule] = field(default_factory=dict)
    item: Rule | None = None
    link_parent: Rule | None = None


# The two portals' markup.
LAYOUTS = {
    "Z": Layout(
        site="https://www.zonaprop.com.ar",
        container=Rule("div", "class", "postingsList-module__postings-container"),
        card=Rule("div", "class", "postingCardLayout-module__posting-card-container", prefix=True),
        link_parent=Rule("h3", "class", "postingCard-module__posting-description"),
        link=Rule("a", "href", "", prefix=True),
        fields={
            "price": Rule("div", "data-qa", "POSTING_CARD_PRICE"),
            "expenses": Rule("div", "data-qa", "expensas"),
            "location": Rule("h2", "data-qa", "POSTING_CARD_LOCATION"),
            "features": Rule("h3", "data-qa", "POSTING_CARD_FEATURES"),
            "description": Rule("h3", "data-qa", "POSTING_CARD_DESCRIPTION"),
        },
    ),
    "A": Layout(
        site="https://www.argenprop.com",
        container=Rule("div", "class", "listing-container"),
        card=Rule("div", "class", "listing__item", prefix=True),
        link=Rule("a", "class", "card"),
        fields={
            "price": Rule("p", "class", "card__price"),
            "currency": Rule("span", "class", "card__currency"),
            "expenses": Rule("span", "class", "card__expenses"),
            "address": Rule("p", "class", "card__address"),
            "location": Rule("p", "class", "card__title--primary"),
            "features": Rule("ul", "class", "card__main-features"),
            "description": Rule("h2", "class", "card__title"),
        },
        item=Rule("li", "", ""),
    ),
}


class CardReader(HTMLParser):
    """Collects one dict per card, in the order in which cards open; ``amount`` is the text right behind the currency mark.

    A card inside a matching element is a card of its own, and its text also belongs to the outer one. A
    page cut off in mid-card keeps what it has.

    Each tag costs constant time, however many cards and elements are open: open tags are counted by name,
    a card waits in a list for each thing that it still lacks, and texts are ranges of the page's pieces.
    Elements close last first, so what a closing card waits for lies at the ends of those lists.
    """

    def __init__(self, layout: Layout):
        super().__init__(convert_charrefs=True)
        self.layout = layout
        self.has_container = False
        self.cards: list[dict] = []
        self._pieces: list[str] = []
        self._open: list[tuple[str, list[tuple[dict, str]]]] = []
        self._named: Counter[str] = Counter()
        self._waiting: dict[str, list[dict]] = {name: [] for name in ("href", *layout.fields)}
        self._link_parents: list[int] = []
        self._listing: list[dict] = []
        self._after_currency: list[dict] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        values = dict(attrs)
        layout, depth = self.layout, len(self._open)
        roles: list[tuple[dict, str]] = []
        if layout.container.holds(tag, values):
            self.has_container = True
        if layout.card.holds(tag, values):
            card = {"items": None, "depth": depth}
            self.cards.append(card)
            roles.append((card, "card"))
            for waiting in self._waiting.values():
                waiting.append(card)
        self._after_currency = []
        if layout.link.holds(tag, values):
            self._link(values.get("href"))
        for name, rule in layout.fields.items():
            if self._waiting[name] and rule.holds(tag, values):
                for card in self._waiting[name]:
                    card[name] = [len(self._pieces), None]
                    roles.append((card, name))
                    if name == "features" and layout.item:
                        card["items"] = []
                self._waiting[name] = []
        if layout.item and tag == layout.item.tag:
            for card in self._listing:
                card["items"].append([len(self._pieces), None])
                roles.append((card["items"][-1], "item"))
        if tag in VOID_TAGS:
            for owner, role in roles:
                self._close(owner, role)
            return
        self._listing += [card for card, role in roles if role == "features" and layout.item]
        if layout.link_parent and layout.link_parent.holds(tag, values):
            self._link_parents.append(depth)
        self._named[tag] += 1
        self._open.append((tag, roles))

    def _link(self, href: str | None) -> None:
        """The link of all cards that have none and, where the layout asks for it, an open parent inside them."""
        waiting = self._waiting["href"]
        if self.layout.link_parent is None:
            first = len(waiting)
        else:
            first = bisect_right(waiting, self._link_parents[-1], key=lambda card: card["depth"]) if self._link_parents else 0
        for card in waiting[:first]:
            card["href"] = href
        del waiting[:first]

    def _close(self, owner, role: str) -> None:
        if role == "card":
            for waiting in self._waiting.values():
                if waiting and waiting[-1] is owner:
                    waiting.pop()
        elif role == "item":
            owner[1] = len(self._pieces)
        else:
            owner[role][1] = len(self._pieces)

    def handle_endtag(self, tag: str) -> None:
        if not self._named[tag]:
            return
        while self._open:
            name, roles = self._open.pop()
            self._named[name] -= 1
            if self._link_parents and self._link_parents[-1] == len(self._open):
                self._link_parents.pop()
            self._after_currency = [card for card, role in roles if role == "currency"]
            for owner, role in reversed(roles):
                self._close(owner, role)
                if role == "features" and self.layout.item:
                    self._listing.pop()
            if name == tag:
                break

    def handle_data(self, data: str) -> None:
        for card in self._after_currency:
            card.setdefault("amount", data.strip())
        self._after_currency = []
        self._pieces.append(data)

    def text(self, span: list[int | None]) -> str:
        """The text of an element; one that never closed runs to the page's end."""
        return "".join(self._pieces[span[0] : span[1]])


def _text(reader: CardReader, card: dict, name: str) -> str | None:
    return reader.text(card[name]).strip() if name in card else None


def read_cards(html: str, portal: str, need_container: bool = True) -> list[dict]:
    """Cards of one page in page order; none where the page lacks the result container it needs."""
    layout = LAYOUTS[portal]
    reader = CardReader(layout)
    reader.feed(html or "")
    reader.close()
    rows = []
    for card in reader.cards if reader.has_container or not need_container else []:
        href = card.get("href")
        url = layout.site + href if href is not None else None
        row = {name: _text(reader, card, name) for name in ("expenses", "address", "location", "description")}
        row["property_url"] = url
        if portal == "Z":
            row["code"] = url.split("-")[-1].split(".")[0] if url else None
            row["price"] = _text(reader, card, "price")
            features = _text(reader, card, "features")
            row["features"] = [features] if features is not None else None
        else:
            row["code"] = url.split("-")[-1] if url else None
            row["price"] = f"{_text(reader, card, 'currency')} {card.get('amount')}"
            row["expenses"] = row["expenses"].replace("+ ", "") if row["expenses"] is not None else None
            row["features"] = [reader.text(item).strip() for item in card["items"]] if card["items"] is not None else None
        rows.append(row)
    return rows


def extract_cards(pages: DataFrame, portal: str, features_from_first_card: bool = False) -> DataFrame:
    """One row per listing card of ``pages(url, html[, page])``, typed as ``schemas.CARD``.

    ``page`` is the page's place in the crawl, NULL where the pages do not carry it.

    ``features_from_first_card`` gives every card of a page the first card's features, as the older
    portal A extracts did. For portal Z the features text is the single item of the list.
    """
    names = schemas.CARD.fieldNames()

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for url, html, page in zip(batch["url"], batch["html"], batch["page"].astype(object)):
                cards = read_cards(html, portal)
                for pos, card in enumerate(cards):
                    if features_from_first_card:
                        card = {**card, "features": cards[0]["features"]}
                    rows.append({**card, "page": None if pd.isna(page) else page, "page_url": url, "page_pos": pos})
                if len(rows) >= ROWS_PER_BATCH:
                    yield pd.DataFrame(rows, columns=names)
                    rows = []
            yield pd.DataFrame(rows, columns=names)

    page = F.col("page").cast("bigint") if "page" in pages.columns else F.lit(None).cast("bigint")
    return pages.select("url", "html", page.alias("page")).mapInPandas(scan, schemas.CARD)


def page_listing_ids(pages: DataFrame, portal: str = "A") -> DataFrame:
    """``ids``, the sorted set of listing codes on each page, in place of its ``html``.

    Pages are read one by one, without a shuffle; the other columns pass through.
    """
    def codes(html: str) -> list[str]:
        cards = read_cards(html, portal, need_container=False)
        return sorted({card["code"] for card in cards if card["code"] is not None})

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.drop(columns="html").assign(ids=[codes(html) for html in batch["html"]])

    rest = [f for f in pages.schema.fields if f.name != "html"]
    schema = T.StructType([*rest, T.StructField("ids", T.ArrayType(T.StringType()))])
    return pages.mapInPandas(scan, schema)
