"""The card reader against a reading of the whole element tree, and its time on broken pages."""

import random
import time
from html.parser import HTMLParser

import pytest

from barriometrics.operators.extract import LAYOUTS, VOID_TAGS, read_cards


class Tree(HTMLParser):
    """Elements as [tag, attributes, children, closed]; an end tag closes the nearest element of its name and all inside."""

    def __init__(self, html):
        super().__init__(convert_charrefs=True)
        self.root = ["", {}, [], True]
        self.open = [self.root]
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        new = [tag, dict(attrs), [], False]
        self.open[-1][2].append(new)
        if tag not in VOID_TAGS:
            self.open.append(new)

    def handle_endtag(self, tag):
        if tag in [e[0] for e in self.open[1:]]:
            while True:
                closed = self.open.pop()
                if closed[0] == tag:
                    closed[3] = True
                    return

    def handle_data(self, data):
        self.open[-1][2].append(data)


def below(element):
    for child in element[2]:
        yield child
        if not isinstance(child, str):
            yield from below(child)


def text(element):
    return "".join(c for c in below(element) if isinstance(c, str))


def elements(element):
    return [c for c in below(element) if not isinstance(c, str)]


def brute(html, portal):
    layout, root = LAYOUTS[portal], Tree(html).root
    holds = lambda rule, e: rule.holds(e[0], e[1])
    out = []
    for card in (e for e in elements(root) if holds(layout.card, e)):
        inside = elements(card)
        own = {name: next((e for e in inside if holds(rule, e)), None) for name, rule in layout.fields.items()}
        within = [card, *inside] if layout.link_parent else []
        links = [e for p in within if holds(layout.link_parent, p) for e in elements(p)] if layout.link_parent else inside
        order = {id(e): k for k, e in enumerate(inside)}
        links = sorted((e for e in links if holds(layout.link, e)), key=lambda e: order[id(e)])
        href = links[0][1].get("href") if links else None
        row = {n: text(own[n]).strip() if own.get(n) else None for n in ("expenses", "address", "location", "description")}
        row["url"] = layout.site + href if href is not None else None
        if portal == "A":
            row["features"] = [text(e).strip() for e in elements(own["features"]) if e[0] == "li"] if own["features"] else None
        else:
            row["features"] = [text(own["features"]).strip()] if own["features"] else None
            row["price"] = text(own["price"]).strip() if own["price"] else None
        out.append(row)
    return out


def markup(portal, rng, parts):
    layout = LAYOUTS[portal]
    rules = [layout.card, *layout.fields.values(), layout.link, *([layout.link_parent] if layout.link_parent else []), *([layout.item] if layout.item else [])]
    out, names = [f'<{layout.container.tag} {layout.container.attr}="{layout.container.value}">'], []
    for k in range(parts):
        rule = rng.choice(rules) if rng.random() < 0.8 else None
        kind = rng.random()
        if kind < 0.5 and rule:
            attr = f' {rule.attr}="{rule.value}"' if rule.attr else ""
            out.append(f'<{rule.tag}{attr} href="/flat-{k}.html">')
            names.append(rule.tag)
        elif kind < 0.55:
            out.append(rng.choice(["<b>", "<br>", "<img src=x>", "<div>"]))
        elif kind < 0.8 and names:
            out.append(f"</{names.pop() if rng.random() < 0.8 else rng.choice(['div', 'b', 'h3', 'li', 'p'])}>")
        else:
            out.append(rng.choice(["text", " $ 500.000 ", "40 m² &amp; más", "\n", "+ $ 9.000 Expensas"]))
    return "".join(out)


@pytest.mark.parametrize("portal", ["Z", "A"])
def test_broken_nested_and_cut_off_pages_read_as_their_tree(portal):
    rng = random.Random(portal)
    for _ in range(400):
        html = markup(portal, rng, rng.randint(1, 60))
        got = read_cards(html, portal)
        expected = brute(html, portal)
        assert len(got) == len(expected)
        for g, e in zip(got, expected, strict=True):
            if portal == "A" and g["expenses"] is not None:
                e["expenses"] = e["expenses"].replace("+ ", "")
            e["property_url"] = e.pop("url")
            assert {k: g[k] for k in e} == e, html


@pytest.mark.parametrize("portal", ["Z", "A"])
def test_unclosed_cards_take_time_in_proportion(portal):
    layout = LAYOUTS[portal]
    card = f'<{layout.card.tag} {layout.card.attr}="{layout.card.value}">'
    price = layout.fields["price"]
    card += f'<{price.tag} {price.attr}="{price.value}">$ 1</{price.tag}><i>x</b>'
    start = time.process_time()
    cards = read_cards(f'<{layout.container.tag} {layout.container.attr}="{layout.container.value}">' + card * 20_000, portal)
    assert len(cards) == 20_000 and time.process_time() - start < 20
