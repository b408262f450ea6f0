"""Blocks of an HTML page: headings, label and value pairs, prose. Standard library only."""

from __future__ import annotations

import re
import unicodedata
from html.parser import HTMLParser

# Fixed values.
DROPPED = frozenset("script style noscript svg nav footer header iframe select textarea button".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
FIELD_CLASSES = frozenset("mets-field mets-field-view form-field field".split())
PROSE_CLASS = re.compile("description|body|content|desc", re.I)
VALUE_CLASS = re.compile("body|value")
LABEL_CLASS, BODY_CLASS = "mets-field-label", "mets-field-body"
CONTACT = "contact information"
SHORTEST_PROSE = 40


class Element:
    def __init__(self, tag: str, attrs: dict[str, str], parent: Element | None):
        self.tag, self.attrs, self.parent, self.parts = tag, attrs, parent, []

    @property
    def classes(self) -> list[str]:
        return self.attrs.get("class", "").split()

    def walk(self):
        """All elements below, in page order."""
        todo = [p for p in reversed(self.parts) if isinstance(p, Element)]
        while todo:
            e = todo.pop()
            yield e
            todo += [p for p in reversed(e.parts) if isinstance(p, Element)]

    def texts(self):
        todo: list = list(reversed(self.parts))
        while todo:
            p = todo.pop()
            if isinstance(p, Element):
                todo += reversed(p.parts)
            else:
                yield p

    def text(self) -> str:
        joined = " ".join(t.strip() for t in self.texts() if t.strip())
        return " ".join(unicodedata.normalize("NFKC", joined).split())

    def find(self, tags, class_: str | re.Pattern | None = None) -> Element | None:
        fits = lambda e: class_ is None or any(class_.search(c) if isinstance(class_, re.Pattern) else c == class_ for c in e.classes)
        return next((e for e in self.walk() if e.tag in tags and fits(e)), None)


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Element("", {}, None)

    def handle_starttag(self, tag, attrs):
        if tag in ("p", "li", "dt", "dd", "tr", "td", "th") and self.at.tag == tag or tag in ("dt", "dd") and self.at.tag in ("dt", "dd") or tag in ("td", "th") and self.at.tag in ("td", "th"):
            self.at = self.at.parent
        e = Element(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.parts.append(e)
        if tag not in VOID:
            self.at = e

    def handle_endtag(self, tag):
        e = self.at
        while e.parent is not None and e.tag != tag:
            e = e.parent
        if e.parent is not None:
            self.at = e.parent

    def handle_data(self, data):
        self.at.parts.append(data)


def tree(source: str) -> Element:
    """The page's elements without those that hold no content; forms stay."""
    b = _Builder()
    b.feed(source)
    b.close()
    todo = [b.root]
    while todo:
        e = todo.pop()
        e.parts = [p for p in e.parts if not isinstance(p, Element) or p.tag not in DROPPED and p.tag != "input"]
        todo += [p for p in e.parts if isinstance(p, Element)]
    return b.root


def _filler(label: str) -> bool:
    return not label or label.lower() in ("n/a", "-") or len(label) > 80


def read_pair(e: Element, section: str | None) -> tuple[str, str] | None:
    """The label and value of an element, by the first way that fits: field markup, definition or header cells, table cells, "k: v" items."""
    label, body = e.find(("span",), LABEL_CLASS) or e.find(("dt", "th", "label", "strong")), e.find(("div",), BODY_CLASS) or e.find(("dd",)) or e.find(("div",), VALUE_CLASS)
    if label is not None and body is not None:
        name, value = label.text(), body.text()
        if not value:
            return None
        if _filler(name):
            return (section, value) if section and section.lower() == CONTACT else None
        return name, value
    if e.tag == "tr":
        cells = [c for c in e.walk() if c.tag in ("td", "th")]
        if len(cells) >= 2:
            name, value = cells[0].text(), cells[1].text()
            if name and value and not _filler(name):
                return name, value
    if e.tag == "li":
        text = e.text()
        name, colon, value = (x.strip() for x in text.partition(":"))
        if colon and len(text) < 300 and name and value and len(name) < 60:
            return name, value
    return None


def parse(content: bytes | str) -> list[dict]:
    """Rows with kind, text, section, label, label_value, synthetic and block_id, in page order.

    The first row is synthetic and joins all pairs, so that patterns can see
    labels and values together.
    """
    root = tree(content.decode("utf-8", "replace") if isinstance(content, bytes) else content)
    rows, known, section = [], {}, None
    for e in root.walk():
        if e.tag in ("h1", "h2", "h3", "h4"):
            text = e.text()
            if text and len(text) < 80:
                section = text
                rows.append({"block_id": f"p1.h{len(rows) + 1}", "kind": "heading", "text": text, "section": text})
        elif e.tag in ("dt", "tr", "li") or e.tag == "div" and (set(e.classes) & FIELD_CLASSES or e.find(("span",), LABEL_CLASS) or e.find(("dt",))):
            pair = read_pair(e, section)
            if pair and known.get(pair[0]) != pair[1]:
                known.setdefault(*pair)
                rows.append({"block_id": f"p1.f{len(rows) + 1}", "kind": "label_value", "text": f"{pair[0]}: {pair[1]}", "section": section, "label": pair[0], "label_value": pair[1]})
    seen = set()
    for e in root.walk():
        if e.tag in ("p", "div") and any(PROSE_CLASS.search(c) for c in e.classes):
            text = e.text()
            if len(text) >= SHORTEST_PROSE and text not in seen and not e.find(("div",), "mets-field"):
                seen.add(text)
                rows.append({"block_id": f"p1.p{len(rows) + 1}", "kind": "text", "text": text})
    if known:
        rows.insert(0, {"block_id": "p1.meta0", "kind": "text", "text": "\n".join(f"{k}: {v}" for k, v in known.items()), "synthetic": True})
    return rows
