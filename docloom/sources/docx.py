"""Blocks of a Word document: paragraphs, label pairs, tables. Standard library only."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_PAIR = re.compile(r"([A-Z][A-Za-z0-9 /#&()\-]{1,48}):\s*(\S.*)", re.S)


def _text(e) -> str:
    parts = []
    for x in e.iter():
        if x.tag == W + "t":
            parts.append(x.text or "")
        elif x.tag in (W + "tab", W + "br"):
            parts.append(" ")
    return " ".join("".join(parts).split())


def parse(content: bytes) -> list[dict]:
    """Headings by style name, "Label: value" paragraphs, tables with their cells.

    Table rows below the first are also pairs of their first two cells, even
    with an empty value.
    """
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(W + "body")
        names = {}
        if "word/styles.xml" in z.namelist():
            for s in ElementTree.fromstring(z.read("word/styles.xml")).iter(W + "style"):
                name = s.find(W + "name")
                names[s.get(W + "styleId")] = name.get(W + "val") if name is not None else ""
    rows, section = [], None
    for e in body if body is not None else []:
        if e.tag == W + "p":
            text = _text(e)
            if not text:
                continue
            style = e.find(f"{W}pPr/{W}pStyle")
            style = names.get(style.get(W + "val"), style.get(W + "val")) if style is not None else ""
            if "heading" in (style or "").lower():
                section = text
                rows.append({"kind": "heading", "text": text, "section": text})
            elif m := _PAIR.fullmatch(text):
                rows.append({"kind": "label_value", "text": text, "section": section, "label": m[1], "label_value": m[2]})
            else:
                rows.append({"kind": "text", "text": text, "section": section})
        elif e.tag == W + "tbl":
            grid = [[_text(c) for c in r.iter(W + "tc")] for r in e.iter(W + "tr")]
            grid = [r for r in grid if any(r)]
            if len(grid) >= 2:
                rows.append({"kind": "table", "text": "\n".join(" | ".join(r) for r in grid), "section": section, "table": grid})
                rows += [{"kind": "label_value", "text": f"{r[0]}: {r[1]}", "section": section, "label": r[0], "label_value": r[1]} for r in grid[1:] if len(r) >= 2 and r[0]]
    return rows
