"""Entries of an HTML fragment: bodies and the labelled fields that follow them."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.functions import udtf

from quoteverify.functions import constants as C

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class _Cards(HTMLParser):
    """Walks the fragment once. A body is kept for its parent; an info block reads the labels and, after each, the text up to
    the next one."""

    def __init__(self, body: str, info: str, label: str):
        super().__init__()
        self.names = {"body": body, "info": info, "label": label}
        self.open: list[tuple[str, set[str]]] = []
        self.parts: dict[str, list[str]] = {}
        self.last_body: dict[int, str] = {}  # by depth of the parent
        self.cards: list[tuple[str, list[tuple[str, str]]]] = []
        self.fields: list[list] = []

    def _inside(self, kind: str) -> int | None:
        return next((i for i, (_, roles) in enumerate(self.open) if kind in roles), None)

    def handle_starttag(self, tag, attrs):
        if tag in VOID:
            return
        classes = set((dict(attrs).get("class") or "").split())
        roles = {kind for kind, name in self.names.items() if name in classes}
        if "label" in roles and self._inside("info") is not None:
            self.fields.append([[], []])
        if "info" in roles:
            self.fields = []
        if "body" in roles:
            self.parts["body"] = []
        self.open.append((tag, roles))

    def handle_data(self, data):
        text = data.strip()
        if not text:
            return
        if self._inside("body") is not None:
            self.parts["body"].append(text)
        elif self._inside("info") is not None and self.fields:
            self.fields[-1][0 if self._inside("label") is not None else 1].append(text)

    def handle_endtag(self, tag):
        while any(name == tag for name, _ in self.open):
            name, roles = self.open.pop()
            if "body" in roles:
                self.last_body[len(self.open)] = " ".join(self.parts.pop("body", []))
            if "info" in roles:
                self.cards.append((self.last_body.get(len(self.open), ""), [("".join(k), " ".join(v)) for k, v in self.fields]))
                self.fields = []
            self.last_body.pop(len(self.open) + 1, None)
            if name == tag:
                break


def parse_cards(html: str, body: str = "hadith", info: str = "hadith-info", label: str = "info-subtitle", fields: dict[str, str] = C.CARD_FIELDS) -> list[dict[str, str]]:
    """text and the fields of each entry; unknown labels are left out, missing fields are empty."""
    reader = _Cards(body, info, label)
    reader.feed(html or "")
    reader.close()
    out = []
    for text, pairs in reader.cards:
        entry = {"text": re.sub(r"^\d+\s*-\s*", "", text)} | dict.fromkeys(fields.values(), "")
        for key, value in pairs:
            if name := fields.get(key.rstrip(":").strip()):
                entry[name] = value.strip(" |")
        out.append(entry)
    return out


ENTRY = "text string, narrator string, scholar string, source string, number string, grade string"


@udtf(returnType=f"entry_no int, {ENTRY}")
class HtmlCards:
    """``html_cards(html)`` for SQL."""

    def eval(self, html: str):
        for no, e in enumerate(parse_cards(html)):
            yield (no, *(e[k] for k in ("text", "narrator", "scholar", "source", "number", "grade")))


def cards(pages: DataFrame, key: str, html: str = "html", **selectors) -> DataFrame:
    """(key, entry_no, the fields) of the entries of each page."""
    kind = dict(pages.dtypes)[key]
    names = ["text", *(selectors.get("fields") or C.CARD_FIELDS).values()]

    def run(batches):
        for batch in batches:
            rows = [(i, no, *(e[n] for n in names)) for i, page in enumerate(batch.column(html).to_pylist()) for no, e in enumerate(parse_cards(page, **selectors))]
            columns = list(zip(*rows)) if rows else [[] for _ in range(2 + len(names))]
            yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(columns[0], pa.int64())), pa.array(columns[1], pa.int32()), *(pa.array(c, pa.string()) for c in columns[2:])], [key, "entry_no", *names])

    return pages.select(key, html).mapInArrow(run, f"{key} {kind}, entry_no int, " + ", ".join(f"{n} string" for n in names))
