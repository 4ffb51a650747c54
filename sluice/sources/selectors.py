"""Fields of listing cards by selectors: ``css@attribute => pattern``.

A selector is compiled on the driver to one regular expression over the path of an element
from the top of its page, each step with its tag, id, classes, attributes and place. Pages are
walked once, in Arrow batches: an element's path is looked up among all selectors, so their
number doesn't change how often a page is read. What a selector finds is refined by Columns.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.functions import prose
from sluice.functions.text import fold

#: Elements without content, and what an element closes when it opens.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
CLOSES = {"li": ("li",), "p": ("p",), "option": ("option",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "dt": ("dt", "dd"), "dd": ("dt", "dd")}
#: Where an element is closed no further than.
WITHIN = {"li": ("ul", "ol"), "tr": ("table",), "td": ("tr",), "th": ("tr",), "dt": ("dl",), "dd": ("dl",)}
_NAME = r"[A-Za-z_][\w-]*"
_PART = re.compile(rf"(?P<tag>{_NAME}|\*)|#(?P<id>[\w-]+)|\.(?P<css>[\w-]+)|\[(?P<attr>[\w:-]+)(?:(?P<how>[\^$*~]?=)(?P<quote>[\"']?)(?P<value>[^\]]*?)(?P=quote))?\]|:nth-child\((?P<nth>\d+)\)|:(?P<first>first)-child")
_ATTRIBUTE = re.compile(r"^[A-Za-z_:][-A-Za-z0-9_:.]*$")
_STEP = r"(?:/[^/]*)*"


def _plain(value: str) -> str:
    return quote(value, safe="")


def _compound(text: str) -> str:
    """A step of a path that one compound selector holds for."""
    tag, tests, at = "[^/;]+", [], 0
    while at < len(text):
        m = _PART.match(text, at)
        if not m or (m["tag"] and at):
            raise ValueError(f"not a selector: {text}")
        at = m.end()
        if m["tag"]:
            tag = "[^/;]+" if m["tag"] == "*" else re.escape(m["tag"].lower())
        elif m["attr"]:
            name, value = re.escape(_plain(m["attr"].lower())), re.escape(_plain(m["value"] or ""))
            any_ = "[^/;]*"
            tests.append({None: f"@{name}={any_}", "=": f"@{name}={value}", "^=": f"@{name}={value}{any_}", "$=": f"@{name}={any_}{value}", "*=": f"@{name}={any_}{value}{any_}", "~=": f"@{name}=(?:{any_}%20)?{value}(?:%20{any_})?"}[m["how"]])
        else:
            tests.append(f"#{re.escape(_plain(m['id']))}" if m["id"] else rf"\.{re.escape(_plain(m['css']))}" if m["css"] else f":{1 if m['first'] else int(m['nth'])}")
    return f"/{tag};" + "".join(f"(?=(?:[^/;]*;)*{t};)" for t in tests) + "[^/]*"


def path_pattern(css: str) -> str:
    """The expression over paths that a selector means: commas, descendants and children."""
    found = []
    for one in re.split(r",(?![^\[]*\])", css):
        steps = [s for s in re.split(r"\s*(>)\s*|\s+(?![^\[]*\])", one.strip()) if s]
        if not steps or steps[0] == ">" or steps[-1] == ">":
            raise ValueError(f"not a selector: {css}")
        pattern, child = _STEP, True
        for step in steps:
            if step == ">":
                child = True
                continue
            pattern += ("" if child else _STEP) + _compound(step)
            child = False
        found.append(pattern)
    return "^(?:" + "|".join(found) + ")$"


@dataclass(frozen=True)
class Selector:
    """css is empty for the card itself; attribute and capture may be missing."""

    css: str
    attribute: str | None
    capture: str | None

    @classmethod
    def parse(cls, entry: str) -> Selector:
        head, _, capture = entry.partition("=>")
        css, at, name = head.strip().rpartition("@")
        # An @ inside of an attribute's value isn't followed by a bare name.
        if not at or not _ATTRIBUTE.match(name):
            css, name = head.strip(), None
        return cls(css.strip(), name, capture.strip() or None)

    def refine(self, raw: Column) -> Column:
        """What the capture makes of a value: its first group, or the whole match without
        one, or what a named reader reads (prose:floor, prose:elevator); null for nothing."""
        if self.capture is None:
            return raw
        if self.capture.startswith("prose:"):
            folded = fold(raw)
            readers = {"floor": lambda: prose.floor_of(folded).cast("string"), "elevator": lambda: F.when(prose.lift_of(folded), "oui").when(~prose.lift_of(folded), "non")}
            return readers[self.capture.removeprefix("prose:")]()
        group = 1 if re.compile(self.capture).groups else 0
        found = F.trim(F.regexp_extract(raw, self.capture, group))
        return F.when(found != "", found)


class _Walk(HTMLParser):
    """One walk over a page: cards, and in each the first element of every selector."""

    def __init__(self, item: re.Pattern, fields: list[tuple[re.Pattern | None, str | None]]):
        super().__init__(convert_charrefs=True)
        self.item, self.fields, self.stack, self.cards = item, fields, [], []

    def _leave(self, depth: int) -> None:
        while len(self.stack) > depth:
            for kept, place, texts in self.stack.pop()["open"]:
                kept[place] = "".join(texts)

    def handle_starttag(self, tag, attrs):
        for at in range(len(self.stack) - 1, -1, -1):
            here = self.stack[at]["tag"]
            if here in CLOSES.get(tag, ()):
                self._leave(at)
                break
            if here in WITHIN.get(tag, ()) or tag not in CLOSES:
                break
        given = {k: v or "" for k, v in reversed(attrs)}
        above = self.stack[-1] if self.stack else {"path": "", "children": 0, "card": None}
        if self.stack:
            above["children"] += 1
        marks = [f".{_plain(c)}" for c in given.get("class", "").split()] + [f"@{_plain(k)}={_plain(v)}" for k, v in given.items()] + [f":{max(above['children'], 1)}"]
        if "id" in given:
            marks.append(f"#{_plain(given['id'])}")
        path = f"{above['path']}/{tag};" + "".join(f"{m};" for m in marks)
        card, open_ = above["card"], []
        if self.item.match(path):
            # A card in a card is one of its own; the outer one goes on behind it.
            card = [None] * len(self.fields)
            self.cards.append(card)
            found = [i for i, (pattern, _) in enumerate(self.fields) if pattern is None]
        else:
            found = [i for i, (pattern, _) in enumerate(self.fields) if card is not None and pattern is not None and card[i] is None and pattern.match(path)]
        for i in found:
            name = self.fields[i][1]
            card[i] = given.get(name.lower(), "") if name else ""
            if name is None:
                open_.append((card, i, []))
        if tag not in VOID:
            self.stack.append({"tag": tag, "path": path, "children": 0, "card": card, "open": open_})

    def handle_endtag(self, tag):
        for at in range(len(self.stack) - 1, -1, -1):
            if self.stack[at]["tag"] == tag:
                self._leave(at)
                break

    def handle_data(self, data):
        for level in self.stack:
            for _, _, texts in level["open"]:
                texts.append(data)

    def done(self) -> list[list[str]]:
        self.close()
        self._leave(0)
        return self.cards


def select(pages: DataFrame, item: str, fields: dict[str, str]) -> DataFrame:
    """(url, place, fields map<string,string>): a row for each element of ``pages`` (url,
    html) that ``item`` selects, in their order, with what each entry of ``fields`` finds in it.

    An entry is a selector (the element itself if it is empty), then @ and an
    attribute, then => and a pattern or a named reader. Selectors have tags, ids, classes,
    attributes, places among children, descendants, children and commas; the first
    element in the card counts, and ancestors above the card count as well. White space
    is one blank. What isn't found is null, never empty. A selector or pattern that can't
    be read is an error where it is given. Null pages have no cards.
    """
    parsed = {name: Selector.parse(entry) for name, entry in fields.items()}
    for s in parsed.values():
        if s.capture and s.capture.startswith("prose:") and s.capture not in ("prose:floor", "prose:elevator"):
            raise ValueError(f"no such reader: {s.capture}")
    compiled = re.compile(path_pattern(item)), [(re.compile(path_pattern(s.css)) if s.css else None, s.attribute) for s in parsed.values()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            urls, places, values = [], [], []
            for url, html in zip(batch["url"].to_pylist(), batch["html"], strict=True):
                walk = _Walk(*compiled)
                walk.feed(html.as_py() or "")
                for place, card in enumerate(walk.done()):
                    urls.append(url)
                    places.append(place)
                    values.append([None if v is None else " ".join(v.split()) or None for v in card])
            yield pa.RecordBatch.from_arrays([pa.array(urls, pa.string()), pa.array(places, pa.int32()), pa.array(values, pa.list_(pa.string()))], names=["url", "place", "found"])

    raw = pages.select("url", "html").mapInArrow(read, "url string, place int, found array<string>")
    entries = [x for i, (name, s) in enumerate(parsed.items()) for x in (F.lit(name), s.refine(F.get("found", F.lit(i))))]
    return raw.select("url", "place", (F.create_map(*entries) if entries else F.create_map().cast("map<string,string>")).alias("fields"))
