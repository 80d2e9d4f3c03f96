"""Texts of elements by class name: one scan of the markup with a stack of open tags."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfwise.functions.text import col

# elements without an end tag, and elements whose content is no text
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_RAW = re.compile(r"<(script|style)\b[^>]*>.*?(?:</\1\s*>|\Z)", re.I | re.S)
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(?P<end>/)?(?P<name>[a-zA-Z][\w:-]*)(?P<rest>(?:[^<>"']|"[^"]*"|'[^']*')*)>|(?P<text>[^<]+|<)""", re.S)
_CLASS = re.compile(r"""(?:^|\s)class\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
# the same tags, possessively; everything else is text
_TAG = re.compile(r"""<(/?[a-zA-Z][^<>"']*+(?:"[^"]*"[^<>"']*+|'[^']*'[^<>"']*+)*+)>""")
_NAME = re.compile(r"/?([a-zA-Z][\w:-]*)")
#: Tags and layouts that a task remembers; beyond that it begins anew.
MEMO = 20_000


def scan(html: str, names: Sequence[str]) -> dict[str, str]:
    """For every class name part, the text of the first element whose class contains it and that has any text.

    The text is that of the whole element, nested ones included: its pieces trimmed and joined. An end tag closes its element and what is
    still open inside; one without a start is passed over; what is open at the end of the markup ends there.
    """
    found: dict[str, tuple[int, str]] = {}
    pieces: list[str] = []
    stack: list[tuple[str, list[str], int, int]] = []
    opened: dict[str, int] = {}

    def close() -> None:
        tag, wanted, first, at = stack.pop()
        opened[tag] -= 1
        if wanted and len(pieces) > first:
            text = "".join(pieces[first:])
            for n in wanted:
                # inner elements close first, but the outer one that has the name too comes before them
                if n not in found or at < found[n][0]:
                    found[n] = at, text

    for at, t in enumerate(_TOKEN.finditer(_RAW.sub(" ", html))):
        if t["text"] is not None:
            piece = t["text"].strip()
            if piece:
                pieces.append(piece)
        elif t["name"]:
            tag = t["name"].lower()
            if t["end"]:
                if opened.get(tag):
                    while stack[-1][0] != tag:
                        close()
                    close()
            elif tag not in _VOID and not t["rest"].rstrip().endswith("/"):
                c = _CLASS.search(t["rest"])
                value = (c[1] or c[2] or c[3] or "").lower() if c else ""
                stack.append((tag, [n for n in names if n in value], len(pieces), at))
                opened[tag] = opened.get(tag, 0) + 1
    while stack:
        close()
    return {n: text for n, (_, text) in found.items()}


class Layouts:
    """:func:`scan` by layout: cards of one template hold the same tags, so where a text stands is found once per layout.

    A layout is what the tags of a text mean and which of its pieces are blank; of another text with the same layout the pieces are joined at once.
    """

    def __init__(self, fields: Mapping[str, Sequence[str]]):
        self.fields = {f: tuple(n.lower() for n in parts) for f, parts in fields.items()}
        self.names = tuple(dict.fromkeys(n for parts in self.fields.values() for n in parts))
        self.tags: dict[str, tuple[str, str, tuple[str, ...]]] = {}
        self.spans: dict[tuple, list[tuple[int, int]] | None] = {}

    def texts(self, html: str) -> list[str]:
        """The text of every field, ``''`` without one."""
        parts = _TAG.split(html)
        if html.count("<") != len(parts) // 2:  # comments, or a sign that opens no tag
            return self.scanned(html)
        if len(self.tags) > MEMO:
            self.tags.clear()
        pieces = [t.strip() for t in parts[::2]]
        known = self.tags
        layout = tuple([known.get(t) or self.tag(t) for t in parts[1::2]]), tuple(map(bool, pieces))
        if layout not in self.spans:
            if len(self.spans) > MEMO:
                self.spans.clear()
            self.spans[layout] = self.walk(*layout)
        spans = self.spans[layout]
        return self.scanned(html) if spans is None else ["".join(pieces[a:b]) for a, b in spans]

    def scanned(self, html: str) -> list[str]:
        found = scan(html, self.names)
        return [next((found[n] for n in parts if n in found), "") for parts in self.fields.values()]

    def tag(self, t: str) -> tuple[str, str, tuple[str, ...]]:
        """Kind, name and wanted class name parts of a tag."""
        name = _NAME.match(t)[1]
        tag, rest = name.lower(), t[t.index(name) + len(name):]
        c = _CLASS.search(rest)
        value = (c[1] or c[2] or c[3] or "").lower() if c else ""
        if tag.startswith(("script", "style")):
            kind = "raw"
        elif t[0] == "/":
            kind = "end"
        else:
            kind = "none" if tag in _VOID or rest.rstrip().endswith("/") else "start"
        self.tags[t] = kind, tag, tuple(n for n in self.names if n in value) if kind == "start" else ()
        return self.tags[t]

    def walk(self, tags: Sequence[tuple[str, str, tuple[str, ...]]], filled: Sequence[bool]) -> list[tuple[int, int]] | None:
        """First and last piece of every field's text; none where content is no text."""
        found: dict[str, tuple[int, int]] = {}
        stack: list[tuple[str, tuple[str, ...], int]] = []
        opened: dict[str, int] = {}

        def close(upto: int) -> None:
            tag, wanted, first = stack.pop()
            opened[tag] -= 1
            if wanted and any(filled[first:upto]):
                for n in wanted:
                    # as in scan, an outer element comes before those inside it
                    if n not in found or first < found[n][0]:
                        found[n] = first, upto

        for at, (kind, tag, wanted) in enumerate(tags, 1):
            if kind == "raw":
                return None
            if kind == "end" and opened.get(tag):
                while stack[-1][0] != tag:
                    close(at)
                close(at)
            elif kind == "start":
                stack.append((tag, wanted, at))
                opened[tag] = opened.get(tag, 0) + 1
        while stack:
            close(len(filled))
        return [next((found[n] for n in parts if n in found), (0, 0)) for parts in self.fields.values()]


def element_texts(html, fields: Mapping[str, Sequence[str]]) -> Column:
    """Struct of a string per field: the text behind the first of its class name parts that has any, else ``''``."""
    fields = {f: tuple(parts) for f, parts in fields.items()}
    layouts: list[Layouts] = []

    @F.arrow_udf(", ".join(f"{f} string" for f in fields))
    def texts(cells: pa.Array) -> pa.Array:
        if not layouts:
            layouts.append(Layouts(fields))
        none = [""] * len(fields)
        rows = [layouts[0].texts(c) if c else none for c in cells.to_pylist()]
        columns = zip(*rows) if rows else [[]] * len(fields)
        return pa.StructArray.from_arrays([pa.array(c, pa.string()) for c in columns], names=list(fields))

    return texts(col(html))
