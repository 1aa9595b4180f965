"""Values of a page's elements by selectors, matched while the page is parsed.

A selector's parts are tested as an element begins; what its ancestors have matched is carried
down as one number of bits. Elements themselves never leave Python: a page gives the values
that were asked for, or one entry a box (a card, or the page) with its fields.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_PART = re.compile(r"([.#])([\w-]+)|\[([\w:-]+)(?:([*^$]?=)[\"']?([^\]\"']*)[\"']?)?\]")
#: White space as ``functions.text.SPACES`` has it.
_SPACES = re.compile("[\\t-\\r \\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff]+")
_TESTS = {"=": str.__eq__, "*=": str.__contains__, "^=": str.startswith, "$=": str.endswith}
#: Steps that are climbed from a link, and the longest text of a card that is looked for.
CLIMB, LONGEST_CARD = 5, 1500
_DIGIT = re.compile("[0-9]")
_PLAIN_TAG = re.compile('<([a-z][a-z0-9]*)((?: [a-zA-Z][-a-zA-Z0-9_:]*="[^"&]*")*)>')
_PLAIN_ATTRIBUTE, _PLAIN_END = re.compile(' ([a-zA-Z][-a-zA-Z0-9_:]*)="([^"&]*)"'), re.compile("</([a-z][a-z0-9]*)>")
#: Elements whose content is no markup, by any version of the standard parser.
_RAW = frozenset("script style textarea title iframe noembed noframes noscript xmp plaintext".split())
#: Pages, and characters of pages, whose values are Python's objects at once.
PAGES, CHARACTERS = 64, 1_000_000

#: A field's ways in turn: (selector, attribute, ``text``, or ``leaves`` for the texts of the innermost elements).
Ways = list[tuple[str, str]]


class Selectors:
    """Selectors (``tag``, ``.class``, ``#id``, ``[name]``, ``[name=v]`` with ``*=``, ``^=``, ``$=``, joined; descendants after blanks; alternatives after commas)."""

    def __init__(self, selectors: list[str]) -> None:
        self.by_tag: dict[str, list[tuple]] = {}
        n = 0
        for i, selector in enumerate(selectors):
            for one in selector.split(","):
                parts = one.split()
                for k, part in enumerate(parts):
                    tag = re.match(r"[\w*-]*", part)[0]
                    need = 1 << (n - 1) if k else 0
                    self.by_tag.setdefault("" if tag in ("", "*") else tag, []).append((_PART.findall(part), need, 1 << n, i if k == len(parts) - 1 else None))
                    n += 1
        #: What an element without attributes can match: parts without tests.
        self.bare = [x for x in self.by_tag.get("", ()) if not x[0]]

    def match(self, tag: str, values: dict[str, str], classes: list[str], above: int) -> tuple[int, list[int]]:
        """The parts that the element matches, as bits, and the selectors that it is found by; ``above``: what its ancestors match."""
        bits, found = 0, []
        for parts in (self.by_tag.get(tag, ()), self.by_tag.get("", ()) if values else self.bare):
            for tests, need, own, selector in parts:
                if above & need == need:
                    for test in tests:
                        if not _holds(test, values, classes):
                            break
                    else:
                        bits |= own
                        if selector is not None and selector not in found:
                            found.append(selector)
        return bits, found


def _holds(test: tuple[str, ...], values: dict[str, str], classes: list[str]) -> bool:
    mark, value, name, how, text = test
    if mark == ".":
        return value in classes
    if mark == "#":
        return values.get("id") == value
    return name in values and (not how or _TESTS[how](values[name], text))


class Tags(HTMLParser):
    """The standard parser, which takes tags in their plain form (lower case, values in double quotes without references) by one pattern; all else goes the standard way."""

    def parse_starttag(self, i: int) -> int:
        plain = _PLAIN_TAG.match(self.rawdata, i)
        if not plain or plain[1] in _RAW:
            return super().parse_starttag(i)
        self.lasttag = plain[1]
        self.handle_starttag(plain[1], [(k.lower(), v) for k, v in _PLAIN_ATTRIBUTE.findall(plain[2])])
        return plain.end()

    def parse_endtag(self, i: int) -> int:
        plain = _PLAIN_END.match(self.rawdata, i) if self.cdata_elem is None else None
        if not plain:
            return super().parse_endtag(i)
        self.handle_endtag(plain[1])
        return plain.end()

    def updatepos(self, i: int, j: int) -> int:
        """Lines are not counted."""
        return j


class Walk(Tags):
    """One pass over a page: where elements begin and end, and which of them each selector finds."""

    def __init__(self, selectors: Selectors, count: int, page: str) -> None:
        super().__init__(convert_charrefs=True)
        self.selectors = selectors
        self.found: list[list[int]] = [[] for _ in range(count)]
        self.values: dict[int, dict[str, str]] = {}
        self.tags: dict[int, str] = {}
        self.last: list[int] = []
        self.parent: list[int] = []
        self.spans: list[tuple[int, int]] = []
        self.stack: list[tuple[int, str, int]] = []
        self.words: list[str] = []
        self.size = 0
        self.feed(page)
        self.close()
        while self.stack:
            self._end(self.stack.pop())
        self.text = "".join(w + " " for w in self.words)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        at, above = len(self.last), self.stack[-1][2] if self.stack else 0
        values = {k: v or "" for k, v in attrs}
        bits, found = self.selectors.match(tag, values, values.get("class", "").split(), above)
        for i in found:
            self.found[i].append(at)
        if found:
            self.values[at] = values
        self.last.append(at)
        self.parent.append(self.stack[-1][0] if self.stack else -1)
        self.spans.append((self.size, self.size))
        if tag not in VOID:
            self.stack.append((at, tag, above | bits))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self._end(self.stack.pop())

    def handle_endtag(self, tag: str) -> None:
        if any(x[1] == tag for x in self.stack):
            while True:
                own = self.stack.pop()
                self._end(own)
                if own[1] == tag:
                    return

    def _end(self, own: tuple[int, str, int]) -> None:
        at = own[0]
        self.last[at], self.spans[at] = len(self.last) - 1, (self.spans[at][0], self.size)

    def handle_data(self, data: str) -> None:
        if self.stack and self.stack[-1][1] in ("script", "style"):
            return
        for word in data.split():
            self.words.append(word)
            self.size += len(word) + 1

    def value(self, at: int, what: str) -> str | None:
        """An element's text, or an attribute of it, white space collapsed; None if there is none."""
        if what == "text":
            begin, end = self.spans[at]
            return self.text[begin:end].rstrip(" ") or None
        held = self.values[at].get(what)
        return _SPACES.sub(" ", held).strip(" ") or None if held is not None else None

    def leaves(self, found: list[int]) -> list[int]:
        """The elements without elements inside that these are or hold, each once, in page order."""
        out, done = [], -1
        for at in found:
            out += [i for i in range(max(at, done + 1), self.last[at] + 1) if self.last[i] == i]
            done = max(done, self.last[at])
        return out

    def climbed(self, anchor: int) -> int:
        """The card around a link: of the elements above it the nearest whose text is short and has a number; else the one above."""
        up, at = self.parent[anchor], self.parent[anchor]
        for _ in range(CLIMB):
            if at < 0:
                break
            begin, end = self.spans[at]
            if end - begin <= LONGEST_CARD and _DIGIT.search(self.text, begin, end):
                return at
            at = self.parent[at]
        return up if up >= 0 else anchor


def _slices(texts: pa.Array) -> Iterator[list]:
    """A batch's values, a few pages at a time."""
    some, size = [], 0
    for x in texts:
        value = x.as_py()
        some.append(value)
        size += len(value) if isinstance(value, str) else sum(len(v or "") for v in value or ())
        if len(some) >= PAGES or size >= CHARACTERS:
            yield some
            some, size = [], 0
    if some:
        yield some


def of_pages(html: Column, kind: pa.DataType, schema: str, one: Callable[[object], object]) -> Column:
    """``one`` of each page (or list of texts). What it gives is put into Arrow's form after a few pages, so that a batch is never Python's objects as a whole."""

    @F.arrow_udf(returnType=schema)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            for some in _slices(texts):
                yield pa.array([one(x) for x in some], kind)

    # Filters on what comes out would read each page once more: what is said to vary is not copied into them.
    return run.asNondeterministic()(html)


def _run(pages: DataFrame, html: str, column: str, kind: pa.DataType, schema: str, one: Callable[[str], object]) -> DataFrame:
    return pages.withColumn(column, of_pages(F.col(html), kind, schema, lambda page: one(page or "")))


def find(pages: DataFrame, wanted: dict[str, tuple[str, dict[str, str]]], html: str = "html") -> DataFrame:
    """``pages`` with a column ``_found`` of a list a name: of the elements that its selector finds, ``node`` and the values that are asked for."""
    names = list(wanted)
    selectors = Selectors([wanted[n][0] for n in names])
    asked = [wanted[n][1] for n in names]

    def one(page: str) -> dict:
        walk = Walk(selectors, len(names), page)
        return {n: [{"node": at, **{c: walk.value(at, what) for c, what in a.items()}} for at in found] for n, a, found in zip(names, asked, walk.found, strict=True)}

    kind = pa.struct([(n, pa.list_(pa.struct([("node", pa.int32()), *((c, pa.string()) for c in a)]))) for n, a in zip(names, asked, strict=True)])
    schema = ",".join(f"`{n}`:array<struct<node:int{''.join(f',`{c}`:string' for c in a)}>>" for n, a in zip(names, asked, strict=True))
    return _run(pages, html, "_found", kind, f"struct<{schema}>", one)


@dataclass(frozen=True)
class Boxes:
    """What is read as one entry: the elements of ``selector``, or the page; those that hold an element of each of ``holds``' alternatives."""

    selector: str = ""
    holds: tuple[str, ...] = ()
    #: Boxes are climbed to from the elements whose ``href`` fits.
    climb: str = ""
    #: An anchor around the box is its link where no way gives one.
    link_above: bool = False
    #: Boxes are what this makes of the walk and of what it found of ``parts``, a list a selector.
    choose: Callable[[Walk, list[list[int]]], list[int]] | None = None
    parts: tuple[str, ...] = ()


@dataclass
class Request:
    """Fields of boxes: each one's first way's first value inside the box; of ``amounts`` the first that has a number; of ``lists`` all."""

    boxes: Boxes
    fields: dict[str, Ways]
    lists: dict[str, Ways] = field(default_factory=dict)
    amounts: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        every = {**self.fields, **self.lists}
        self.first = 3 + len(self.boxes.parts)
        self.asked = [self.boxes.selector, ", ".join(self.boxes.holds), "a[href]", *self.boxes.parts, *(s for ways in every.values() for s, _ in ways)]
        places = iter(range(self.first, len(self.asked)))
        self.ways = {name: [(next(places), what) for _, what in ways] for name, ways in every.items()}
        self.selectors = Selectors([x if x or i > 2 else "[-]" for i, x in enumerate(self.asked)])

    def read(self, page: str) -> list[dict]:
        walk = Walk(self.selectors, len(self.asked), page)
        held = {}
        for name, ways in self.ways.items():
            places = ((walk.leaves(walk.found[i]), "text") if what == "leaves" else (walk.found[i], what) for i, what in ways)
            each = [[(at, v) for at in found if (v := walk.value(at, what)) is not None] for found, what in places]
            held[name] = [([at for at, _ in x], [v for _, v in x]) for x in each]
        return [self._entry(walk, box, held) for box in self._boxes(walk)]

    def _boxes(self, walk: Walk) -> Iterator[int]:
        if self.boxes.choose:
            return iter(self.boxes.choose(walk, walk.found[3 : self.first]))
        if self.boxes.climb:
            fits = re.compile(self.boxes.climb)
            return iter(dict.fromkeys(walk.climbed(at) for at in walk.found[2] if fits.search(walk.value(at, "href") or "")))
        if not self.boxes.selector:
            return iter((-1,))
        inner = walk.found[1]
        return (at for at in walk.found[0] if not self.boxes.holds or bisect_left(inner, at) < bisect_right(inner, walk.last[at]))

    def _entry(self, walk: Walk, box: int, held: dict[str, list[tuple[list[int], list[str]]]]) -> dict:
        first, last = (box, walk.last[box]) if box >= 0 else (0, len(walk.last))
        out = {"card": max(box, 0), "card_classes": walk.values.get(box, {}).get("class", "").split(), "card_text": (walk.value(box, "text") if box >= 0 else walk.text.rstrip(" ")) or ""}
        for name, ways in held.items():
            inside = [values[bisect_left(places, first) : bisect_right(places, last)] for places, values in ways]
            if name in self.lists:
                out[name] = list(dict.fromkeys(v for x in inside for v in x))
            else:
                each = (x[0] for x in inside if x)
                out[name] = next((v for v in each if name not in self.amounts or _DIGIT.search(v)), None)
        if self.boxes.link_above and out.get("link") is None and box >= 0:
            around = [at for at in walk.found[2] if at < box and walk.last[at] >= walk.last[box]]
            out["link"] = walk.value(around[-1], "href") if around else None
        return out


def cards(pages: DataFrame, request: Request, *more: str, html: str = "html") -> DataFrame:
    """A row per box of each page: url, ``more`` columns of pages, ``card`` (its number), ``card_classes``, ``card_text`` and the fields."""
    columns = [("card", "int"), ("card_classes", "array<string>"), ("card_text", "string"), *((n, "array<string>" if n in request.lists else "string") for n in request.ways)]
    kinds = {"int": pa.int32(), "string": pa.string(), "array<string>": pa.list_(pa.string())}
    kind = pa.list_(pa.struct([(n, kinds[t]) for n, t in columns]))
    schema = "array<struct<" + ",".join(f"`{n}`:{t}" for n, t in columns) + ">>"
    return _run(pages, html, "_cards", kind, schema, request.read).select("url", *more, F.inline("_cards"))
