"""The main text of web pages by a recurrent block labeller.

A page is read as a sequence of leaf blocks of text with their tag paths. Each block is a
vector of its hashed tag path (tags, classes and ids), its hashed words and a few counts; a
bidirectional LSTM in numpy reads the sequence and says of every block, with the whole page
as context, whether it belongs to the article. It is trained on the driver on ``TRAIN_PAGES``
invented pages; its weights (some 100 kB at any size of input) go to the tasks.

Defined results: a null or empty page, or one without article, has an empty text; very long
pages are read whole, in chunks of bounded size, each direction of the network going on from the
state that it had at the end of the chunk before, so that every block sees all of its page; a block at the limit of both classes is
kept out; repeated rows, null or equal ids are extracted each; an empty table gives no rows;
other columns, whatever their names, are ignored. Scripts, styles, comments, drawings, frames,
templates and the contents of form fields are no text; formulas and what objects and pages
without scripts show are. White space inside a block becomes one space; blocks are joined by an
empty line.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .html_pages import labelled_page
from .support import arrow_map, texts

#: Pages that the labeller is trained on, its passes over them, and its size.
TRAIN_PAGES, EPOCHS, HIDDEN = 5000, 10, 24
PATH, WORDS, COUNTS = 256, 128, 9
INPUT = PATH + WORDS + COUNTS
#: Training pages that have to have a name for it to be known.
KNOWN_NAME = 8
#: Cells of a padded batch of blocks, and blocks of a chunk of a longer page; bounds a task's memory.
BATCH_BLOCKS = 12_000

#: Quotes hold a value after an equals sign only; one that nothing closes, or that stands elsewhere, is a character as any other.
TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(script|style)\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:=\s*"[^"]*"|=\s*'[^']*'|[^<>])*+)>|<[!?][^>]*>""",
    re.DOTALL | re.IGNORECASE,
)
#: Elements without text of their own, up to the closing tag; one that nobody closes, or that closes itself, is passed over alone.
SKIPPED = {x: re.compile(rf"</{x}\s*>", re.IGNORECASE) for x in ("svg", "iframe", "textarea", "select", "template")}
NAME = re.compile(r"""\b(class|id)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
PART = re.compile(r"[a-z]+|[A-Z][a-z]*")
BLOCKS = frozenset("html head title body p div h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption section article main header footer nav aside form fieldset legend label button option noscript blockquote pre figure figcaption address details summary hr center".split())
VOID = frozenset("hr br img input meta link area base col embed source track wbr".split())
#: What an opening tag closes, if it is open inside the nearest of the tags in the second set.
CLOSES = {"li": ({"li", "p"}, {"ul", "ol"}), "dt": ({"dt", "dd", "p"}, {"dl"}), "dd": ({"dt", "dd", "p"}, {"dl"}), "tr": ({"tr", "td", "th", "p"}, {"table"}), "td": ({"td", "th", "p"}, {"tr", "table"}), "th": ({"td", "th", "p"}, {"tr", "table"}), "option": ({"option"}, {"form"}), "body": ({"head", "title"}, {"html"})}
STOPS = frozenset({"td", "th", "li", "div", "section", "article", "main", "body", "aside", "nav", "form", "blockquote"})


class Block:
    __slots__ = ("path", "text", "linked")

    def __init__(self, path: tuple[str, ...], text: str, linked: int) -> None:
        self.path, self.text, self.linked = path, text, linked


def _names(attributes: str) -> str:
    """The parts of classes and ids, in lower case."""
    return " ".join(p.lower() for m in NAME.finditer(attributes) for p in PART.findall(m[2] or m[3] or m[4] or ""))


def blocks(page: str) -> list[Block]:
    """Leaf blocks in page order; faults of nesting are mended as browsers do for paragraphs, items and cells."""
    out: list[Block] = []
    stack: list[tuple[str, str]] = []
    held: list[str] = []
    linked = at = 0
    in_link = False
    unclosed: set[str] = set()

    def flush() -> None:
        nonlocal linked, in_link
        if held:
            if text := " ".join(entities.unescape("".join(held)).split()):
                out.append(Block(tuple(f"{t} {n}" for t, n in stack), text, min(linked, len(text))))
            held.clear()
        linked, in_link = 0, False

    def add(text: str) -> None:
        nonlocal linked
        held.append(text)
        if in_link:
            linked += len(text)

    for m in TOKEN.finditer(page):
        if m.start() < at:  # inside of what was passed over
            continue
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        tag = (m[3] or "").lower()
        if not tag:
            continue
        if tag in SKIPPED and not m[2] and tag not in unclosed and not m[0].endswith("/>"):
            if close := SKIPPED[tag].search(page, at):
                at = close.end()
            else:
                unclosed.add(tag)
            continue
        if tag not in BLOCKS:
            if tag == "br":
                add(" ")
            elif tag == "a":
                in_link = not m[2]
            continue
        flush()
        if m[2]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
            continue
        closed, inside = CLOSES.get(tag, ({"p"}, STOPS))
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in inside:
                break
            if stack[i][0] in closed:
                del stack[i:]
        if tag not in VOID:
            stack.append((tag, _names(m[4]) if m[4] else ""))
    if at < len(page):
        add(page[at:])
    flush()
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """A bidirectional LSTM with one logistic output a block; ``names`` are the parts of classes and ids that it knows."""

    def __init__(self, names: frozenset[str] = frozenset(), seed: int = 7, hidden: int = HIDDEN) -> None:
        rng = np.random.default_rng(seed)
        self.h, self.names, self.paths = hidden, names, {}
        self.p = {}
        for d in "fb":
            self.p[f"W{d}"] = (rng.normal(size=(INPUT, 4 * hidden)) / 8).astype(np.float32)
            self.p[f"U{d}"] = (rng.normal(size=(hidden, 4 * hidden)) / np.sqrt(hidden)).astype(np.float32)
            self.p[f"c{d}"] = np.repeat(np.array([0, 1, 0, 0], np.float32), hidden)
        self.p["V"] = (rng.normal(size=2 * hidden) / 4).astype(np.float32)
        self.p["v"] = np.zeros(1, np.float32)

    def _path(self, path: tuple[str, ...]) -> np.ndarray:
        """Two hashes of each tag, each known part of a class or id, and of the leaf's own tag."""
        found = self.paths.get(path)
        if found is None:
            if len(self.paths) > 20_000:
                self.paths.clear()
            found = self.paths[path] = np.zeros(PATH, np.float32)
            tokens = {t for step in path for t in ["t:" + step.split(" ")[0], *("n:" + x for x in step.split(" ")[1:] if x in self.names)]}
            if path:
                tokens.add("leaf:" + path[-1].split(" ")[0])
            for t in tokens:
                h = zlib.crc32(t.encode("utf-8", "surrogatepass"))
                found[h % PATH] += 1
                found[(h >> 12) % PATH] += 1
        return found

    def vectors(self, page: list[Block], begin: int = 0, total: int | None = None) -> np.ndarray:
        """A row per block; ``begin`` and ``total`` say where in a longer page these blocks are."""
        total = total or len(page)
        out = np.zeros((len(page), INPUT), np.float32)
        crc = zlib.crc32
        for i, b in enumerate(page):
            out[i, :PATH] = self._path(b.path)
            hashed = [crc(w.lower().encode("utf-8", "surrogatepass")) & (WORDS - 1) for w in b.text.split(" ")]
            n, size = len(hashed), len(b.text)
            out[i, PATH : PATH + WORDS] = np.bincount(hashed, minlength=WORDS) / n
            digits = sum(map(b.text.count, "0123456789"))
            out[i, PATH + WORDS :] = (np.log1p(n) / 5, b.linked / size, b.text.count(".") / n, (begin + i) / total, 1.0, n < 4, b.text[-1] in ".!?", "©" in b.text or "opyright" in b.text, digits / size)
        return out

    def _run(self, d: str, x: np.ndarray, mask: np.ndarray, state: tuple[np.ndarray, np.ndarray] | None = None, keep: bool = True) -> tuple[np.ndarray, list, tuple[np.ndarray, np.ndarray]]:
        """States of one direction, and the last one; x is (time, page, input), already in that direction's order. ``state`` is where it begins."""
        h, c = state or (np.zeros((x.shape[1], self.h), np.float32),) * 2
        drive = x @ self.p[f"W{d}"] + self.p[f"c{d}"]
        out, kept = np.empty((*x.shape[:2], self.h), np.float32), []
        for t in range(len(x)):
            z = drive[t] + h @ self.p[f"U{d}"]
            i, f, o = (_sigmoid(z[:, k * self.h : (k + 1) * self.h]) for k in range(3))
            g, m = np.tanh(z[:, 3 * self.h :]), mask[t][:, None]
            before = (h, c)
            c = m * (f * c + i * g) + (1 - m) * c
            tc = np.tanh(c)
            h = m * (o * tc) + (1 - m) * h
            out[t] = h
            if keep:
                kept.append((i, f, o, g, tc, m, *before))
        return out, kept, (h, c)

    def logits(self, x: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, tuple]:
        forward, kf, _ = self._run("f", x, mask)
        backward, kb, _ = self._run("b", x[::-1], mask[::-1])
        both = np.concatenate([forward, backward[::-1]], axis=2)
        return both @ self.p["V"] + self.p["v"], (both, kf, kb)

    def logits_of_long(self, page: list[Block], chunk: int) -> np.ndarray:
        """``logits`` of one page of any length: each direction goes on from one chunk's last state to the next chunk, so no block sees less."""
        n = len(page)
        out = np.full(n, self.p["v"][0], np.float32)
        for d, weights, starts in (("f", self.p["V"][: self.h], range(0, n, chunk)), ("b", self.p["V"][self.h :], reversed(range(0, n, chunk)))):
            state = None
            for start in starts:
                x = self.vectors(page[start : start + chunk], start, n)[:, None, :]
                turn = slice(None, None, 1 if d == "f" else -1)
                states, _, state = self._run(d, x[turn], np.ones((len(x), 1), np.float32), state, False)
                out[start : start + len(x)] += (states[:, 0] @ weights)[turn]
        return out

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        z, (both, kf, kb) = self.logits(x, mask)
        d = (_sigmoid(z) - y) * mask / mask.sum()
        grad = {"V": np.einsum("tb,tbh->h", d, both), "v": np.array([d.sum()], np.float32)}
        dboth = d[:, :, None] * self.p["V"]
        for name, xs, kept, dh_out in (("f", x, kf, dboth[:, :, : self.h]), ("b", x[::-1], kb, dboth[::-1, :, self.h :])):
            u = self.p[f"U{name}"]
            dz, du = np.empty((*x.shape[:2], 4 * self.h), np.float32), np.zeros_like(u)
            dh = dc = np.zeros((x.shape[1], self.h), np.float32)
            for t in range(len(xs) - 1, -1, -1):
                i, f, o, g, tc, m, h0, c0 = kept[t]
                dh = dh + dh_out[t]
                live = dh * m
                dct = dc * m + live * o * (1 - tc * tc)
                dz[t] = np.concatenate([dct * g * i * (1 - i), dct * c0 * f * (1 - f), live * tc * o * (1 - o), dct * i * (1 - g * g)], axis=1)
                du += h0.T @ dz[t]
                dh = dz[t] @ u.T + dh * (1 - m)
                dc = dct * f + dc * (1 - m)
            grad |= {f"W{name}": np.einsum("tbi,tbh->ih", xs, dz, optimize=True), f"U{name}": du, f"c{name}": dz.sum(axis=(0, 1))}
        return grad

    def train(self, pages: list[tuple[np.ndarray, np.ndarray]], epochs: int, seed: int = 1, batch: int = 20) -> None:
        """Adam over batches of pages."""
        rng, step = np.random.default_rng(seed), 0
        first, second = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        for epoch in range(epochs):
            order = rng.permutation(len(pages))
            for start in range(0, len(order), batch):
                x, mask, y = padded([pages[i] for i in order[start : start + batch]])
                step += 1
                for k, g in self.gradients(x, mask, y).items():
                    g = np.clip(g, -1, 1)
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    rate = 0.02 * (1 - epoch / epochs) + 0.001
                    self.p[k] = (self.p[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)


def padded(pages: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(time, page, input), the mask and the labels."""
    most = max(len(x) for x, _ in pages)
    x, mask, y = np.zeros((most, len(pages), INPUT), np.float32), np.zeros((most, len(pages)), np.float32), np.zeros((most, len(pages)), np.float32)
    for i, (v, labels) in enumerate(pages):
        x[: len(v), i], mask[: len(v), i], y[: len(v), i] = v, 1, labels
    return x, mask, y


def _names_in(page: list[Block]) -> set[str]:
    return {x for b in page for step in b.path for x in step.split(" ")[1:]}


@cache
def trained(pages: int = TRAIN_PAGES, epochs: int = EPOCHS) -> Labeller:
    """Trained on the driver. Names that few training pages have are not known: what a machine makes says nothing."""
    data = [(found, labels) for page, labels in map(labelled_page, range(pages)) if len(found := blocks(page)) == len(labels)]
    often = Counter(x for found, _ in data for x in _names_in(found))
    labeller = Labeller(frozenset(x for x, n in often.items() if n >= KNOWN_NAME))
    labeller.train([(labeller.vectors(found), np.array(labels, np.float32)) for found, labels in data], epochs)
    return labeller


def label_pages(labeller: Labeller, pages: list[list[Block]]) -> list[np.ndarray]:
    """Whether each block of each page is the article's; pages of like lengths share a batch, a page of more blocks than a batch goes by itself."""
    out = [np.zeros(len(p), bool) for p in pages]
    order = sorted((i for i, p in enumerate(pages) if p), key=lambda i: len(pages[i]))
    start = 0
    while start < len(order):
        if len(pages[order[start]]) > BATCH_BLOCKS:
            out[order[start]] = labeller.logits_of_long(pages[order[start]], BATCH_BLOCKS) > 0
            start += 1
            continue
        end = start + 1
        while end < len(order) and len(pages[order[end]]) * (end + 1 - start) <= BATCH_BLOCKS:
            end += 1
        own = order[start:end]
        x, mask, _ = padded([(labeller.vectors(pages[i]), np.zeros(len(pages[i]))) for i in own])
        z, _ = labeller.logits(x, mask)
        for k, i in enumerate(own):
            out[i] = z[: len(pages[i]), k] > 0
        start = end
    return out


EXTRACTED = "page_id bigint, url string, text string, n_chars bigint, n_blocks bigint, n_kept bigint"


def extract(pages: DataFrame, labeller: Labeller | None = None) -> DataFrame:
    """Per row of ``pages`` (page_id, url, html): its main text."""
    model = labeller or trained()

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        found = texts(batch, "html")
        for start in range(0, len(found), 500):
            part = [blocks(x) for x in found[start : start + 500]]
            labels = label_pages(model, part)
            out = ["\n\n".join(b.text for b, k in zip(page, keep, strict=True) if k) for page, keep in zip(part, labels, strict=True)]
            columns = [batch.column(x).slice(start, len(part)) for x in ("page_id", "url")]
            columns += [pa.array(out, pa.string()), *(pa.array(x, pa.int64()) for x in ([len(t) for t in out], [len(p) for p in part], [int(k.sum()) for k in labels]))]
            yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in EXTRACTED.split(", ")])

    return arrow_map(pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", "html"), run, EXTRACTED)
