"""Main text of web pages by a recurrent block labeller.

A page becomes a sequence of leaf blocks: stretches of text between block-level tags, each with
the path of open tags. A block's vector holds hashed path tokens (tags, classes, ids, roles),
hashed words and a few plain measures. A bidirectional LSTM in numpy reads the whole sequence
both ways, so that every block is classified in the light of the document around it.

The labeller is trained on a bounded sample of pages. Its teacher is the markup itself: a block
is text if it lies in an article and in nothing that furnishes a page. To learn more than the
templates of one site, each sample page is also seen with furniture of other kinds put in and
with its containers renamed.

Pages are read whole, in batches of similar length; memory follows the longest page of a batch.

Defined results: null and empty pages have the text ``""``; a page without tags is one block;
unclosed and unopened tags are tolerated; scripts, styles, comments and the head never hold
text; as in browsers an svg also ends before a tag that has no place in it, and other raw
elements without an end tag reach to the end; an svg with no end at all is empty; repeated rows each come back; an empty table gives no rows.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

#: Fixed values of HTML.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body br button caption dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main menu nav ol option p pre search section select summary table "
    "tbody td textarea tfoot th thead title tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW_TAGS = "script|style|noscript|template|svg|iframe"
HEAD_TAGS = frozenset(("head", "title"))
#: Tags that a following one of the same kind, or of the second set, closes.
CLOSES = {"p": BLOCK_TAGS - {"br"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}

PATH_BINS, WORD_BINS, MEASURES = 256, 32, 5
WIDTH = PATH_BINS + WORD_BINS + MEASURES
HIDDEN = 12
#: Pages the labeller learns from, at most, and their longest html.
SAMPLE, SAMPLE_BYTES = 160, 100_000
EPOCHS, BATCH, RATE = 6, 16, 0.02
#: Pages read together.
TOGETHER = 64

#: Attributes up to the end of a tag; quotes count only after "=".
RAW_ATTRIBUTES = r"(?:[^>=]|=\s*(?:\"[^\"]*\"|'[^']*')?)*+"
MARKUP = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({RAW_TAGS})(?=[\s/>])({RAW_ATTRIBUTES})>|<[!?][^>]*>|<(/?)([a-zA-Z][\w:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][\w:-]*)[^>]*>",
    re.S | re.I,
)
RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I) for name in RAW_TAGS.split("|")}
#: Fixed values of HTML: parts of an svg that hold tags of a page; tags of a page that end an svg outside of them.
SVG_HOSTS = "foreignobject|desc|title"
SVG_STEP = re.compile(
    rf"(?P<end></svg(?=[\s/>])[^>]*>)|<(?P<shut>/?)(?:{SVG_HOSTS})(?=[\s/>])(?P<own>[^>]*)>|</p(?=[\s/>])"
    r"|<(?:blockquote|body|center|d[dlt]|div|em|h[1-6]|head|hr|img|li|menu|nobr|ol|p|pre|span|strong|table|ul)(?=[\s/>])",
    re.I,
)
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
TOKEN = re.compile(r"[a-z]+|[0-9]+")


# --- pages to blocks ----------------------------------------------------------------------


class Block:
    __slots__ = ("path", "text", "linked")

    def __init__(self, path: tuple[str, ...], text: str, linked: float) -> None:
        self.path, self.text, self.linked = path, text, linked


def blocks_of(page: str | None) -> list[Block]:
    """The leaf blocks of a page in order; white space is single, character references decoded."""
    out: list[Block] = []
    stack: list[tuple[str, str]] = []  # (tag, tokens of its path element)
    parts: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text and not any(tag in HEAD_TAGS for tag, _ in stack):
                out.append(Block(tuple(e for tag, e in stack if tag in BLOCK_TAGS or " " in e), text, min(1.0, linked / len(text))))
            parts.clear()
        linked = 0

    def say(piece: str) -> None:
        nonlocal linked
        if piece:
            parts.append(piece)
            if any(tag == "a" for tag, _ in stack[-4:]):
                linked += len(piece)

    end = 0
    page = page or ""
    unclosed: set[str] = set()  # raw tags that nothing ends from here on
    while m := MARKUP.search(page, end):
        say(page[end : m.start()])
        end = m.end()
        if m.group(1):
            raw = m.group(1).lower()
            if raw == "svg" and m.group(2).endswith("/"):
                continue
            after = None if raw in unclosed else raw_end(page, raw, end)
            if after is None:
                unclosed.add(raw)
                after = end if raw == "svg" else len(page)
            end = after
            continue
        name = (m.group(4) or m.group(7) or "").lower()
        if not name:
            continue
        if m.group(3) or m.group(6):
            if name in BLOCK_TAGS:
                flush()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    del stack[i:]
                    break
            continue
        if name in BLOCK_TAGS:
            flush()
            while stack and name in CLOSES.get(stack[-1][0], ()):
                stack.pop()
            # inline tags left open end with their block
            while stack and stack[-1][0] not in BLOCK_TAGS and any(tag in CLOSES and name in CLOSES[tag] for tag, _ in stack[-3:]):
                stack.pop()
                while stack and name in CLOSES.get(stack[-1][0], ()):
                    stack.pop()
        if name not in VOID_TAGS and not (m.group(5) or "").endswith("/"):
            tokens = [t for a in ATTRIBUTE.finditer(m.group(5) or "") for t in TOKEN.findall((a.group(2) or a.group(3) or a.group(4) or "").lower())]
            stack.append((name, " ".join([name, *tokens])))
    say(page[end:])
    flush()
    return out


def svg_end(page: str, at: int) -> int | None:
    """Where the svg ends whose content starts at ``at``; None if nothing ends it."""
    hosts = 0
    for m in SVG_STEP.finditer(page, at):
        if m["end"]:
            return m.end()
        if m["own"] is None:
            if not hosts:
                return m.start()
        elif m["shut"]:
            hosts = max(0, hosts - 1)
        elif not m["own"].endswith("/"):
            hosts += 1
    return None


def raw_end(page: str, name: str, at: int) -> int | None:
    if name == "svg":
        return svg_end(page, at)
    close = RAW_END[name].search(page, at)
    return close.end() if close else None


def vector(block: Block) -> np.ndarray:
    x = np.zeros(WIDTH, dtype=np.float32)
    for element in block.path:
        tag, *tokens = element.split()
        x[zlib.crc32(f"<{tag}".encode()) % PATH_BINS] = 1
        for t in tokens:
            x[zlib.crc32(t.encode()) % PATH_BINS] = 1
    words = block.text.split()
    for w in words:
        x[PATH_BINS + zlib.crc32(w.lower().encode()) % WORD_BINS] += 1
    own = x[PATH_BINS : PATH_BINS + WORD_BINS]
    own /= np.sqrt((own**2).sum()) or 1
    marks = sum(map(block.text.count, ".,;:!?"))
    x[-MEASURES:] = (np.log1p(len(words)) / 5, block.linked, min(1.0, marks / len(words)), float(block.text[-1] in ".!?"), float("©" in block.text))
    return x


# --- the labeller -------------------------------------------------------------------------


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Labeller:
    """Two LSTMs and a logistic output. Sequences of a batch are padded; padding carries no state."""

    def __init__(self) -> None:
        rng = np.random.default_rng(3)
        self.p = {}
        for side in "fb":
            self.p["x" + side] = rng.normal(0, 0.1, (WIDTH, 4 * HIDDEN))
            self.p["h" + side] = rng.normal(0, 0.1, (HIDDEN, 4 * HIDDEN))
            self.p["c" + side] = np.r_[np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)]
        self.p["out"] = rng.normal(0, 0.1, 2 * HIDDEN)
        self.p["bias"] = np.zeros(1)

    def _run(self, side: str, x: np.ndarray, mask: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
        pages, steps, _ = x.shape
        inputs = x @ self.p["x" + side] + self.p["c" + side]
        h, c = np.zeros((pages, HIDDEN)), np.zeros((pages, HIDDEN))
        out, tape = np.zeros((pages, steps, HIDDEN)), []
        for t in range(steps) if side == "f" else reversed(range(steps)):
            z = inputs[:, t] + h @ self.p["h" + side]
            i, f, o = np.split(_sigmoid(z[:, : 3 * HIDDEN]), 3, axis=1)
            g = np.tanh(z[:, 3 * HIDDEN :])
            m = mask[:, t, None]
            c_new = (f * c + i * g) * m
            squashed = np.tanh(c_new)
            h_new = o * squashed * m
            if keep:
                tape.append((t, h, c, i, f, o, g, squashed, m))
            h, c = h_new, c_new
            out[:, t] = h
        return out, tape

    def scores(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        both = np.concatenate([self._run(side, x, mask, False)[0] for side in "fb"], axis=2)
        return _sigmoid(both @ self.p["out"] + self.p["bias"][0])

    def gradients(self, x: np.ndarray, mask: np.ndarray, truth: np.ndarray) -> dict[str, np.ndarray]:
        runs = {side: self._run(side, x, mask, True) for side in "fb"}
        both = np.concatenate([runs[side][0] for side in "fb"], axis=2)
        error = (_sigmoid(both @ self.p["out"] + self.p["bias"][0]) - truth) * mask / mask.sum()
        grads = {"out": np.einsum("pt,pth->h", error, both), "bias": np.array([error.sum()])}
        for k, side in enumerate("fb"):
            back = error[..., None] * self.p["out"][k * HIDDEN : (k + 1) * HIDDEN]
            d_inputs = np.zeros((*x.shape[:2], 4 * HIDDEN))
            d_h, d_c = np.zeros(back.shape[::2]), np.zeros(back.shape[::2])
            grads["h" + side] = np.zeros_like(self.p["h" + side])
            for t, h, c, i, f, o, g, squashed, m in reversed(runs[side][1]):
                d_h = (d_h + back[:, t]) * m
                d_c = (d_c + d_h * o * (1 - squashed**2)) * m
                d_z = np.concatenate([d_c * g * i * (1 - i), d_c * c * f * (1 - f), d_h * squashed * o * (1 - o), d_c * i * (1 - g**2)], axis=1)
                d_inputs[:, t] = d_z
                grads["h" + side] += h.T @ d_z
                d_h, d_c = d_z @ self.p["h" + side].T, d_c * f
            grads["x" + side] = np.einsum("ptw,ptk->wk", x, d_inputs, optimize=True)
            grads["c" + side] = d_inputs.sum(axis=(0, 1))
        return grads

    def fit(self, pages: list[tuple[np.ndarray, np.ndarray]], epochs: int = EPOCHS) -> None:
        """Adam over batches of pages of similar length."""
        pages = sorted(pages, key=lambda p: len(p[1]))
        batches = [_padded(pages[i : i + BATCH]) for i in range(0, len(pages), BATCH)]
        mean, square, step = {k: 0.0 for k in self.p}, {k: 0.0 for k in self.p}, 0
        rng = np.random.default_rng(4)
        for _ in range(epochs):
            for b in rng.permutation(len(batches)):
                step += 1
                for k, g in self.gradients(*batches[b]).items():
                    mean[k] = 0.9 * mean[k] + 0.1 * g
                    square[k] = 0.99 * square[k] + 0.01 * g * g
                    self.p[k] = self.p[k] - RATE * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-8)


def _padded(pages: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    steps = max(len(y) for _, y in pages)
    x, truth, mask = np.zeros((len(pages), steps, WIDTH)), np.zeros((len(pages), steps)), np.zeros((len(pages), steps))
    for i, (vectors, labels) in enumerate(pages):
        x[i, : len(labels)], truth[i, : len(labels)], mask[i, : len(labels)] = vectors, labels, 1
    return x, mask, truth


# --- teaching -----------------------------------------------------------------------------

#: Tokens of page furniture and of containers of the main text.
FURNITURE = frozenset(
    "nav header footer aside menu form sidebar ad ads advert advertisement banner sponsored promo comment comments respond notice cookie "
    "consent newsletter subscribe related recommended social share breadcrumb breadcrumbs widget login search popup modal pagination".split()
)
CONTAINERS = ("article", "main", "article post", "article entry content", "main content", "div article body", "div main content", "div post content", "section article")
MAIN = frozenset("article main".split()) | {"post", "entry", "content", "body"}
#: (path, words) of furniture that is put into sample pages.
EXTRA = (
    ("header", 4), ("div header", 6), ("header h1", 3), ("aside", 20), ("div sidebar", 25), ("aside li", 3), ("section comments", 25), ("div comment", 30),
    ("div comments p", 20), ("ol comments li", 18), ("div cookie notice", 15), ("div notice", 10), ("form", 4), ("form search", 2), ("form label", 3), ("div ad", 9), ("div advert", 12),
    ("div banner", 6), ("div newsletter", 9), ("div related", 12), ("div breadcrumb", 4), ("nav li", 2), ("div menu", 3), ("footer p", 12), ("div footer", 14), ("ul social", 3),
)


def is_main(block: Block) -> bool:
    """The teacher: inside an article, outside all furniture."""
    tokens = [e.split() for e in block.path]
    return any(t[0] in ("article", "main") for t in tokens) and not any(FURNITURE.intersection(t) for t in tokens)


def _varied(blocks: list[Block], labels: list[bool], words: list[str], rng: np.random.Generator) -> tuple[list[Block], list[bool]]:
    """A page with another container for its main text and with more furniture around and inside it."""
    container = CONTAINERS[rng.integers(len(CONTAINERS))]
    out: list[tuple[Block, bool]] = []
    for b, y in zip(blocks, labels):
        path = tuple(container if e.split()[0] in ("article", "main") else e for e in b.path) if y else b.path
        out.append((Block(path, b.text, b.linked), y))
    for path, n in (EXTRA[i] for i in rng.choice(len(EXTRA), 6, replace=False)):
        inside = rng.random() < 0.3
        at = int(rng.integers(len(out) + 1))
        base = ("html", "body", container, path) if inside else ("html", "body", path)
        for _ in range(int(rng.integers(1, 4))):
            text = " ".join(words[i] for i in rng.integers(len(words), size=max(1, int(rng.poisson(n)))))
            out.insert(at, (Block((*base, "p") if rng.random() < 0.5 else base, text, float(rng.random() < 0.3)), False))
    return [b for b, _ in out], [y for _, y in out]


def train(pages: list[str]) -> Labeller:
    rng = np.random.default_rng(9)
    labeller, examples = Labeller(), []
    parsed = [b for b in map(blocks_of, pages) if b]
    words = [w for blocks in parsed for b in blocks for w in b.text.split()[:40]]
    for blocks in parsed:
        labels = [is_main(b) for b in blocks]
        for own, truth in ((blocks, labels), _varied(blocks, labels, words, rng)):
            examples.append((np.stack([vector(b) for b in own]), np.array(truth, dtype=float)))
    if examples:
        labeller.fit(examples)
    return labeller


def sample_of(pages: DataFrame, size: int = SAMPLE) -> list[str]:
    """At most ``size`` whole pages, those whose page_id has the smallest hash."""
    usable = pages.where((F.col("html") != "") & (F.octet_length("html") <= SAMPLE_BYTES))
    ids = usable.select("page_id").where("page_id is not null").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(size)
    rows = usable.join(F.broadcast(ids), "page_id").dropDuplicates(["page_id"]).select("page_id", "html").collect()
    return [r["html"] for r in sorted(rows, key=lambda r: r["page_id"])]


# --- extraction ---------------------------------------------------------------------------


def texts(labeller: Labeller, pages: list[str | None]) -> list[str]:
    """The main text of each page."""
    parsed = [blocks_of(p) for p in pages]
    out = [""] * len(pages)
    order = sorted((i for i, blocks in enumerate(parsed) if blocks), key=lambda i: len(parsed[i]))
    start = 0
    while start < len(order):
        longest, end = 0, start
        while end < len(order) and end - start < TOGETHER:
            longest = len(parsed[order[end]])
            end += 1
            if longest * (end - start) > 20_000:
                break
        chunk = order[start:end]
        start = end
        x, mask, _ = _padded([(np.stack([vector(b) for b in parsed[i]]), np.zeros(len(parsed[i]))) for i in chunk])
        for i, scores in zip(chunk, labeller.scores(x, mask)):
            out[i] = " ".join(b.text for b, s in zip(parsed[i], scores) if s >= 0.5)
    return out


def main_text(labeller: Labeller, html: Column) -> Column:
    @F.pandas_udf("string")
    def extract(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages in batches:
            found: list[str] = []
            for i in range(0, len(pages), 512):
                found += texts(labeller, pages.iloc[i : i + 512].tolist())
            yield pd.Series(found, dtype="object")

    return extract(html)


def extract(pages: DataFrame) -> DataFrame:
    """``pages`` plus ``text``, by a labeller trained on a sample of them."""
    return pages.withColumn("text", main_text(train(sample_of(pages)), F.col("html")))
