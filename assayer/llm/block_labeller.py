"""HTML extraction with a recurrent block labeller.

A page becomes the sequence of its leaf blocks: runs of text between block-level tags, with the tags,
classes and ids above them. A bidirectional LSTM (numpy) reads hashed tag-path and word vectors and
a few figures of every block and labels it with the whole page as context. The main text is the
blocks it keeps, in page order.

The model is fitted here, on a bounded sample of pages (``train_pages``, in md5 order of the html),
with labels from their own markup (inside article or main, outside asides, forms, comments and the
like) and on rearrangements of these pages that carry other tags, classes, notices, sidebars and
comments. The fitted weights have a fixed size and are broadcast; pages are not shuffled.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import batch_rows

TRAIN_PAGES, VARIANTS, EPOCHS = 200, 4, 10
HIDDEN, PATH_SLOTS, WORD_SLOTS, FIGURES = 24, 256, 32, 12
BATCH_BLOCKS = 4096

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"<]*+"|'[^'<]*+'|["'])*+)(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
NAME = re.compile(r"[a-z]+")
WORD = re.compile(r"\w+")
# Fixed by HTML: elements without content, raw or unshown content, inline elements, and what closes an open p.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSHOWN = frozenset("script style template iframe textarea select title".split())
RAW = frozenset("script style textarea title iframe".split())
# Formulas, drawings, controls and what stands in for media flow with the text around them.
FLOWING = frozenset("""math mi mn mo ms mtext mrow mfrac msqrt mroot msub msup msubsup munder mover munderover mtable mtr mtd mspace mstyle semantics annotation
svg g text tspan path rect circle line polygon polyline ellipse defs use symbol object button audio video canvas noscript""".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split()) | FLOWING
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())

#: Names of containers for training: the article's own, and what is not part of an article.
MAIN_NAMES = ("article", "main", "content", "main-content", "post", "post-content", "entry", "entry-content", "story", "story-body", "article-body", "article-text", "text", "body-text", "page-content", "blog-post")
OTHER_NAMES = ("nav", "menu", "navbar", "navigation", "breadcrumb", "header", "site-header", "masthead", "topbar", "footer", "site-footer", "copyright", "legal", "aside", "sidebar", "side", "widget", "related", "recommended",
               "more-stories", "ad", "ads", "advert", "advertisement", "banner", "sponsored", "promo", "cookie", "cookie-notice", "consent", "notice", "alert", "popup", "modal", "newsletter", "subscribe", "signup", "login",
               "search", "form", "comments", "comment", "comment-list", "reader-comments", "respond", "reply", "discussion", "share", "social", "tags", "pagination", "pager", "toolbar", "meta", "byline-links")
OTHER_TAGS = ("nav", "header", "footer", "aside", "form")


class Branch:
    """An open element below another: blocks share their way up."""

    __slots__ = ("above", "here")

    def __init__(self, above: Branch | None, here: tuple[str, tuple[str, ...]]):
        self.above, self.here = above, here


class Piece:
    """A leaf block: its text, the characters of it inside links, and (tag, names) of all its ancestors.

    ``slots``: the hashed path, where the parser has kept it up; else it follows from the path.
    """

    __slots__ = ("_path", "links", "slots", "text")

    def __init__(self, text: str, links: int, path: tuple | Branch | None, slots: np.ndarray | None = None):
        self.text, self.links, self._path, self.slots = text, links, path, slots

    @property
    def path(self) -> tuple:
        if isinstance(self._path, tuple):
            return self._path
        out, at = [], self._path
        while at is not None:
            out.append(at.here)
            at = at.above
        return tuple(reversed(out))

    @property
    def branch(self) -> Branch | None:
        if not isinstance(self._path, tuple):
            return self._path
        at = None
        for here in self._path:
            at = Branch(at, here)
        return at

    @property
    def last(self) -> str | None:
        """The tag right above the block."""
        return (self._path[-1][0] if self._path else None) if isinstance(self._path, tuple) else self._path and self._path.here[0]


class OpenPath:
    """The elements open at a place of a page, and the hashed set of their tags and names."""

    def __init__(self):
        self.stack: list[Branch] = []
        self.open: dict[str, int] = {}  # tokens of open elements
        self.known: dict[str, tuple[int, float]] = {}
        self.slots = np.zeros(PATH_SLOTS, np.float32)

    def enter(self, tag: str, names: tuple[str, ...]) -> None:
        self.stack.append(Branch(self.stack[-1] if self.stack else None, (tag, names)))
        for token in (tag, *names):
            n = self.open.get(token, 0)
            self.open[token] = n + 1
            if not n:
                if token not in self.known:
                    self.known[token] = slot(token, PATH_SLOTS)
                i, sign = self.known[token]
                self.slots[i] += sign

    def leave(self) -> str:
        tag, names = self.stack.pop().here
        for token in (tag, *names):
            self.open[token] -= 1
            if not self.open[token]:
                i, sign = self.known[token]
                self.slots[i] -= sign
        return tag


def names_of(attributes: str) -> tuple[str, ...]:
    found = ()
    for m in ATTRIBUTE.finditer(attributes):
        found += tuple(NAME.findall((m[1] or m[2] or m[3] or "").lower()))
    return found


def blocks_of(page: str | None) -> list[Piece]:
    """Leaf blocks in page order; white space inside one is one space, references are decoded."""
    page = page or ""
    above, open_, found, parts, links, place = OpenPath(), {}, [], [], 0, None
    at, end, hidden = 0, len(page), 0

    def flush():
        nonlocal parts, links, place
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                found.append(Piece(text, links, *place))
            parts, links, place = [], 0, None

    def words(piece: str):
        nonlocal links, place
        if hidden or not piece:
            return
        piece = entities.unescape(piece)
        parts.append(piece)
        if place is None and not piece.isspace():
            place = above.stack[-1] if above.stack else None, above.slots.copy()
        if open_.get("a"):
            links += len(piece.strip())

    def leave(tag: str):
        nonlocal hidden
        while above.stack:
            name = above.leave()
            open_[name] -= 1
            hidden -= name in UNSHOWN
            if name == tag:
                return

    while at < end:
        m = TAG.search(page, at)
        if m is None:
            words(page[at:])
            break
        words(page[at:m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if tag not in INLINE and tag not in UNSHOWN:
            flush()
        if m[1]:
            if open_.get(tag):
                leave(tag)
            continue
        if tag in VOID:
            continue
        if tag in CLOSES_P and open_.get("p"):
            leave("p")
        if tag in ("li", "tr", "td", "th", "option", "dt", "dd") and above.stack and above.stack[-1].here[0] == tag:
            leave(tag)
        if m[3].endswith("/") and tag in UNSHOWN:
            continue
        if tag in RAW:
            close = re.compile(f"</{tag}", re.I).search(page, at)
            at = end if close is None else close.start()
        above.enter(tag, names_of(m[3]))
        open_[tag] = open_.get(tag, 0) + 1
        hidden += tag in UNSHOWN
    flush()
    return found


def slot(token: str, slots: int) -> tuple[int, float]:
    h = zlib.crc32(token.encode("utf-8", "surrogatepass"))
    return h % slots, 1.0 if h >> 31 else -1.0


def features(pieces: list[Piece]) -> np.ndarray:
    """One row per block: hashed path, hashed words, figures."""
    n = len(pieces)
    out = np.zeros((n, PATH_SLOTS + WORD_SLOTS + FIGURES), np.float32)
    known: dict[str, tuple[int, float]] = {}
    vectors: dict[str, tuple[int, float]] = {}
    for k, piece in enumerate(pieces):
        row, text = out[k], piece.text
        tokens = {w for tag, names in piece.path for w in (tag, *names)} if piece.slots is None else set()
        if piece.slots is not None:
            row[:PATH_SLOTS] = piece.slots
        if piece.last:
            tokens.add("last:" + piece.last)
        for token in tokens:
            if token not in known:
                known[token] = slot(token, PATH_SLOTS)
            i, sign = known[token]
            row[i] += sign
        words = WORD.findall(text)
        weight = 1 / (1 + len(words)) ** 0.5
        for word in words:
            if word not in vectors:
                vectors[word] = slot("word:" + word.lower(), WORD_SLOTS)
            i, sign = vectors[word]
            row[PATH_SLOTS + i] += sign * weight
        chars = len(text)
        last = text[-1]
        row[PATH_SLOTS + WORD_SLOTS:] = (np.log1p(chars) / 5, np.log1p(len(words)) / 4, piece.links / chars, last in ".!?…\"”", last in ":|»>", text[0].isupper(), chars / (1 + len(words)) / 10,
                                         sum(map(text.count, ",;.")) / (1 + len(words)), k / n, 1 / (1 + k), 1 / (n - k), "©" in text or "|" in text)
    return out


class Labeller:
    """A bidirectional LSTM with one output per block; weights in a dict of arrays."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = weights

    @classmethod
    def fresh(cls, inputs: int, hidden: int, seed: int = 7) -> Labeller:
        rng = np.random.default_rng(seed)
        w = {}
        for d in "fb":
            w["x" + d] = rng.normal(0, 0.5 / inputs**0.5, (inputs, 4 * hidden)).astype(np.float32)
            w["h" + d] = rng.normal(0, 1 / hidden**0.5, (hidden, 4 * hidden)).astype(np.float32)
            w["c" + d] = np.concatenate((np.zeros(hidden), np.ones(hidden), np.zeros(2 * hidden))).astype(np.float32)  # an open forget gate
        w["o"], w["p"] = rng.normal(0, 1 / hidden**0.5, 2 * hidden).astype(np.float32), np.zeros(1, np.float32)
        return cls(w)

    def _direction(self, x: np.ndarray, mask: np.ndarray, d: str) -> dict:
        """x: steps, pages, inputs, already reversed for the backward direction."""
        steps, pages, _ = x.shape
        hidden = self.w["h" + d].shape[0]
        gates_in = x @ self.w["x" + d] + self.w["c" + d]
        h, c = np.zeros((pages, hidden), np.float32), np.zeros((pages, hidden), np.float32)
        hs, cs, gates = (np.zeros((steps, pages, k), np.float32) for k in (hidden, hidden, 4 * hidden))
        for t in range(steps):
            z = gates_in[t] + h @ self.w["h" + d]
            g = 1 / (1 + np.exp(-z[:, :3 * hidden]))  # input, forget, output
            u = np.tanh(z[:, 3 * hidden:])
            c = (g[:, hidden:2 * hidden] * c + g[:, :hidden] * u) * mask[t][:, None]
            h = g[:, 2 * hidden:] * np.tanh(c) * mask[t][:, None]
            hs[t], cs[t], gates[t, :, :3 * hidden], gates[t, :, 3 * hidden:] = h, c, g, u
        return {"x": x, "h": hs, "c": cs, "g": gates}

    @staticmethod
    def _turned(x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Every page's steps in reverse, padding left at the end."""
        steps = np.arange(x.shape[0])[:, None]
        at = np.where(steps < sizes, sizes - 1 - steps, steps)
        return np.take_along_axis(x, at.reshape(*at.shape, *[1] * (x.ndim - 2)), axis=0)

    def run(self, x: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, dict]:
        """Probability of every block (steps by pages) and what training needs."""
        mask = (np.arange(x.shape[0])[:, None] < sizes).astype(np.float32)
        f, b = self._direction(x, mask, "f"), self._direction(self._turned(x, sizes), mask, "b")
        both = np.concatenate((f["h"], self._turned(b["h"], sizes)), axis=2)
        return 1 / (1 + np.exp(-(both @ self.w["o"] + self.w["p"]))), {"f": f, "b": b, "both": both, "mask": mask}

    def _back(self, kept: dict, d: str, dh_all: np.ndarray, mask: np.ndarray, grads: dict) -> None:
        steps, pages, hidden = kept["h"].shape
        dz_all = np.zeros((steps, pages, 4 * hidden), np.float32)
        dh, dc = np.zeros((pages, hidden), np.float32), np.zeros((pages, hidden), np.float32)
        zero = np.zeros((pages, hidden), np.float32)
        for t in range(steps - 1, -1, -1):
            g, c, m = kept["g"][t], kept["c"][t], mask[t][:, None]
            i, f, o, u = (g[:, k * hidden:(k + 1) * hidden] for k in range(4))
            before = kept["c"][t - 1] if t else zero
            dh = (dh + dh_all[t]) * m
            th = np.tanh(c)
            dc = (dc + dh * o * (1 - th * th)) * m
            dz = dz_all[t]
            dz[:, :hidden], dz[:, hidden:2 * hidden] = dc * u * i * (1 - i), dc * before * f * (1 - f)
            dz[:, 2 * hidden:3 * hidden], dz[:, 3 * hidden:] = dh * th * o * (1 - o), dc * i * (1 - u * u)
            dh, dc = dz @ self.w["h" + d].T, dc * f
        flat = dz_all.reshape(-1, 4 * hidden)
        grads["x" + d] = kept["x"].reshape(-1, kept["x"].shape[2]).T @ flat
        grads["h" + d] = kept["h"][:-1].reshape(-1, hidden).T @ dz_all[1:].reshape(-1, 4 * hidden) if steps > 1 else np.zeros_like(self.w["h" + d])
        grads["c" + d] = flat.sum(axis=0)

    def gradients(self, x: np.ndarray, sizes: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        p, kept = self.run(x, sizes)
        mask, total = kept["mask"], float(kept["mask"].sum())
        loss = -float((mask * (y * np.log(p + 1e-7) + (1 - y) * np.log(1 - p + 1e-7))).sum()) / total
        d = ((p - y) * mask / total).astype(np.float32)
        hidden = self.w["hf"].shape[0]
        grads = {"o": np.einsum("tp,tph->h", d, kept["both"]), "p": np.array([d.sum()], np.float32)}
        back = d[..., None] * self.w["o"]
        self._back(kept["f"], "f", back[..., :hidden], mask, grads)
        self._back(kept["b"], "b", self._turned(back[..., hidden:], sizes), mask, grads)
        return loss, grads

    def label(self, pages: list[list[Piece]]) -> list[np.ndarray]:
        """Per page which blocks are main text; pages of like length run together."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = sorted((k for k in range(len(pages)) if pages[k]), key=lambda k: len(pages[k]))
        while order:
            steps = len(pages[order[-1]])
            take = order[-max(1, BATCH_BLOCKS // steps):]
            del order[-len(take):]
            x, sizes = padded([features(pages[k]) for k in take])
            p, _ = self.run(x, sizes)
            for j, k in enumerate(take):
                out[k] = p[:sizes[j], j] > 0.5
        return out


def padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(r) for r in rows])
    x = np.zeros((int(sizes.max()), len(rows), rows[0].shape[1]), np.float32)
    for j, r in enumerate(rows):
        x[:len(r), j] = r
    return x, sizes


def marked(pieces: list[Piece]) -> list[int] | None:
    """Labels from the page's own markup, None where it names no article."""
    other = {n for name in OTHER_NAMES for n in NAME.findall(name)} - {"meta", "form", "header"}
    known: dict[Branch | None, bool] = {None: False}

    def inside(at: Branch | None) -> bool:
        """Below an article, and below nothing foreign since; elements above are looked at once."""
        way = []
        while at not in known:
            way.append(at)
            at = at.above
        now = known[at]
        for branch in reversed(way):
            tag, names = branch.here
            now = tag in ("article", "main") or now and tag not in ("nav", "footer", "aside", "form", "button") and not other.intersection(names)
            known[branch] = now
        return now

    out = [int(inside(piece.branch)) for piece in pieces]
    return out if any(out) else None


def rearranged(main: list[Piece], other: list[Piece], foreign: list[str], rng: np.random.Generator) -> tuple[list[Piece], list[int]]:
    """A page with this article under other markup, among parts that are not its own."""
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    base = (("html", ()), ("body", ()))
    wrap = tuple(("div", tuple(NAME.findall(pick(("page", "wrapper", "container", "site", "row", ""))))) for _ in range(int(rng.integers(0, 3))))

    def container(names, tags) -> tuple:
        name = pick(names)
        tag = name if name in tags and rng.random() < 0.6 else pick(("div", "div", "section", "ul" if names is OTHER_NAMES else "div"))
        return (tag, () if tag == name else tuple(NAME.findall(name)))

    def part(above: tuple) -> list[tuple[Piece, int]]:
        box = above + (container(OTHER_NAMES, OTHER_TAGS),)
        style, out = rng.random(), []
        for _ in range(int(rng.integers(1, 7))):
            if style < 0.5:  # short items, often links
                text = " ".join(pick(foreign).split()[:int(rng.integers(1, 5))]) or "x"
                out.append((Piece(text, len(text) if rng.random() < 0.8 else 0, box + ((("button", ()),) if rng.random() < 0.15 else (("ul", ()), ("li", ())))), 0))
            else:  # sentences, as in notices and comments
                text = pick(foreign) if rng.random() < 0.6 else pick(other).text
                out.append((Piece(text, 0, box + (((pick(("p", "p", "div", "span")), ()),) if rng.random() < 0.8 else ())), 0))
        return out

    page: list[tuple[Piece, int]] = []
    for _ in range(int(rng.integers(1, 4))):
        page += part(base + (wrap if rng.random() < 0.5 else ()))
    kind = rng.random()
    shell = base + wrap + ((container(MAIN_NAMES, ("article", "main")),) if kind < 0.9 else ())
    if kind < 0.3:
        shell += (container(MAIN_NAMES, ("article",)),)
    cut = int(rng.integers(0, len(main) + 1)) if rng.random() < 0.4 else -1
    for k, piece in enumerate(main):
        if k == cut:
            page += part(shell)
        tag = piece.last or "p"
        tag = tag if tag in ("h1", "h2", "h3", "p", "li", "blockquote", "pre") else "p"
        above = shell + ((("header", ()),) if tag == "h1" and rng.random() < 0.3 else ()) + ((("ul", ()),) if tag == "li" else ())
        if tag == "p" and rng.random() < 0.1:
            tag = pick(("h2", "div", "li", "blockquote", "td"))
        page.append((Piece(piece.text, 0 if rng.random() < 0.9 else len(piece.text) // 4, above + ((tag, ()),)), 1))
    if rng.random() < 0.4:
        page += part(shell)
    for _ in range(int(rng.integers(1, 4))):
        page += part(base + (wrap if rng.random() < 0.5 else ()))
    return [p for p, _ in page], [y for _, y in page]


def fit(pages: list[str | None], variants: int = VARIANTS, epochs: int = EPOCHS, seed: int = 11) -> Labeller:
    """A labeller from pages; without any that marks its article, from plain built ones."""
    rng = np.random.default_rng(seed)
    parsed = [(p, y) for p, y in ((p, marked(p)) for p in map(blocks_of, pages)) if y]
    if not parsed:
        made = [Piece(("Plain sentence number %d, with some words in it. " % k) * (1 + k % 4), 0, (("article", ()), ("p", ()))) for k in range(8)]
        parsed = [(made + [Piece("Home", 4, (("nav", ()), ("li", ())))], [1] * 8 + [0])]
        variants = 60
    foreign = [p.text for pieces, y in parsed for p, label in zip(pieces, y) if label]
    data = []
    for pieces, y in parsed:
        data.append((pieces, y))
        main, other = [p for p, label in zip(pieces, y) if label], [p for p, label in zip(pieces, y) if not label]
        data += [rearranged(main, other or main, foreign, rng) for _ in range(variants)]
    rows = [(features(p), np.array(y, np.float32)) for p, y in data]
    rows.sort(key=lambda r: len(r[0]))
    groups = [rows[k:k + 32] for k in range(0, len(rows), 32)]
    model = Labeller.fresh(rows[0][0].shape[1], HIDDEN)
    first, second = ({k: np.zeros_like(v) for k, v in model.w.items()} for _ in range(2))
    step = 0
    for epoch in range(epochs):
        for g in rng.permutation(len(groups)):
            x, sizes = padded([r[0] for r in groups[g]])
            y, _ = padded([r[1][:, None] for r in groups[g]])
            # Names are dropped now and then, so that context and words count as well.
            x[..., :PATH_SLOTS] *= rng.random((*x.shape[:2], 1)) > 0.05
            _, grads = model.gradients(x, sizes, y[..., 0])
            step += 1
            rate = 0.01 * (1 - epoch / epochs) * (1 - 0.999**step) ** 0.5 / (1 - 0.9**step)
            for k, grad in grads.items():
                first[k] = 0.9 * first[k] + 0.1 * grad
                second[k] = 0.999 * second[k] + 0.001 * grad * grad
                model.w[k] = (model.w[k] - rate * first[k] / (np.sqrt(second[k]) + 1e-6)).astype(np.float32)
    return model


def main_text(pieces: list[Piece], keep: np.ndarray) -> str:
    return " ".join(p.text for p, good in zip(pieces, keep) if good)


def fitted_on(pages: DataFrame, html: str, rows: int) -> dict[str, np.ndarray]:
    """Weights from the first pages in md5 order of their html, each different one once; one task fits them."""
    drawn = pages.select(F.col(f"`{html}`").alias("html")).filter("html IS NOT NULL").withColumn("m", F.md5("html"))
    marks = drawn.select("m").distinct().orderBy("m").limit(rows)
    sample = drawn.join(F.broadcast(marks), "m").dropDuplicates(["m"]).select("m", "html").repartition(1)  # at most ``rows`` pages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = sorted((m, h) for batch in batches for m, h in zip(batch.column("m").to_pylist(), batch.column("html").to_pylist()))
        weights = fit([h for _, h in found]).w
        yield pa.RecordBatch.from_arrays([pa.array(list(weights)), pa.array([w.tobytes() for w in weights.values()], pa.binary()), pa.array([list(w.shape) for w in weights.values()], pa.list_(pa.int64()))],
                                         ["name", "data", "shape"])

    made = {r["name"]: np.frombuffer(r["data"], np.float32).reshape(r["shape"]) for r in sample.mapInArrow(run, "name string, data binary, shape array<bigint>").collect()}
    return made or Labeller.fresh(PATH_SLOTS + WORD_SLOTS + FIGURES, HIDDEN).w  # without any page nothing is labelled


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", train_pages: int = TRAIN_PAGES, model: Labeller | None = None) -> DataFrame:
    """One row per page: page_id, url, text (main text, empty if none), n_chars, n_blocks, n_kept.

    A null or empty html has no blocks and an empty text. Unclosed and stray tags, comments and raw
    elements are read as browsers do. Repeated pages are read one by one; extra columns are not read.
    ``model`` uses a fitted labeller instead of fitting one.
    """
    batch_rows(pages.sparkSession, 1000)
    weights = pages.sparkSession.sparkContext.broadcast(model.w if model else fitted_on(pages, html, train_pages))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(weights.value)
        for batch in batches:
            column = batch.column("html")
            for begin in range(0, batch.num_rows, 256):
                parsed = [blocks_of(x.as_py()) for x in column[begin:begin + 256]]
                keep = labeller.label(parsed)
                texts = [main_text(p, k).encode("utf-8", "replace").decode() for p, k in zip(parsed, keep)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("page_id")[begin:begin + 256], batch.column("url")[begin:begin + 256], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()),
                     pa.array([len(p) for p in parsed], pa.int64()), pa.array([int(k.sum()) for k in keep], pa.int64())], ["page_id", "url", "text", "n_chars", "n_blocks", "n_kept"])

    rows = pages.select(F.col(f"`{page_id}`").alias("page_id"), F.col(f"`{url}`").alias("url"), F.col(f"`{html}`").alias("html"))
    kind = rows.schema["page_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars bigint, n_blocks bigint, n_kept bigint")
