"""Main text of web pages by a recurrent block labeller.

A page is the sequence of its leaf blocks. Each block is read as a vector of its tag
path (element names and the words of class, id and role, hashed), its words (hashed) and a few
measures; a bidirectional LSTM in numpy runs over the whole sequence and labels every block as
main text or not, so a block's label depends on the whole page.

The network learns from a bounded sample of the pages themselves. Pages that name their article in
markup (``article``, ``main``) give the labels; further training pages are set from the same blocks in other layouts,
with other or no names, beside menus, notices, adverts, forms and reader comments, so that the labels
don't hang on one site's markup alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillgrid.llm.html_blocks import Block, Element, blocks_of

#: Pages learned from, at most, drawn by a hash; longer ones than this many bytes are not drawn. Blocks of one training page, at most.
SAMPLE_PAGES = 400
SAMPLE_BYTES = 64 << 10
TRAIN_BLOCKS = 120
#: Layouts set from each sampled page, besides its own.
LAYOUTS = 6
PATH_DIMS = 160
WORD_DIMS = 48
MEASURES = 9
DIMS = PATH_DIMS + WORD_DIMS + MEASURES
HIDDEN = 16
EPOCHS = 8
BATCH = 48
RATE = 0.01
SEED = 11
#: Pages and padded cells labelled together in a task.
PAGES = 256
CELLS = 16_384

#: Names that mark what lies inside an article without belonging to it.
ASIDE_TAGS = frozenset("nav aside footer header form menu button dialog".split())
ASIDE_NAMES = frozenset("ad ads advert advertisement banner breadcrumb breadcrumbs comment comments cookie menu nav navigation newsletter promo related "
                        "share sidebar sponsor sponsored subscribe".split())


class Vectors:
    """Blocks -> rows of hashed features. Paths and words seen before are looked up."""

    def __init__(self) -> None:
        self.paths: dict[tuple, np.ndarray] = {}
        self.words: dict[str, int] = {}

    def path(self, path: tuple[Element, ...]) -> np.ndarray:
        row = self.paths.get(path)
        if row is None:
            if len(self.paths) > 20_000:
                self.paths.clear()
            row = np.zeros(PATH_DIMS, np.float32)
            for depth, e in enumerate(reversed(path)):
                tokens = [e.tag, *(f".{n}" for n in e.names)]
                if depth < 2:
                    tokens += [f"{depth}{t}" for t in tokens]
                for t in tokens:
                    h = zlib.crc32(t.encode("utf-8", "surrogatepass"))
                    row[h % PATH_DIMS] += 1.0 if h >> 31 else -1.0
            self.paths[path] = row = np.clip(row, -3, 3)
        return row

    def word(self, word: str) -> int:
        at = self.words.get(word)
        if at is None:
            if len(self.words) > 300_000:
                self.words.clear()
            h = zlib.crc32(word.encode("utf-8", "surrogatepass"))
            at = self.words[word] = h % WORD_DIMS + (WORD_DIMS if h >> 31 else 0)
        return at

    def rows(self, blocks: list[Block], first: int = 0, most: int | None = None) -> np.ndarray:
        """Rows of ``most`` blocks of a page from the ``first`` on, all by default."""
        n = len(blocks)
        some = blocks[first:n if most is None else first + most]
        out = np.zeros((len(some), DIMS), np.float32)
        for i, b in enumerate(some, first):
            row = out[i - first]
            row[:PATH_DIMS] = self.path(b.path)
            words = b.text.lower().split()
            counts = np.bincount(np.fromiter(map(self.word, words), np.int64, len(words)), minlength=2 * WORD_DIMS)
            signed = counts[WORD_DIMS:] - counts[:WORD_DIMS]
            row[PATH_DIMS:PATH_DIMS + WORD_DIMS] = signed / max(1.0, float(signed @ signed) ** 0.5)  # one word a thousand times is one direction
            size, marks = len(b.text), sum(map(b.text.count, ".,;:?!"))
            row[PATH_DIMS + WORD_DIMS:] = (np.log1p(size) / 4, np.log1p(len(words)) / 3, b.link_chars / size, min(1.0, 10 * marks / size),
                                              b.text[-1] in ".?!", sum(map(str.isdigit, b.text[:64])) / min(64, size), i / n, (n - i) / n, min(i, 10) / 10)
        return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Labeller:
    """Weights: per direction input (DIMS x 4H), recurrent (H x 4H), bias; output (2H) and bias. Gates: input, forget, output, new."""

    params: dict[str, np.ndarray]

    @classmethod
    def new(cls, seed: int = SEED) -> Labeller:
        r = np.random.default_rng(seed)
        p = {}
        for side in "fb":
            p["x" + side] = r.normal(0, 0.5 / DIMS ** 0.5, (DIMS, 4 * HIDDEN))
            p["h" + side] = r.normal(0, 0.5 / HIDDEN ** 0.5, (HIDDEN, 4 * HIDDEN))
            p["c" + side] = np.concatenate((np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)))
        p["out"], p["bias"] = r.normal(0, 0.1, 2 * HIDDEN), np.zeros(1)
        return cls(p)

    def small(self) -> Labeller:
        return Labeller({k: v.astype(np.float32) for k, v in self.params.items()})

    def project(self, rows: np.ndarray) -> np.ndarray:
        """What both directions take from the input: blocks x 8H."""
        p = self.params
        return rows @ np.concatenate((p["xf"], p["xb"]), 1) + np.concatenate((p["cf"], p["cb"]))

    def _run(self, side: str, gates: np.ndarray, mask: np.ndarray, keep: list | None = None) -> np.ndarray:
        """Hidden states (steps x pages x H) over ``gates`` (steps x pages x 4H); the state stays where a page has ended."""
        steps, pages, _ = gates.shape
        h, c = np.zeros((pages, HIDDEN), gates.dtype), np.zeros((pages, HIDDEN), gates.dtype)
        out = np.zeros((steps, pages, HIDDEN), gates.dtype)
        for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
            z = gates[t] + h @ self.params["h" + side]
            s, new = _sigmoid(z[:, :3 * HIDDEN]), np.tanh(z[:, 3 * HIDDEN:])
            i, f, o = s[:, :HIDDEN], s[:, HIDDEN:2 * HIDDEN], s[:, 2 * HIDDEN:]
            m = mask[t][:, None]
            c1 = f * c + i * new
            tc = np.tanh(c1)
            h1 = o * tc
            if keep is not None:
                keep.append((t, h, c, i, f, o, new, tc))
            h, c = np.where(m, h1, h), np.where(m, c1, c)
            out[t] = h
        return out

    def score(self, gates: list[np.ndarray]) -> list[np.ndarray]:
        """Probability of main text for each block of each page, from its projected rows."""
        steps = max(len(g) for g in gates)
        z = np.zeros((steps, len(gates), 8 * HIDDEN), gates[0].dtype)
        mask = np.zeros((steps, len(gates)), bool)
        for j, g in enumerate(gates):
            z[:len(g), j], mask[:len(g), j] = g, True
        p = self.params
        linear = self._run("f", z[:, :, :4 * HIDDEN], mask) @ p["out"][:HIDDEN]
        linear += self._run("b", z[:, :, 4 * HIDDEN:], mask) @ p["out"][HIDDEN:] + p["bias"]
        return [_sigmoid(linear[:len(g), j]) for j, g in enumerate(gates)]

    def gradients(self, rows: list[np.ndarray], labels: list[np.ndarray]) -> dict[str, np.ndarray]:
        """Of the mean log-loss over all blocks, by back-propagation through time."""
        p, pages, steps = self.params, len(rows), max(map(len, rows))
        x, y, mask = np.zeros((steps, pages, DIMS)), np.zeros((steps, pages)), np.zeros((steps, pages), bool)
        for j, (r, lab) in enumerate(zip(rows, labels, strict=True)):
            x[:len(r), j], y[:len(r), j], mask[:len(r), j] = r, lab, True
        z = self.project(x.reshape(-1, DIMS)).reshape(steps, pages, -1)
        kept: dict[str, list] = {"f": [], "b": []}
        states = {s: self._run(s, z[:, :, 4 * HIDDEN * k:4 * HIDDEN * (k + 1)], mask, kept[s]) for k, s in enumerate("fb")}
        linear = states["f"] @ p["out"][:HIDDEN] + states["b"] @ p["out"][HIDDEN:] + p["bias"]
        d = (_sigmoid(linear) - y) * mask / mask.sum()
        g = {"bias": np.array([d.sum()]), "out": np.concatenate([np.einsum("tn,tnh->h", d, states[s]) for s in "fb"])}
        for k, side in enumerate("fb"):
            w, dz = p["h" + side], np.zeros((steps, pages, 4 * HIDDEN))
            dh, dc, dw = np.zeros((pages, HIDDEN)), np.zeros((pages, HIDDEN)), np.zeros_like(w)
            for t, h, c, i, f, o, new, tc in reversed(kept[side]):
                dh = dh + d[t][:, None] * p["out"][None, HIDDEN * k:HIDDEN * (k + 1)]
                m = mask[t][:, None]
                dh1, dc1 = np.where(m, dh, 0), np.where(m, dc, 0)
                dc1 = dc1 + dh1 * o * (1 - tc ** 2)
                step = np.concatenate((dc1 * new * i * (1 - i), dc1 * c * f * (1 - f), dh1 * tc * o * (1 - o), dc1 * i * (1 - new ** 2)), 1)
                dz[t] = step
                dw += h.T @ step
                dh, dc = np.where(m, step @ w.T, dh), np.where(m, dc1 * f, dc)
            flat = dz.reshape(-1, 4 * HIDDEN)
            g["h" + side], g["x" + side], g["c" + side] = dw, x.reshape(-1, DIMS).T @ flat, flat.sum(0)
        return g


def fit(rows: list[np.ndarray], labels: list[np.ndarray], epochs: int = EPOCHS, seed: int = SEED) -> Labeller:
    """Adam over batches of pages of like length, in an order that the seed gives."""
    net, r = Labeller.new(seed), np.random.default_rng(seed)
    m = {k: np.zeros_like(v) for k, v in net.params.items()}
    v = {k: np.zeros_like(x) for k, x in net.params.items()}
    by_size, t = sorted(range(len(rows)), key=lambda i: len(rows[i])), 0
    batches = [by_size[i:i + BATCH] for i in range(0, len(by_size), BATCH)]
    for epoch in range(epochs):
        for b in r.permutation(len(batches)):
            t += 1
            g = net.gradients([rows[i] for i in batches[b]], [labels[i] for i in batches[b]])
            norm = max(1.0, sum(float((x ** 2).sum()) for x in g.values()) ** 0.5)
            rate = RATE * (1.0 if epoch < epochs - 2 else 0.3)
            for k, x in g.items():
                m[k] = 0.9 * m[k] + 0.1 * x / norm
                v[k] = 0.999 * v[k] + 0.001 * (x / norm) ** 2
                net.params[k] = net.params[k] - rate * (m[k] / (1 - 0.9 ** t)) / (np.sqrt(v[k] / (1 - 0.999 ** t)) + 1e-8)
    return net


def marked(blocks: list[Block]) -> np.ndarray | None:
    """Labels from markup that names the article, None where a page has none."""
    def inside(path: tuple[Element, ...]) -> int:
        for at, e in enumerate(path):
            if e.tag in ("article", "main") or "articlebody" in e.names:
                return at
        return -1
    at = [inside(b.path) for b in blocks]
    if max(at, default=-1) < 0:
        return None
    aside = [any(e.tag in ASIDE_TAGS or ASIDE_NAMES & set(e.names) for e in b.path[k + 1:]) if k >= 0 else True for b, k in zip(blocks, at, strict=True)]
    return np.array([not x for x in aside], bool)


class Layouts:
    """Training pages set from the blocks of sampled pages."""

    #: Names of an article's container, of its blocks, and of what stands beside it: (tags, names, words of its blocks). Fixed values.
    MAIN = [("article", ""), ("article", "post"), ("main", ""), ("main", "content"), ("div", "content"), ("div", "post"), ("div", "entry"), ("div", "story"),
            ("div", "article body"), ("section", "text"), ("td", ""), ("div", ""), ("div", "main"), ("section", "")]
    LEAVES = ["p", "p", "p", "p", "p", "p", "li", "h2", "h3", "blockquote", "pre", "td", "div"]
    BESIDE = {
        "nav": (["nav", "nav", "div", "ul"], ["menu", "nav", "navbar", "topnav", "navigation", ""], ["home", "news", "about", "contact", "archive", "help", "login"]),
        "header": (["header", "header", "div"], ["header", "masthead", "top", "site title", "banner", ""], ["welcome", "the daily page", "search", "menu"]),
        "ad": (["div", "aside", "ins", "section"], ["ad", "ads", "advert", "promo", "sponsor", "banner", ""], ["advertisement", "sponsored", "buy now", "special offer"]),
        "sidebar": (["aside", "aside", "div", "section"], ["sidebar", "side", "widget", "right", "related", ""], ["popular", "most read", "related", "tags", "recent posts"]),
        "notice": (["div", "section", "dialog"], ["cookie", "notice", "consent", "alert", "popup", "gdpr", ""], ["this site uses cookies", "accept", "privacy policy"]),
        "form": (["form", "form", "div"], ["form", "subscribe", "newsletter", "signup", "search", ""], ["e-mail", "name", "send", "subscribe to our newsletter", "password"]),
        "comments": (["section", "div", "ol", "ul"], ["comments", "comment list", "replies", "discussion", "responses", "disqus"], ["comments", "reply", "says", "leave a comment", "3 comments", "report"]),
        "footer": (["footer", "footer", "div"], ["footer", "bottom", "foot", "legal", "copyright", ""], ["© 2024", "all rights reserved", "imprint", "terms", "privacy"]),
    }
    ORDER = ["notice", "header", "nav", "ad", "sidebar", "MAIN", "ad", "sidebar", "comments", "form", "nav", "footer", "notice"]
    CHANCE = {"notice": 0.2, "header": 0.5, "nav": 0.6, "ad": 0.4, "sidebar": 0.35, "comments": 0.5, "form": 0.35, "footer": 0.8}

    def __init__(self, pages: list[list[str]], seed: int = SEED):
        """``pages``: the main blocks of each sampled page."""
        self.r, self.pages = np.random.default_rng(seed), pages
        self.words = [w for p in pages for t in p[:4] for w in t.split()[:60]] or ["text"]

    def _pick(self, of: list):
        return of[int(self.r.integers(len(of)))]

    def _some(self, low: int, high: int) -> str:
        n, at = int(self.r.integers(low, high + 1)), int(self.r.integers(len(self.words)))
        return " ".join(self.words[at:at + n]) or "text"

    def _beside(self, kind: str, above: tuple[Element, ...]) -> list[Block]:
        tags, names, words = self.BESIDE[kind]
        box = above + (Element(self._pick(tags), tuple(self._pick(names).split())),)
        out = []
        for _ in range(int(self.r.integers(1, 9 if kind in ("nav", "comments", "sidebar", "footer") else 4))):
            leaf, linked = self._pick(["p", "div", "span", "li", "h3"]), False
            if kind in ("nav", "sidebar", "header", "footer") and self.r.random() < 0.6:
                text, leaf, linked = self._some(1, 4), "li", self.r.random() < 0.9
            elif kind == "comments" and self.r.random() < 0.6:
                text = self._some(4, 60)
            elif self.r.random() < 0.5:
                text = self._pick(words)
            else:
                text = self._some(3, 25)
            path = box + ((Element("li", ("comment",) if self.r.random() < 0.5 else ()),) if kind == "comments" and self.r.random() < 0.6 else ())
            out.append(Block(text, path + (Element(leaf, ()),) + ((Element("a", ()),) if linked else ()), len(text) if linked else 0))
        return out

    def page(self, own: list[str]) -> tuple[list[Block], np.ndarray]:
        """One page around the main blocks ``own``, and its labels."""
        top: tuple[Element, ...] = (Element("html", ()), Element("body", ()))
        if self.r.random() < 0.5:
            top += (Element("div", tuple(self._pick(["wrapper", "page", "container", "site", ""]).split())),)
        blocks: list[Block] = []
        labels: list[bool] = []
        for kind in self.ORDER:
            if kind != "MAIN":
                if self.r.random() < self.CHANCE[kind] * (0.7 if kind in ("ad", "nav", "sidebar", "notice") else 1):
                    more = self._beside(kind, top)
                    blocks += more
                    labels += [False] * len(more)
                continue
            tag, names = self._pick(self.MAIN)
            box = top + (Element(tag, tuple(names.split())),)
            for k, text in enumerate(own):
                leaf = "h1" if k == 0 and self.r.random() < 0.7 else self._pick(self.LEAVES)
                path = box + ((Element("ul", ()),) if leaf == "li" else ()) + (Element(leaf, ()),)
                blocks.append(Block(text, path + ((Element("b", ()),) if self.r.random() < 0.1 else ()), 0))
                labels.append(True)
                if k and self.r.random() < 0.04:
                    more = self._beside(self._pick(["ad", "form", "sidebar"]), box)
                    blocks += more
                    labels += [False] * len(more)
        return blocks, np.array(labels, bool)


def _short(texts: list[str], most: int = TRAIN_BLOCKS) -> list[str]:
    """At most so many blocks of a page: its first and its last ones."""
    return texts if len(texts) <= most else texts[:most // 2] + texts[-(most // 2):]


def _worn(text: str) -> str:
    """A block's text with its first word in place of every word."""
    words = text.split()
    return " ".join(words[:1] * len(words))


def training_pages(pages: list[str]) -> tuple[list[list[Block]], list[np.ndarray]]:
    """Labelled block sequences from sampled pages: as they are where markup names the article, and in other layouts."""
    out, labels, mains = [], [], []
    for page in pages:
        blocks = blocks_of(page)
        known = marked(blocks)
        if known is None:
            mains.append([b.text for b in blocks if len(b.text) >= 80 and 2 * b.link_chars < len(b.text)])
            continue
        mains.append([b.text for b, k in zip(blocks, known, strict=True) if k])
        at = range(len(blocks)) if len(blocks) <= TRAIN_BLOCKS else [*range(TRAIN_BLOCKS // 2), *range(len(blocks) - TRAIN_BLOCKS // 2, len(blocks))]
        out.append([blocks[i] for i in at])
        labels.append(known[list(at)])
        if len(out) % 8 < 2:  # articles of one word over and over are articles all the same
            out.append([Block(_worn(b.text), b.path, b.link_chars) if known[i] else b for i, b in zip(at, out[-1], strict=True)])
            labels.append(labels[-1])
    mains = [m for m in mains if m]
    layouts = Layouts(mains)
    for own in mains:
        for k in range(LAYOUTS):
            some = _short(own, [TRAIN_BLOCKS, 12, 4, 30, 2, 8][k % 6])
            blocks, known = layouts.page([_worn(t) for t in some] if layouts.r.random() < 0.08 else some)
            out.append(blocks)
            labels.append(known)
    return out, labels


def train(pages: DataFrame, size: int = SAMPLE_PAGES) -> Labeller:
    """A labeller from at most ``size`` pages of at most ``SAMPLE_BYTES`` each; without any page it labels nothing as main text."""
    # About four times the sample passes the hash, however large the table; copies of one row are one.
    share = min(1.0, 4 * size / max(1, pages.count()))
    at = F.xxhash64("page_id", "url")
    near = pages.filter(F.pmod(at, F.lit(1 << 30)) <= int(share * (1 << 30)))
    drawn = (near.filter((F.length("html") > 0) & (F.octet_length("html") <= SAMPLE_BYTES)).select(at.alias("at"), "html").distinct()
                 .orderBy("at", "html").limit(size).collect())  # 400 pages of 64 KB at most
    blocks, labels = training_pages([r["html"] for r in drawn])
    vectors = Vectors()
    known = [(vectors.rows(b), y) for b, y in zip(blocks, labels, strict=True) if b]
    if not known:
        empty = Labeller.new()
        empty.params["out"][:], empty.params["bias"][:] = 0, -1
        return empty.small()
    return fit([x for x, _ in known], [y for _, y in known]).small()


def label(net: Labeller, vectors: Vectors, pages: list[list[Block]]) -> list[np.ndarray]:
    """True for each block of main text. Pages of like length are run together; every block of every page is read."""
    gates = [np.concatenate([net.project(vectors.rows(p, lo, 4096)) for lo in range(0, len(p), 4096)]) if p else np.zeros((0, 8 * HIDDEN), np.float32) for p in pages]
    order = sorted((i for i in range(len(pages)) if len(gates[i])), key=lambda i: len(gates[i]))
    out = [np.zeros(0, bool)] * len(pages)
    lo = 0
    while lo < len(order):
        hi = lo + 1
        while hi < len(order) and len(gates[order[hi]]) * (hi + 1 - lo) <= CELLS:
            hi += 1
        for i, p in zip(order[lo:hi], net.score([gates[i] for i in order[lo:hi]]), strict=True):
            out[i] = p >= 0.5
        lo = hi
    return out


def extract(pages: DataFrame, net: Labeller) -> DataFrame:
    """page_id, url, text (main blocks joined by a blank, empty if none), n_chars of every row of ``pages`` (page_id, url, html).

    Reads the whole html of every row, null as empty. Null ids and urls pass through, repeated rows stay, equal
    scores can't tie (a block is main text from a half on), an empty table gives no rows; further columns are not read.
    """
    sent = pages.sparkSession.sparkContext.broadcast(net)  # some 25,000 weights

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        vectors = Vectors()
        for batch in batches:
            for at in range(0, batch.num_rows, PAGES):
                part = batch.slice(at, PAGES)
                blocks = [blocks_of(h) for h in part.column(2).to_pylist()]
                texts = [" ".join(b.text for b, k in zip(bs, keep, strict=True) if k) for bs, keep in zip(blocks, label(sent.value, vectors, blocks), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                                 ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
