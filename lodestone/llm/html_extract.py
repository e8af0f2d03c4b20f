"""Main text of web pages by a recurrent block labeller.

A page becomes its sequence of leaf blocks: runs of text between block-level
tags, each with the path of elements above it.  A bidirectional LSTM in numpy
reads the blocks' vectors (hashed tag path with classes and ids, hashed words,
length, share of link text, place) and labels every block as main text or not,
knowing the whole page before and after it.

The labeller is trained on the driver from two bounded sets: ``synthetic``
pages of common skeletons made here, whose labels follow from their making,
and at most ``max_pages`` pages of the table (chosen by a hash of the id, at
most ``MAX_TRAIN_CHARS`` long), whose blocks are labelled by their semantic
elements; part of the tag paths is hidden in training, so that words and
context count.  Labelling then covers every page whole in one narrow pass.

Character references are decoded; white space inside a block, <br> included,
becomes one space; scripts, styles, comments and other markup are no text.  A
null html is an empty page; a page without main text gives the empty string.
Cut-off tags at a page's end are markup.  Repeated rows give repeated results;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import small_batches, table

MAX_PAGES, SYNTHETIC, MAX_TRAIN_CHARS = 300, 1000, 50_000
#: Blocks that the labeller takes in at once, padding included, and characters of html that are parsed at once.
MAX_PADDED, PASS_CHARS = 1 << 14, 1 << 22
PATH_DIMS, WORD_DIMS, EXTRA_DIMS, HIDDEN = 48, 24, 6, 16
DIMS = PATH_DIMS + WORD_DIMS + EXTRA_DIMS

# Element kinds of the HTML standard.
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()) | set("math mrow mi mo mn ms mtext mspace msup msub msubsup mfrac msqrt mroot mover munder munderover mtable mtr mtd mstyle mpadded menclose semantics".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template textarea title iframe noembed noframes svg select annotation annotation-xml".split())
FOREIGN = {"svg", "annotation", "annotation-xml"}
CLOSES_P = set("address article aside blockquote center details dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
# Elements and names that mark main text and what is not.
MAIN_TAGS = {"article", "main"}
OTHER_TAGS = {"nav", "header", "footer", "aside", "form", "dialog", "menu", "button", "object", "canvas", "audio", "video"}
OTHER_NAMES = set("ad ads advert advertisement adsense banner breadcrumb breadcrumbs comment comments commentlist cookie cookies disqus footer header login menu modal nav navbar newsletter notice popup promo recommended related share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<([a-zA-Z][^\s/>]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|<[!?/][^>]*(?:>|\Z)|([^<]+)|(<(?![a-zA-Z/!?]))", re.S)
_NAMES = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for t in RAW}


@dataclass
class Block:
    path: tuple[tuple[str, tuple[str, ...]], ...]
    text: str
    link_chars: int


def blocks_of(html: str | None) -> list[Block]:
    """The leaf blocks of a page in page order."""
    html = html or ""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    held: list[str] = []
    link_chars = links = at = 0

    def flush() -> None:
        nonlocal link_chars
        text = " ".join(unescape("".join(held)).split())
        if text:
            out.append(Block(tuple(stack), text, min(link_chars, len(text))))
        held.clear()
        link_chars = 0

    def close(names: set[str], stop: set[str] = frozenset()) -> None:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in names:
                del stack[i:]
                return
            if stack[i][0] in stop:
                return

    while at < len(html):
        m = _TOKEN.match(html, at)
        if not m:  # an open quote in a tag: the tag ends at the next >
            end = html.find(">", at)
            at = end + 1 if end >= 0 else len(html)
            continue
        at = m.end()
        opened, attributes, closed, text, less = m.groups()
        if text or less:
            held.append(m[0])
            if links:
                link_chars += len(m[0])
        elif opened:
            tag = opened.lower()
            if tag in RAW and tag in FOREIGN and attributes.rstrip().endswith("/"):
                held.append(" ")  # only foreign elements close themselves
            elif tag in RAW:
                end = _RAW_END[tag].search(html, at)
                at = end.end() if end else len(html)
                held.append(" ")
            elif tag in INLINE:
                links += tag == "a"
                if tag in ("br", "img"):
                    held.append(" ")
            else:
                flush()
                links = 0
                if tag in CLOSES_P:
                    close({"p"}, {"div", "article", "section", "td", "th", "li", "body"})
                if tag in SIBLINGS:
                    close(SIBLINGS[tag], {"ul", "ol", "dl", "table", "select"})
                if tag not in VOID:
                    names = tuple(w.lower() for g in _NAMES.findall(attributes) for w in re.findall(r"[A-Za-z]+", "".join(g)))
                    stack.append((tag, names))
        elif closed:
            tag = closed.lower()
            if tag in INLINE:
                links = max(0, links - (tag == "a"))
            else:
                flush()
                if tag == "p" and not any(t == "p" for t, _ in stack):
                    continue
                close({tag})
    flush()
    return out


def weak_label(block: Block) -> int | None:
    """1 inside an article or main element, 0 inside other semantic parts or outside of it, the innermost sign first."""
    for tag, names in reversed(block.path):
        if tag in OTHER_TAGS or OTHER_NAMES & set(names):
            return 0
        if tag in MAIN_TAGS:
            return 1
    return 0


def vectors_of(blocks: list[Block], start: int = 0, total: int | None = None) -> np.ndarray:
    """One row of DIMS numbers per block; start and total place a stretch in its page."""
    out = np.zeros((len(blocks), DIMS), dtype=np.float32)
    total = len(blocks) if total is None else total
    for i, b in enumerate(blocks):
        for depth, (tag, names) in enumerate(reversed(b.path)):
            weight = 1.0 / (1.0 + 0.25 * depth)
            for name in (tag, *(f".{n}" for n in names)):
                h = zlib.crc32(name.encode())
                out[i, h % PATH_DIMS] += weight if h & 0x10000 else -weight
                h = zlib.crc32(name.encode(), 7)
                out[i, h % PATH_DIMS] += weight if h & 0x10000 else -weight
        words = b.text.split(" ")
        h = np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words), dtype=np.int64, count=len(words))
        counts = np.bincount(h % WORD_DIMS, weights=np.where(h & 0x10000, 1.0, -1.0), minlength=WORD_DIMS)
        out[i, PATH_DIMS : PATH_DIMS + WORD_DIMS] = counts / max(1.0, np.sqrt((counts * counts).sum()))
        out[i, PATH_DIMS + WORD_DIMS :] = (np.log1p(len(words)) / 4, b.link_chars / max(1, len(b.text)), b.text[-1] in ".!?", (start + i) / total, len(b.path) / 8, 1.0)
    return out


class Labeller:
    """A bidirectional LSTM with one logistic output for each block."""

    def __init__(self, weights: dict[str, np.ndarray] | None = None, seed: int = 3):
        if weights is None:
            rng = np.random.default_rng(seed)
            weights = {}
            for d in "fb":
                weights[f"W{d}"] = (rng.standard_normal((DIMS + HIDDEN, 4 * HIDDEN)) * 0.15).astype(np.float32)
                weights[f"c{d}"] = np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)]).astype(np.float32)
            weights["V"] = (rng.standard_normal(2 * HIDDEN) * 0.2).astype(np.float32)
            weights["o"] = np.zeros(1, dtype=np.float32)
        self.w = weights

    @staticmethod
    def _sigmoid(x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))

    def _run(self, x: np.ndarray, counts: np.ndarray, d: str, keep: list | None = None, state: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
        """x: (steps, pages, DIMS), pages by falling length; counts: pages still going at each step; state is where to begin, and is moved on."""
        steps, pages, _ = x.shape
        W, bias = self.w[f"W{d}"], self.w[f"c{d}"]
        gates_in = x @ W[:DIMS] + bias
        h, c = state or (np.zeros((pages, HIDDEN), dtype=np.float32), np.zeros((pages, HIDDEN), dtype=np.float32))
        out = np.zeros((steps, pages, HIDDEN), dtype=np.float32)
        for t in range(steps):
            n = counts[t]
            z = gates_in[t, :n] + h[:n] @ W[DIMS:]
            i, f, o = self._sigmoid(z[:, :HIDDEN]), self._sigmoid(z[:, HIDDEN : 2 * HIDDEN]), self._sigmoid(z[:, 2 * HIDDEN : 3 * HIDDEN])
            g = np.tanh(z[:, 3 * HIDDEN :])
            before, c_before = h[:n].copy() if keep is not None else None, c[:n].copy() if keep is not None else None
            c[:n] = f * c[:n] + i * g
            tc = np.tanh(c[:n])
            h[:n] = o * tc
            out[t, :n] = h[:n]
            if keep is not None:
                keep.append((n, before, c_before, i, f, o, g, tc))
        return out

    @staticmethod
    def _packed(pages: list[np.ndarray]):
        lengths = np.array([len(p) for p in pages])
        x = np.zeros((lengths.max(), len(pages), DIMS), dtype=np.float32)
        back = np.zeros_like(x)
        for k, p in enumerate(pages):
            x[: len(p), k], back[: len(p), k] = p, p[::-1]
        return lengths, (lengths[None, :] > np.arange(lengths.max())[:, None]).sum(axis=1), x, back

    def chances(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """For each page the chance of each block to be main text."""
        out: list[np.ndarray] = [np.zeros(0, dtype=np.float32)] * len(pages)
        order = sorted((k for k in range(len(pages)) if len(pages[k])), key=lambda k: -len(pages[k]))
        s = 0
        while s < len(order):
            # Pages are padded to the longest of their part: a part is bounded by that product.
            part = order[s : s + max(1, min(64, MAX_PADDED // len(pages[order[s]])))]
            s += len(part)
            lengths, counts, x, back = self._packed([pages[k] for k in part])
            f, b = self._run(x, counts, "f"), self._run(back, counts, "b")
            for j, k in enumerate(part):
                n = lengths[j]
                z = f[:n, j] @ self.w["V"][:HIDDEN] + b[:n, j][::-1] @ self.w["V"][HIDDEN:] + self.w["o"][0]
                out[k] = self._sigmoid(z)
        return out

    def long_chances(self, blocks: list[Block], stretch: int = 0) -> np.ndarray:
        """The chances of a very long page, read in stretches in either direction."""
        n, stretch = len(blocks), stretch or MAX_PADDED
        z = np.full(n, self.w["o"][0], dtype=np.float32)
        starts = range(0, n, stretch)
        for d, half, order in (("f", self.w["V"][:HIDDEN], starts), ("b", self.w["V"][HIDDEN:], reversed(starts))):
            state = (np.zeros((1, HIDDEN), dtype=np.float32), np.zeros((1, HIDDEN), dtype=np.float32))
            for s in order:
                x = vectors_of(blocks[s : s + stretch], s, n)
                x = x if d == "f" else x[::-1]
                part = self._run(x[:, None], np.ones(len(x), dtype=np.int64), d, None, state)[:, 0] @ half
                z[s : s + stretch] += part if d == "f" else part[::-1]
        return self._sigmoid(z)

    def _gradients(self, pages: list[np.ndarray], labels: list[np.ndarray]) -> dict[str, np.ndarray]:
        lengths, counts, x, back = self._packed(pages)
        kept: dict[str, list] = {"f": [], "b": []}
        f, b = self._run(x, counts, "f", kept["f"]), self._run(back, counts, "b", kept["b"])
        grad = {k: np.zeros_like(v) for k, v in self.w.items()}
        df, db, total = np.zeros_like(f), np.zeros_like(b), lengths.sum()
        for j, n in enumerate(lengths):
            hf, hb = f[:n, j], b[:n, j][::-1]
            e = (self._sigmoid(hf @ self.w["V"][:HIDDEN] + hb @ self.w["V"][HIDDEN:] + self.w["o"][0]) - labels[j]) / total
            grad["V"][:HIDDEN] += e @ hf
            grad["V"][HIDDEN:] += e @ hb
            grad["o"] += e.sum()
            df[:n, j] = e[:, None] * self.w["V"][:HIDDEN]
            db[:n, j] = (e[:, None] * self.w["V"][HIDDEN:])[::-1]
        for d, xs, dh_out in (("f", x, df), ("b", back, db)):
            W = self.w[f"W{d}"]
            dh, dc = np.zeros((len(pages), HIDDEN), dtype=np.float32), np.zeros((len(pages), HIDDEN), dtype=np.float32)
            for t in range(len(counts) - 1, -1, -1):
                n, before, c_before, i, fg, o, g, tc = kept[d][t]
                h_grad = dh[:n] + dh_out[t, :n]
                c_grad = dc[:n] + h_grad * o * (1 - tc * tc)
                z = np.concatenate([c_grad * g * i * (1 - i), c_grad * c_before * fg * (1 - fg), h_grad * tc * o * (1 - o), c_grad * i * (1 - g * g)], axis=1)
                grad[f"W{d}"][:DIMS] += xs[t, :n].T @ z
                grad[f"W{d}"][DIMS:] += before.T @ z
                grad[f"c{d}"] += z.sum(axis=0)
                dh[:n], dc[:n] = z @ W[DIMS:].T, c_grad * fg
        return grad

    def fit(self, pages: list[np.ndarray], labels: list[np.ndarray], epochs: int = 18, size: int = 24, rate: float = 0.012, hide: float = 0.15, seed: int = 5) -> Labeller:
        """Adam over batches of pages; hide: share of blocks whose tag path is hidden."""
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.w.items()}
        v = {k: np.zeros_like(x) for k, x in self.w.items()}
        step = 0
        for epoch in range(epochs):
            # Pages of like length go together; batches come in a new order each time.
            order = np.argsort([-len(p) for p in pages], kind="stable")
            starts = rng.permutation(np.arange(0, len(order), size))
            for s in starts:
                part = sorted(order[s : s + size].tolist(), key=lambda k: -len(pages[k]))
                shown = []
                for k in part:
                    p = pages[k].copy()
                    p[rng.random(len(p)) < hide * (epoch < epochs - 4), :PATH_DIMS] = 0
                    shown.append(p)
                grad = self._gradients(shown, [labels[k] for k in part])
                norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
                step += 1
                for k, g in grad.items():
                    g = g * min(1.0, 1.0 / (norm + 1e-9))
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.w[k] = (self.w[k] - rate * (0.3 if epoch >= epochs - 4 else 1.0) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self


# Skeletons of the pages made for training.
MAIN_PARTS = ("article", "main", 'div class="content"', 'div id="main-content"', 'div class="post-body"', 'div class="entry-content"', 'section class="article-body"', 'div class="story"', 'div role="main"')
OTHER_PARTS = ("nav", "header", "footer", "aside", 'div class="sidebar"', 'div class="cookie-notice"', 'div class="ad"', 'div class="ads"', 'div class="advert"', 'div class="promo"', 'div class="menu"', 'ul class="breadcrumb"', 'div class="related"', 'div class="share"', 'div class="newsletter"', 'div id="footer"', 'div id="header"', 'div class="banner"', "form", 'div class="notice"', 'div role="navigation"', "object", "video")
WRAPPERS = ('div class="wrap"', 'div class="container"', 'div id="page"', 'div class="row"', 'div class="layout"', 'div class="site"', "div", "section", 'div class="column"')
COMMENT_PARTS = ('section class="comments"', 'div id="comments"', 'ol class="commentlist"', 'div class="comment"')


def synthetic_page(rng: np.random.Generator) -> tuple[list[Block], np.ndarray]:
    """A page of a random skeleton and its blocks' labels."""
    marked: list[tuple[str, int]] = []

    def words(least: int, most: int) -> str:
        n = int(rng.integers(least, most + 1))
        return " ".join("".join(chr(97 + int(c)) for c in rng.integers(0, 26, int(rng.integers(2, 9)))) for _ in range(n)).capitalize() + ("." if most > 8 or rng.random() < 0.3 else "")

    def part(kind: str, label: int, inner: list[str]) -> str:
        tag = kind.split()[0]
        body = []
        for x in inner:
            marked.append((x, label))
            body.append(x)
        return f"<{kind}>" + "".join(body) + f"</{tag}>"

    def other() -> str:
        kind = str(rng.choice(OTHER_PARTS))
        if rng.random() < 0.5:
            return part(kind, 0, [f'<ul><li><a href="/x">{words(1, 3)}</a></li></ul>' for _ in range(int(rng.integers(1, 7)))])
        return part(kind, 0, [f"<p>{words(2, 20)}</p>" if rng.random() < 0.5 else words(1, 14) for _ in range(1)])

    def main(text: str) -> str:
        marked.append((text, 1))
        return text

    def one() -> str:
        """A piece of main text: a paragraph most of the time, else a heading, a list, a table or a caption."""
        r = rng.random()
        if r < 0.6:
            return main(f"<p>{words(1, 60)}</p>")
        if r < 0.7:
            return main(f"<h2>{words(1, 8)}</h2>")
        if r < 0.78:
            return main(f"<blockquote>{words(3, 40)}</blockquote>")
        if r < 0.92:
            return "<ul>" + "".join(main(f"<li>{words(1, 20)}</li>") for _ in range(int(rng.integers(2, 6)))) + "</ul>"
        if r < 0.96:
            return "<table><tr>" + "".join(main(f"<td>{words(1, 6)}</td>") for _ in range(int(rng.integers(2, 5)))) + "</tr></table>"
        return "<figure>" + main(f"<figcaption>{words(2, 14)}</figcaption>") + "</figure>"

    pieces = [other() for _ in range(int(rng.integers(0, 4)))]
    # Half of the pages hold main text and some of the rest in containers that say nothing.
    boxes = [str(rng.choice(WRAPPERS)) for _ in range(int(rng.integers(1, 3)))] if rng.random() < 0.5 else []
    pieces += [f"<{w}>" for w in boxes]
    if boxes and rng.random() < 0.4:
        pieces.append(other())
    kind = str(rng.choice(MAIN_PARTS)) if rng.random() < 0.88 else ""
    inner = []
    if rng.random() < 0.85:
        title = main(f"<h1>{words(1, 8)}</h1>")
        inner.append(f"<header>{title}</header>" if kind and rng.random() < 0.15 else title)
    for _ in range(int(rng.integers(1, 12))):
        inner.append(one())
        if kind and rng.random() < 0.06:
            inner.append(part(str(rng.choice(OTHER_PARTS[3:])), 0, [f"<p>{words(1, 25)}</p>" for _ in range(int(rng.integers(1, 3)))]))
    if kind and rng.random() < 0.15:
        inner.append(part(str(rng.choice(COMMENT_PARTS)), 0, [f"<p>{words(1, 40)}</p>" for _ in range(int(rng.integers(1, 4)))]))
    pieces.append(f"<{kind}>" + "".join(inner) + f"</{kind.split()[0]}>" if kind else "".join(inner))
    if boxes and rng.random() < 0.6:
        pieces += [other() for _ in range(int(rng.integers(1, 3)))]
    pieces += [f"</{w.split()[0]}>" for w in reversed(boxes)]
    if rng.random() < 0.35:
        pieces.append(part(str(rng.choice(COMMENT_PARTS)), 0, [f"<p>{words(1, 40)}</p>" for _ in range(int(rng.integers(1, 5)))]))
    pieces += [other() for _ in range(int(rng.integers(0, 4)))]
    found = blocks_of("<html><body>" + "".join(pieces) + "</body></html>")
    labels = [label for text, label in marked for _ in blocks_of(text)]
    return found, np.array(labels, dtype=np.float32)


def train(pages: DataFrame, max_pages: int = MAX_PAGES, synthetic: int = SYNTHETIC, seed: int = 17) -> dict[str, np.ndarray]:
    """Weights of the labeller: some 50 KB whatever the table's size."""
    rng = np.random.default_rng(seed)
    xs, ys = [], []
    while len(xs) < synthetic:
        found, labels = synthetic_page(rng)
        if len(found) == len(labels) and found:
            xs.append(vectors_of(found))
            ys.append(labels)
    sample = pages.where(F.col("html").isNotNull() & (F.length("html") <= MAX_TRAIN_CHARS)).select("page_id", "html").orderBy(F.xxhash64("page_id"), "page_id").limit(max_pages)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for html in batch.column(0).to_pylist():
                found = blocks_of(html)
                y = np.array([weak_label(b) for b in found], dtype=np.float32)
                if y.any():
                    rows.append((vectors_of(found).tobytes(), y.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())], names=["x", "y"])

    small_batches(pages.sparkSession)
    for r in sample.select("html").mapInArrow(label, "x binary, y binary").collect():
        xs.append(np.frombuffer(bytes(r["x"]), dtype=np.float32).reshape(-1, DIMS))
        ys.append(np.frombuffer(bytes(r["y"]), dtype=np.float32))
    return Labeller().fit(xs, ys).w


END = object()


def main_texts(labeller: Labeller, htmls: list[str | None], threshold: float) -> list[str]:
    """The main text of each page; very long pages go alone."""
    found = [blocks_of(h) for h in htmls]
    short = [k for k, b in enumerate(found) if len(b) <= MAX_PADDED]
    chances = dict(zip(short, labeller.chances([vectors_of(found[k]) for k in short]), strict=True))
    return ["\n".join(b.text for b, c in zip(bs, (chances[k] if k in chances else labeller.long_chances(bs)).tolist(), strict=True) if c >= threshold) for k, bs in enumerate(found)]


def extract(pages: DataFrame, weights: dict[str, np.ndarray], threshold: float = 0.5) -> DataFrame:
    """page_id, url, text of every page: the blocks labelled as main text, one a line."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(weights)
        for batch in batches:
            texts: list[str] = []
            held, size = [], 0
            for html in [*batch.column(2).to_pylist(), END]:
                if html is END or size + len(html or "") > PASS_CHARS:
                    texts += main_texts(labeller, held, threshold)
                    held, size = [], 0
                if html is not END:
                    held.append(html)
                    size += len(html or "")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], schema=schema)

    small_batches(pages.sparkSession)
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(run, "page_id long, url string, text string")


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extract(pages, train(pages)).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
