"""Main text of web pages by a recurrent block labeller.

A page is cut into blocks (the text between tags that begin or end a block).  A bidirectional LSTM reads the blocks of the
whole page in order, each as a vector of its tag path (names, classes, ids and roles of the open elements), its hashed
words and a few figures, and says for every block whether it belongs to the article.

The network is trained here, on a bounded sample of pages whose markup says where the article is, and on variants of them in
which that markup is replaced and further page parts are put in.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.common import table

# Fixed by HTML: elements without content, with raw text, that begin a block, and that an opening tag closes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style".split())
# Their content is read like what stands around them; they only end a block.
FALLBACK = frozenset("noscript template iframe object canvas".split())
FORM = frozenset("form button select textarea option label fieldset".split())
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol option p pre search section select summary table tbody td "
    "textarea tfoot th thead title tr ul".split()
)
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
NOT_IN_P = BLOCKS - frozenset("button label option select textarea caption td th tr tbody thead tfoot li dt dd title body html head".split())

# Names of page parts that are not the article, and of those that are; training variants are made of them.
ASIDE_NAMES = (
    "ad ads advert advertisement banner sponsor promo nav navbar menu breadcrumb header masthead topbar footer copyright sidebar aside related "
    "recommended widget cookie consent notice alert popup modal newsletter subscribe signup login search share social comment comments "
    "discussion replies respondents disqus"
).split()
MAIN_NAMES = "content article post entry story main body text page-content post-content article-body entry-content".split()

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/<>]*)(?P<attrs>(?:[^<>\"']++|\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))*+)(?:>|\Z)|<[!?/][^<>]*(?:>|\Z)|<\Z",
    re.S | re.I,
)
RAW_END = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I) for name in RAW}
ATTR = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.S | re.I)
NAME = re.compile(r"[a-z0-9]+")
SPACE = re.compile(r"\s+")

PATH_DIM, WORD_DIM, PLAIN = 160, 32, 6
INPUT = PATH_DIM + WORD_DIM + PLAIN
HIDDEN = 16
# Pages the network is fitted on, about, and the longest of them; which ones is decided by a hash of the id.
SAMPLE, SAMPLE_CHARS = 240, 1 << 16
EPOCHS, RATE, SEED = 8, 0.01, 7
# Cells (blocks) that are read through the network at once.
CELLS = 1 << 14


@dataclass
class Block:
    path: tuple[str, ...]
    text: str
    linked: int


def labels_of(name: str, attrs: str) -> tuple[str, ...]:
    """The element's name and the names in its class, id and role."""
    found = [name]
    for m in ATTR.finditer(attrs) if "=" in attrs else ():
        value = (m[2] or m[3] or m[4] or "").lower()
        found += [f".{part}" for part in NAME.findall(value)]
    return tuple(found)


def blocks_of(page: str) -> list[Block]:
    """Blocks in page order: path of the open elements, text with single spaces, and how much of it is in links.

    Comments, scripts and styles vanish; a script or style that is never closed ends at its own tag, and a tag that the page's end
    cuts off is markup.  Inline elements, ``svg`` and ``math`` among them, and ``br`` stay inside their block; ``br`` counts as white
    space.  What stands in place of an object, canvas, frame or script is a block of its own, on the path of what is around it.
    """
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    parts: list[str] = []
    linked, in_link, in_svg, at = 0, 0, 0, 0
    endless: set[str] = set()

    def close() -> None:
        nonlocal linked
        text = SPACE.sub(" ", "".join(parts)).strip()
        if text:
            out.append(Block(tuple(x for _, labels in stack for x in labels), text, linked))
        parts.clear()
        linked = 0

    def pop(names: Sequence[str], stop: frozenset[str] | tuple[str, ...] = ()) -> None:
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in names:
                del stack[k:]
                return
            if stack[k][0] in stop:
                return

    while m := TAG.search(page, at):
        if m.start() > at:
            parts.append(html.unescape(page[at : m.start()]))
            linked += (m.start() - at) * (in_link > 0)
        at = m.end()
        name = (m["name"] or "").lower()
        if not name:
            continue
        if name in RAW and not m["end"] and name not in endless:
            end = RAW_END[name].search(page, at)
            if end:
                at = end.end()
            else:
                endless.add(name)
        elif name == "br":
            parts.append(" ")
        elif name == "a":
            in_link = 0 if m["end"] else 1
        elif name == "svg":
            in_svg = not m["end"] and not m["attrs"].endswith("/")
        elif name in FALLBACK:
            close()
        elif name in BLOCKS and not (in_svg and name == "title"):
            in_svg = 0
            close()
            in_link = 0
            if m["end"]:
                pop((name,), ("html", "body") if name not in ("html", "body") else ())
                continue
            if name in NOT_IN_P:
                pop(("p",), ("div", "article", "section", "main", "aside", "footer", "header", "nav", "body", "td", "li", "form", "blockquote"))
            if name in CLOSES:
                pop(CLOSES[name], ("ul", "ol", "menu", "dl", "table", "select"))
            if name not in VOID:
                stack.append((name, labels_of(name, m["attrs"])))
    if at < len(page):
        parts.append(html.unescape(page[at:]))
    close()
    return out


class Reader:
    """Vectors of blocks; path vectors are kept, since pages share their layout."""

    def __init__(self) -> None:
        self.paths: dict[tuple[str, ...], np.ndarray] = {}

    def path(self, path: tuple[str, ...]) -> np.ndarray:
        found = self.paths.get(path)
        if found is None:
            if len(self.paths) > 50_000:
                self.paths.clear()
            found = np.zeros(PATH_DIM, np.float32)
            for name in path:
                found[xxhash.xxh32_intdigest(name) % PATH_DIM] = 1
            self.paths[path] = found
        return found

    def matrix(self, blocks: Sequence[Block]) -> np.ndarray:
        out = np.zeros((len(blocks), INPUT), np.float32)
        digest = xxhash.xxh32_intdigest
        for k, b in enumerate(blocks):
            out[k, :PATH_DIM] = self.path(b.path)
            words = b.text.split()
            counts = np.bincount(np.fromiter((digest(w) % WORD_DIM for w in words), np.int64, len(words)), minlength=WORD_DIM)
            out[k, PATH_DIM:-PLAIN] = counts / (2 * np.sqrt(np.square(counts).sum()) + 1)
            form = any(x in FORM for x in b.path)
            out[k, -PLAIN:] = (min(len(b.text), 2000) / 2000, min(len(words), 20) / 20, min(1.0, b.linked / len(b.text)), b.text[-1] in ".!?:", k / len(blocks), form)
        return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Network:
    """Weights of both directions (input and state to the four gates) and of the answer."""

    weights: dict[str, np.ndarray]

    @staticmethod
    def fresh(seed: int = SEED) -> Network:
        rng = np.random.default_rng(seed)
        w = {}
        for d in "fb":
            w[f"x{d}"] = (rng.standard_normal((INPUT, 4 * HIDDEN)) * 0.1).astype(np.float32)
            w[f"h{d}"] = (rng.standard_normal((HIDDEN, 4 * HIDDEN)) / np.sqrt(HIDDEN)).astype(np.float32)
            w[f"c{d}"] = np.r_[np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)].astype(np.float32)
        w["out"] = (rng.standard_normal(2 * HIDDEN) * 0.1).astype(np.float32)
        w["bias"] = np.zeros(1, np.float32)
        return Network(w)

    def direction(self, x: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """States of one direction; ``x`` is (time, pages, INPUT) and padded at the end of the reading order."""
        w = self.weights
        gates_in = x @ w[f"x{d}"] + w[f"c{d}"]
        h = np.zeros((x.shape[1], HIDDEN), np.float32)
        c = np.zeros_like(h)
        out = np.empty((*x.shape[:2], HIDDEN), np.float32)
        for t in range(len(x)):
            g = gates_in[t] + h @ w[f"h{d}"]
            i, f, o = (sigmoid(g[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
            n = np.tanh(g[:, 3 * HIDDEN :])
            before, last = c, h
            c = f * c + i * n
            squashed = np.tanh(c)
            h = o * squashed
            out[t] = h
            if keep is not None:
                keep.append((i, f, o, n, before, squashed, last))
        return out

    def answers(self, x: np.ndarray, back: np.ndarray) -> np.ndarray:
        """Log odds of every block; ``back`` maps places to those of the reversed page."""
        pages = np.arange(x.shape[1])
        both = np.concatenate([self.direction(x, "f"), self.direction(x[back, pages], "b")[back, pages]], axis=2)
        return both @ self.weights["out"] + self.weights["bias"]

    def gradients(self, x: np.ndarray, back: np.ndarray, wanted: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Of the weighted log loss, by back propagation through both directions."""
        w, pages = self.weights, np.arange(x.shape[1])
        kept: dict[str, list] = {"f": [], "b": []}
        xs = {"f": x, "b": x[back, pages]}
        states = {"f": self.direction(xs["f"], "f", kept["f"]), "b": self.direction(xs["b"], "b", kept["b"])[back, pages]}
        both = np.concatenate([states["f"], states["b"]], axis=2)
        error = ((sigmoid(both @ w["out"] + w["bias"]) - wanted) * weight).astype(np.float32)
        grad = {"out": np.einsum("tp,tph->h", error, both), "bias": np.array([error.sum()], np.float32)}
        for d in "fb":
            dout = error[:, :, None] * w["out"][:HIDDEN] if d == "f" else (error[:, :, None] * w["out"][HIDDEN:])[back, pages]
            dg = np.empty((*x.shape[:2], 4 * HIDDEN), np.float32)
            grad[f"h{d}"] = np.zeros_like(w[f"h{d}"])
            dh = np.zeros((x.shape[1], HIDDEN), np.float32)
            dc = np.zeros_like(dh)
            for t in range(len(x) - 1, -1, -1):
                i, f, o, n, before, squashed, last = kept[d][t]
                dh = dh + dout[t]
                dc = dc + dh * o * (1 - squashed**2)
                dg[t] = np.concatenate([dc * n * i * (1 - i), dc * before * f * (1 - f), dh * squashed * o * (1 - o), dc * i * (1 - n**2)], axis=1)
                grad[f"h{d}"] += last.T @ dg[t]
                dh, dc = dg[t] @ w[f"h{d}"].T, dc * f
            grad[f"x{d}"] = xs[d].reshape(-1, INPUT).T @ dg.reshape(-1, 4 * HIDDEN)
            grad[f"c{d}"] = dg.sum(axis=(0, 1))
        return grad


def padded(pages: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pages as (time, pages, INPUT), the map to reversed places, and which places hold a block."""
    sizes = np.array([len(p) for p in pages])
    x = np.zeros((sizes.max(), len(pages), INPUT), np.float32)
    for k, p in enumerate(pages):
        x[: len(p), k] = p
    t = np.arange(len(x))[:, None]
    real = t < sizes
    return x, np.where(real, sizes - 1 - t, t), real


def is_main(path: tuple[str, ...]) -> bool:
    """What the markup of a training page says: inside ``article`` or ``main``, not inside a part that is none of it."""
    inside = False
    for name in path:
        if name in ("article", "main"):
            inside = True
        elif name in ("nav", "header", "footer", "aside", "form", "dialog") or name[0] == "." and name[1:] in ASIDE_NAMES:
            return False
    return inside


def variants(blocks: Sequence[Block], others: Sequence[Block], rng: np.random.Generator) -> tuple[list[Block], list[bool]]:
    """A training page with other names for its parts and with further parts put in; ``others`` lend the words."""
    wanted = [is_main(b.path) for b in blocks]
    main_name = ("article", "main", "section", "div")[rng.integers(4)]
    main_path = (main_name,) if main_name in ("article", "main") and rng.random() < 0.5 else (main_name, *(f".{n}" for n in MAIN_NAMES[rng.integers(len(MAIN_NAMES))].split("-")))
    renamed = {n: (("div", f".{n}") if rng.random() < 0.3 else (n,)) for n in ("nav", "footer", "header", "aside")}
    out: list[Block] = []
    labels: list[bool] = []

    def add(path: tuple[str, ...], label: bool, text: str, linked: int = 0) -> None:
        out.append(Block(path, text, linked))
        labels.append(label)

    def words() -> str:
        text = others[rng.integers(len(others))].text.split()
        return " ".join(text[: 1 + rng.integers(30)])

    def part(outer: tuple[str, ...]) -> None:
        name = ASIDE_NAMES[rng.integers(len(ASIDE_NAMES))]
        form = rng.random()
        tag = ("div", "section", "aside", "ul", "p", "span")[rng.integers(6)]
        own = {"header": ("header",), "footer": ("footer",), "nav": ("nav",), "aside": ("aside",)}.get(name, (tag, f".{name}"))
        if form < 0.2:
            own = ("form",) if rng.random() < 0.5 else ("form", f".{name}")
        for _ in range(1 + rng.integers(5)):
            text = words()
            inner = ((), ("p",), ("li",), ("div",), ("h3",), ("label",), ("button",))[rng.integers(7)]
            add((*outer, *own, *inner), False, text, len(text) * int(rng.random() < 0.4))

    for k, b in enumerate(blocks):
        path: list[str] = []
        for name in b.path:
            path += main_path if name in ("article", "main") else renamed.get(name, (name,))
        if rng.random() < 0.08 or k in (1, len(blocks) - 1):
            part(tuple(path[:-1]) if wanted[k] and path[-1] in ("p", "h1", "h2", "li") else ("html", "body"))
        if wanted[k] and rng.random() < 0.2:
            path[-1] = ("blockquote", "h2", "li", "td", "pre", "figcaption")[rng.integers(6)]
        text = words() if wanted[k] and rng.random() < 0.3 else b.text
        add(tuple(path), wanted[k], text, b.linked)
    for _ in range(rng.integers(3)):
        part(("html", "body"))
    return out, labels


def train(pages: Sequence[str], seed: int = SEED, epochs: int = EPOCHS) -> Network:
    """Fit the network to pages with an ``article`` or ``main`` and to two variants of each."""
    rng = np.random.default_rng(seed)
    read = [b for b in map(blocks_of, pages) if any(is_main(x.path) for x in b)]
    network = Network.fresh(seed)
    if not read:
        return network
    others = [b for page in read for b in page]
    examples = [(page, [is_main(b.path) for b in page]) for page in read] + [variants(page, others, rng) for page in read for _ in range(3)]
    reader = Reader()
    ready = sorted(((reader.matrix(b)[:400], np.array(y[:400], np.float32)) for b, y in examples), key=lambda e: len(e[0]))
    batches = [ready[k : k + 16] for k in range(0, len(ready), 16)]
    mean = {k: np.zeros_like(v) for k, v in network.weights.items()}
    square = {k: np.zeros_like(v) for k, v in network.weights.items()}
    step = 0
    for epoch in range(epochs):
        for k in rng.permutation(len(batches)):
            x, back, real = padded([e[0] for e in batches[k]])
            wanted = np.zeros(x.shape[:2], np.float32)
            for j, e in enumerate(batches[k]):
                wanted[: len(e[1]), j] = e[1]
            grad = network.gradients(x, back, wanted, real / real.sum())
            step += 1
            rate = RATE * (1 - epoch / epochs)
            for name, g in grad.items():
                mean[name] = 0.9 * mean[name] + 0.1 * g
                square[name] = 0.99 * square[name] + 0.01 * g * g
                network.weights[name] -= (rate * (mean[name] / (1 - 0.9**step)) / (np.sqrt(square[name] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return network


def label(pages: Sequence[list[Block]], network: Network, reader: Reader) -> list[np.ndarray]:
    """For every page, which of its blocks belong to the article; pages of like length are read together."""
    out = [np.zeros(0, bool)] * len(pages)
    order = sorted((k for k in range(len(pages)) if pages[k]), key=lambda k: len(pages[k]))
    while order:
        # The last is the longest, so the padding of what is taken with it is bounded.
        take = max(1, CELLS // len(pages[order[-1]]))
        now, order = order[-take:], order[:-take]
        x, back, _ = padded([reader.matrix(pages[k]) for k in now])
        odds = network.answers(x, back)
        for j, k in enumerate(now):
            out[k] = odds[: len(pages[k]), j] > 0
    return out


def training_pages(pages: DataFrame, id_col: str, html_col: str, sample: int = SAMPLE) -> list[str]:
    """About ``sample`` pages, in order of id, for the fit; never one of over SAMPLE_CHARS characters."""
    rows = pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{html_col}`").alias("html"))
    total = rows.where(F.length("html").between(1, SAMPLE_CHARS)).count()
    draw = F.pmod(F.xxhash64(F.lit("sample"), F.coalesce(F.col("id").cast("string"), F.lit(""))), F.lit(1 << 30)) / F.lit(float(1 << 30))
    picked = rows.where(F.length("html").between(1, SAMPLE_CHARS) & (draw < F.lit(sample / max(total, 1))))
    return [r["html"] for r in sorted(picked.collect(), key=lambda r: (str(r["id"]), r["html"]))]


def extract(pages: DataFrame, network: Network, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` for every row.

    A null or empty page, and one without any article block, has an empty text.  Repeated rows are read each; other columns are not
    read; an empty table gives no rows.
    """
    picked = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").alias("url"), F.col(f"`{html_col}`").alias("html"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader()
        for batch in batches:
            # A few hundred pages at a time, so that parsed pages never fill the memory.
            for start in range(0, batch.num_rows, 256):
                piece = batch.slice(start, 256)
                parsed = [blocks_of(p or "") for p in piece.column("html").to_pylist()]
                chosen = label(parsed, network, reader)
                texts = ["\n".join(b.text for b, yes in zip(page, main, strict=True) if yes) for page, main in zip(parsed, chosen, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [piece.column("page_id"), piece.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    names=["page_id", "url", "text", "n_chars"],
                )

    return picked.mapInArrow(read, f"page_id {dict(picked.dtypes)['page_id']}, url string, text string, n_chars bigint")


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = table(spark, sf_dir, "pages")
    return extract(pages, train(training_pages(pages, "page_id", "html")))
