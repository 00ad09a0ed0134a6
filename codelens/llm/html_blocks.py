"""Main text of web pages: a bidirectional LSTM in numpy labels every block of a page."""

from __future__ import annotations

import html as entities
import io
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codelens.llm.common import stored, worker_state

# Element and class names of HTML.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("head iframe math noscript object script select style svg template textarea title".split())
MAIN_TAGS = frozenset("article main".split())
MAIN_NAMES = frozenset("article articlebody body-text content entry entry-content main post post-body story story-body text".split())
OTHER_TAGS = frozenset("aside button dialog footer form header menu nav option".split())
OTHER_NAMES = frozenset(
    "ad ads advert advertisement banner breadcrumb breadcrumbs comment comments cookie cookies disclaimer footer header menu meta nav navbar "
    "navigation newsletter notice pager pagination popup promo related share sharing sidebar social sponsor sponsored subscribe toolbar widget".split()
)

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?:!|\?)[^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S
)
_NAME = re.compile(r"(?:^|\s)(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I | re.S)
_CLOSED_BY = {"p": INLINE | {"p"}, "li": INLINE | {"li", "p"}, "td": INLINE | {"td", "th", "p"}, "tr": INLINE | {"td", "th", "tr", "p"}}
_SPACE = re.compile(r"\s+")


@dataclass
class Block:
    text: str
    path: tuple[str, ...]
    link_chars: int


def blocks_of(page: str) -> list[Block]:
    """Texts between block-level tags in page order, with the tags and names above each.

    Inline tags part nothing; comments, and what ``UNSEEN`` elements hold, are
    dropped; an element that is never closed lasts to the end of the one around it.
    """
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    parts: list[str] = []
    linked = at = links = 0
    end = len(page)

    def flush() -> None:
        nonlocal linked
        text = _SPACE.sub(" ", entities.unescape("".join(parts))).strip()
        if text:
            out.append(Block(text, tuple(x for tag, names in stack if tag not in INLINE for x in (tag, *names)), linked))
        parts.clear()
        linked = 0

    while at < end:
        found = _TOKEN.search(page, at)
        text = page[at : found.start()] if found else page[at:]
        if text:
            parts.append(text)
            linked += len(text) if links else 0
        if not found:
            break
        at = found.end()
        if found[2] is None:
            continue
        tag, closing = found[2].lower(), bool(found[1])
        if tag in UNSEEN and not closing:
            # raw or unseen content: up to its end tag, or nothing more if that is missing and the page holds one element only
            if not found[0].endswith("/>"):
                close = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                at = close.end() if close else (at if tag == "head" else end)
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag not in INLINE:
            flush()
        if closing:
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), -1)
            if depth >= 0 and not (tag in INLINE and any(t not in INLINE for t, _ in stack[depth + 1 :])):
                del stack[depth:]
        else:
            drop = _CLOSED_BY.get(tag, INLINE if tag not in INLINE else frozenset())
            while stack and stack[-1][0] in drop:
                stack.pop()
            if tag not in VOID:
                names = tuple("." + w.lower() for m in _NAME.finditer(found[3]) for w in re.split(r"[\s_]+", m[1] or m[2] or m[3] or "") if w)
                stack.append((tag, names))
        links = sum(t == "a" for t, _ in stack)
    flush()
    return out


def rule_label(path: tuple[str, ...]) -> bool | None:
    """What tags alone say of a block: main, other, or None if they are silent. Used for training labels only."""
    names = [x[1:] for x in path if x[0] == "."]
    if any(t in OTHER_TAGS for t in path) or any(n in OTHER_NAMES or OTHER_NAMES & set(n.split("-")) for n in names):
        return False
    if any(t in MAIN_TAGS for t in path) or any(n in MAIN_NAMES for n in names):
        return True
    return None


@dataclass(frozen=True)
class Settings:
    """``pages`` bounds the pages that are learned from; each is also shown in ``variants`` other layouts."""

    pages: int = 400
    variants: int = 3
    path_rows: int = 2048
    word_rows: int = 4096
    path_size: int = 16
    word_size: int = 8
    hidden: int = 16
    epochs: int = 6
    batch: int = 32
    rate: float = 0.01
    seed: int = 5


NUMBERS = 6


def features(blocks: list[Block], s: Settings) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Hashed path and word rows, and numbers (length, links, place, punctuation, digits, last depth) of each block."""
    paths, words = [], []
    numbers = np.zeros((len(blocks), NUMBERS), np.float32)
    for i, b in enumerate(blocks):
        last = b.path[-3:]
        keys = [*b.path, *(f"<{j}{x}" for j, x in enumerate(reversed(last)))]
        keys += [f"-{part}" for x in b.path if x[0] == "." for part in x[1:].split("-")]
        paths.append(np.array([zlib.crc32(k.encode()) % s.path_rows for k in keys] or [0], np.int64))
        ws = b.text.lower().split()
        words.append(np.array([zlib.crc32(w.encode()) % s.word_rows for w in ws] or [0], np.int64))
        n = len(b.text)
        numbers[i] = (
            min(np.log1p(len(ws)) / 5, 2), min(b.link_chars / n, 1), i / max(1, len(blocks) - 1),
            min(10 * sum(b.text.count(c) for c in ".,;!?") / n, 2), min(5 * sum(c.isdigit() for c in b.text[:400]) / min(n, 400), 2), len(b.path) / 10,
        )
    return paths, words, numbers


class Labeller:
    """Path and word vectors -> LSTM forwards and backwards over the page -> one logistic unit per block."""

    KEYS = ("path", "word", "wf", "uf", "bf", "wb", "ub", "bb", "out", "out_bias")

    def __init__(self, settings: Settings, values: dict[str, np.ndarray]):
        self.s, self.v = settings, values

    @staticmethod
    def fresh(s: Settings) -> Labeller:
        rng = np.random.default_rng(s.seed)
        size, h = s.path_size + s.word_size + NUMBERS, s.hidden

        def r(*shape, scale):
            return rng.normal(0, scale, shape).astype(np.float32)

        bias = np.zeros(4 * h, np.float32)
        bias[h : 2 * h] = 1
        v = {"path": r(s.path_rows, s.path_size, scale=0.3), "word": r(s.word_rows, s.word_size, scale=0.1)}
        for d in "fb":
            v |= {f"w{d}": r(size, 4 * h, scale=size**-0.5), f"u{d}": r(h, 4 * h, scale=h**-0.5), f"b{d}": bias.copy()}
        return Labeller(s, v | {"out": r(2 * h, scale=0.3), "out_bias": np.zeros(1, np.float32)})

    def saved(self) -> bytes:
        buffer = io.BytesIO()
        np.savez(buffer, **self.v)
        return buffer.getvalue()

    @staticmethod
    def loaded(blob: bytes, s: Settings) -> Labeller:
        with np.load(io.BytesIO(blob)) as z:
            return Labeller(s, {k: z[k] for k in Labeller.KEYS})

    def inputs(self, pages: list[tuple]) -> tuple[np.ndarray, np.ndarray, dict]:
        """(time, page, size), mask; pages are padded at the end."""
        sizes = np.array([len(p[2]) for p in pages])
        steps, n = int(sizes.max(initial=1)), len(pages)
        x = np.zeros((steps, n, self.s.path_size + self.s.word_size + NUMBERS), np.float32)
        mask = np.arange(steps)[:, None] < sizes[None]
        where = {}
        place = np.concatenate([np.arange(k) * n + i for i, k in enumerate(sizes)]).astype(np.int64) if sizes.sum() else np.zeros(0, np.int64)
        flat = x.reshape(steps * n, -1)
        if len(place):
            begin = 0
            for key, which, size in (("path", 0, self.s.path_size), ("word", 1, self.s.word_size)):
                rows = [r for p in pages for r in p[which]]
                lengths = np.array([len(r) for r in rows])
                ids = np.concatenate(rows)
                first = np.cumsum(lengths) - lengths
                total = np.add.reduceat(self.v[key][ids], first, axis=0)
                share = (lengths**-0.5 if key == "path" else 1 / lengths).astype(np.float32)
                flat[place, begin : begin + size] = total * share[:, None]
                where[key] = (ids, np.repeat(place, lengths), np.repeat(share, lengths), begin, size)
                begin += size
            flat[place, begin:] = np.concatenate([p[2] for p in pages])
        return x, mask, where

    def run(self, x: np.ndarray, mask: np.ndarray, d: str, keep: bool = False):
        steps, n, _ = x.shape
        h = self.s.hidden
        z_in = x @ self.v[f"w{d}"] + self.v[f"b{d}"]
        out = np.zeros((steps, n, h), np.float32)
        state, cell = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
        tape = []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = z_in[t] + state @ self.v[f"u{d}"]
            gates = 1 / (1 + np.exp(-z[:, : 3 * h]))
            i, f, o, g = gates[:, :h], gates[:, h : 2 * h], gates[:, 2 * h :], np.tanh(z[:, 3 * h :])
            m = mask[t][:, None]
            new = np.where(m, f * cell + i * g, cell)
            tanh = np.tanh(new)
            if keep:
                tape.append((t, i, f, o, g, cell, tanh, state))
            state = np.where(m, o * tanh, state)
            cell = new
            out[t] = state
        return out, tape

    def probabilities(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        both = np.concatenate([self.run(x, mask, d)[0] for d in "fb"], axis=2)
        return 1 / (1 + np.exp(-np.clip(both @ self.v["out"] + self.v["out_bias"], -30, 30)))

    def gradients(self, pages: list[tuple], labels: list[np.ndarray]) -> dict[str, np.ndarray]:
        """Of the mean logistic loss over labelled blocks (label -1: none)."""
        x, mask, where = self.inputs(pages)
        steps, n, _ = x.shape
        h = self.s.hidden
        runs = {d: self.run(x, mask, d, keep=True) for d in "fb"}
        both = np.concatenate([runs["f"][0], runs["b"][0]], axis=2)
        p = 1 / (1 + np.exp(-np.clip(both @ self.v["out"] + self.v["out_bias"], -30, 30)))
        truth = np.full((steps, n), -1.0, np.float32)
        for i, y in enumerate(labels):
            truth[: len(y), i] = y
        known = truth >= 0
        error = np.where(known, p - truth, 0).astype(np.float32) / max(1, known.sum())
        g = {"out": np.einsum("tn,tnh->h", error, both), "out_bias": np.array([error.sum()], np.float32)}
        g_x = np.zeros_like(x)
        for k, d in enumerate("fb"):
            g_out = error[:, :, None] * self.v["out"][k * h : (k + 1) * h]
            g_z_all = np.zeros((steps, n, 4 * h), np.float32)
            g_u = np.zeros_like(self.v[f"u{d}"])
            g_state, g_cell = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
            for t, i, f, o, gate, cell, tanh, before in reversed(runs[d][1]):
                m = mask[t][:, None]
                g_h = g_state + g_out[t] * m
                g_c = g_cell + np.where(m, g_h * o * (1 - tanh**2), 0)
                g_z = np.where(m, np.hstack([g_c * gate * i * (1 - i), g_c * cell * f * (1 - f), g_h * tanh * o * (1 - o), g_c * i * (1 - gate**2)]), 0)
                g_z_all[t] = g_z
                g_u += before.T @ g_z
                g_state = np.where(m, g_z @ self.v[f"u{d}"].T, g_h)
                g_cell = np.where(m, g_c * f, g_c)
            g[f"u{d}"] = g_u
            g[f"w{d}"] = np.einsum("tns,tnz->sz", x, g_z_all)
            g[f"b{d}"] = g_z_all.sum((0, 1))
            g_x += g_z_all @ self.v[f"w{d}"].T
        flat = g_x.reshape(steps * n, -1)
        for key in ("path", "word"):
            g[key] = np.zeros_like(self.v[key])
            if key in where:
                ids, place, share, begin, size = where[key]
                np.add.at(g[key], ids, flat[place, begin : begin + size] * share[:, None])
        return g


def train(pages: list[list[Block]], labels: list[np.ndarray], s: Settings) -> Labeller:
    """Adam over batches of pages of like length."""
    net = Labeller.fresh(s)
    made = [features(p, s) for p in pages]
    rng = np.random.default_rng(s.seed + 1)
    mean = {k: np.zeros_like(v) for k, v in net.v.items()}
    square = {k: np.zeros_like(v) for k, v in net.v.items()}
    order = sorted(range(len(pages)), key=lambda i: len(pages[i]))
    batches = [order[i : i + s.batch] for i in range(0, len(order), s.batch)]
    step = 0
    for epoch in range(s.epochs):
        for k in rng.permutation(len(batches)):
            g = net.gradients([made[i] for i in batches[k]], [labels[i] for i in batches[k]])
            step += 1
            rate = s.rate * (0.3 if epoch >= s.epochs - 2 else 1)
            for key, v in net.v.items():
                mean[key] = 0.9 * mean[key] + 0.1 * g[key]
                square[key] = 0.99 * square[key] + 0.01 * g[key] ** 2
                v -= rate * (mean[key] / (1 - 0.9**step)) / (np.sqrt(square[key] / (1 - 0.99**step)) + 1e-6)
    return net


# Layouts in which training pages are shown, as paths around main and other blocks.
MAIN_LAYOUTS = (
    "article", "main", "main article", "div .content", "div .post", "div .entry-content", "div .main", "section .story", "div .article",
    "div .page div .content", "div .wrapper article", "article div .post-body", "div .container main div .text", "td .content", "div .articlebody",
)
MAIN_LEAVES = ("p", "p", "p", "p", "p", "h1", "h2", "h3", "blockquote p", "ul li", "ol li", "div", "section p", "pre", "table tr td", "figure figcaption", "")
OTHER_LAYOUTS = (
    "nav ul li", "nav", "header", "header div .logo", "header nav ul li", "footer", "footer p", "footer ul li", "aside p", "aside ul li", "aside .sidebar div",
    "div .sidebar ul li", "div .sidebar p", "div .ad", "div .ads", "div .advert", "div .banner p", "div .promo", "div .sponsored p", "div .cookie p",
    "div .cookie-notice", "div .notice p", "div .notice", "form", "form p", "form div", "section .comments div .comment p", "div .comments ul li", "div .comment p",
    "section .comments h3", "div .related ul li", "div .menu ul li", "ul .menu li", "div .breadcrumbs", "div .share", "div .social ul li", "div .newsletter form",
    "div .popup p", "div .footer", "div .header", "div .nav ul li", "div .widget p", "div .pagination", "div .subscribe p", "section .related p", "div .disclaimer",
)
WITHIN_MAIN = ("aside p", "div .ad", "div .advert p", "div .related ul li", "form p", "div .share", "section .comments p", "div .comments div .comment p", "div .notice", "footer p", "header p")


def shown_anew(blocks: list[Block], labels: np.ndarray, rng: np.random.Generator) -> tuple[list[Block], np.ndarray]:
    """The same texts in another layout: other blocks before, after and within the main ones."""
    main = [b for b, y in zip(blocks, labels, strict=True) if y == 1]
    other = [b for b, y in zip(blocks, labels, strict=True) if y == 0]
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    above = ["html", "body", *pick(["", "", "div", "div .page", "div .site div .row"]).split()]
    out: list[tuple[Block, int]] = []

    def others(n: int, around: list[str], layouts) -> None:
        for _ in range(n):
            path = [*around, *pick(layouts).split()]
            for _ in range(int(rng.integers(1, 6)) if path[-1] == "li" else 1):
                source = pick(main) if main and (not other or rng.random() < 0.5) else pick(other) if other else None
                if source:
                    words = source.text.split()
                    size = len(words) if rng.random() < 0.4 else int(rng.integers(1, 12))
                    link = path[-1] == "li" or rng.random() < 0.3
                    text = " ".join(words[:size])
                    out.append((Block(text, tuple(path), len(text) if link else 0), 0))

    others(int(rng.integers(0, 5)), above, OTHER_LAYOUTS)
    around = [*above, *pick(MAIN_LAYOUTS).split()]
    for b in main:
        out.append((Block(b.text, (*around, *pick(MAIN_LEAVES).split()), b.link_chars), 1))
        if rng.random() < 0.08:
            others(1, around, WITHIN_MAIN)
    others(int(rng.integers(0, 5)), above, OTHER_LAYOUTS)
    return [b for b, _ in out], np.array([y for _, y in out], np.float32)


def _fit(batches, s: Settings):
    pages, labels = [], []
    rng = np.random.default_rng(s.seed + 2)
    rows = sorted((k, h) for batch in batches for k, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
    for _, page in rows:
        blocks = blocks_of(page)
        y = np.array([{True: 1, False: 0, None: -1}[rule_label(b.path)] for b in blocks], np.float32)
        if not (y >= 0).any():
            continue
        pages.append(blocks)
        labels.append(y)
        for _ in range(s.variants):
            b, z = shown_anew(blocks, y, rng)
            if b:
                pages.append(b)
                labels.append(z)
    yield pa.RecordBatch.from_pydict({"model": pa.array([train(pages, labels, s).saved()], pa.binary())})


def fit(pages: DataFrame, settings: Settings = Settings(), key_col: str = "page_id", html_col: str = "html") -> bytes:
    """A labeller learned in one task from at most about ``settings.pages`` pages, chosen by a hash of their id.

    Training labels are what tags and names say where they say it (``rule_label``);
    each page is also shown in layouts drawn from the fixed lists above, so that the
    network meets more kinds of pages than the sample holds.
    """
    n = pages.count()
    place = F.pmod(F.xxhash64(key_col, F.lit(settings.seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = pages.where(F.col(html_col).isNotNull() & (F.length(html_col) < 200_000)).where(place < min(1.0, settings.pages / max(1, n)))
    sample = stored(sample.select(F.xxhash64(key_col, html_col).alias("key"), F.col(html_col).alias("html")), "html-sample")
    found = sample.repartition(1).mapInArrow(lambda b: _fit(b, settings), "model binary").collect()
    return bytes(found[0]["model"]) if found else Labeller.fresh(settings).saved()


def labelled(pages: list[str], net: Labeller, most_blocks: int = 20_000) -> Iterator[tuple[int, list[Block], np.ndarray]]:
    """(place in ``pages``, blocks, probability that each is main text); pages of like length run together."""
    cut = [blocks_of(p) for p in pages]
    order = sorted(range(len(pages)), key=lambda i: len(cut[i]))
    run: list[int] = []
    for j, i in enumerate(order):
        run.append(i)
        following = len(cut[order[j + 1]]) if j + 1 < len(order) else 0
        if following * (len(run) + 1) > most_blocks or len(run) == 64 or j + 1 == len(order):
            x, mask, _ = net.inputs([features(cut[k], net.s) for k in run])
            p = net.probabilities(x, mask)
            for column, k in enumerate(run):
                yield k, cut[k], p[: len(cut[k]), column]
            run = []


def extract(pages: DataFrame, model: bytes, settings: Settings = Settings(), html_col: str = "html", out_col: str = "text") -> DataFrame:
    """``pages`` without the html, with the main text: blocks labelled main, in order, parted by a line feed.

    A null or empty page, or one without main blocks, gives an empty text. Every
    page is read whole; a task holds the blocks of one run of pages at a time.
    Repeated rows are extracted each; other columns pass through (an existing
    ``out_col`` is replaced). An empty table gives no rows.
    """
    shipped = pages.sparkSession.sparkContext.broadcast(model)
    kept = [f for f in pages.schema.fields if f.name not in (html_col, out_col)]

    def run(batches):
        state, key = worker_state("html"), ("labeller", hash(shipped.value))
        if key not in state:
            state[key] = Labeller.loaded(shipped.value, settings)
        net = state[key]
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(html_col))
            for first in range(0, len(column), 256):
                values = [x or "" for x in column.slice(first, 256).to_pylist()]
                texts = [""] * len(values)
                for i, blocks, p in labelled(values, net):
                    texts[i] = "\n".join(b.text for b, q in zip(blocks, p, strict=True) if q >= 0.5)
                rest = batch.slice(first, len(values))
                arrays = [rest.column(rest.schema.get_field_index(f.name)) for f in kept]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(texts, pa.string())], names=[*(f.name for f in kept), out_col])

    schema = T.StructType([*kept, T.StructField(out_col, T.StringType())])
    return pages.select(*[f.name for f in kept], html_col).mapInArrow(run, schema)
