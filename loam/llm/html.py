"""HTML main-text extraction by a recurrent block labeller.

A page becomes the sequence of its leaf blocks: runs of text between block-level tags.  Each block is read
as a vector of its tag path, its hashed words and a few sizes.  A bidirectional LSTM in numpy runs over the
whole sequence, so every block is labelled main text or boilerplate in the context of the entire document.
The weights are fitted on a bounded sample of pages whose structure names its parts (article, nav, ...);
those telling tags are hidden from half of the training blocks, so that words and context count too.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.llm.common import hash_sample, slices, table, with_struct, words

#: Pages that the labeller is fitted on, about, chosen by a hash of their id; pages of more characters are not fitted on.
TRAIN_PAGES, TRAIN_CHARS = 300, 200_000
PATH_DIM, WORD_DIM, SIZE_DIM, HIDDEN = 32, 64, 5, 24
EPOCHS, RATE, SEED = 8, 0.01, 5
#: Blocks of one training sequence; longer pages are fitted on in pieces, but always labelled whole.
TRAIN_BLOCKS = 256
#: Blocks labelled side by side, padding included.
SIDE_BY_SIDE = 4096
#: Steps of a long page whose inputs are held at once.
STEPS_AT_ONCE = 1024
#: Paths that a worker remembers between pages; weight of a path's names for each level further up.
REMEMBERED, FADE = 50_000, 0.8
FIELDS = ["n_blocks", "n_main", "main_text"]
#: Every branch ends at the next ``<`` outside of quotes and gives nothing back, so that a page is read once whatever it holds.
MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|textarea|svg)\b[^<>]*+>.*?(?:</\1\s*+>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9-]*+)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+(?=>)|[^<>]*+)>"
    r"|<[!?][^<>]*+>",
    re.S | re.I,
)
CLASS = re.compile(r"\b(?:class|id|role)\s*=\s*[\"']?([\w -]+)", re.I)
INLINE = frozenset("a abbr b bdi bdo big cite code data dfn em font i kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Opening one of these ends an open one of the same name.
ALONE = frozenset("p li dt dd tr td th option h1 h2 h3 h4 h5 h6".split())
MAIN, SIDE = frozenset(("article", "main")), frozenset(("nav", "footer", "header", "aside", "head", "form", ".ad", ".ads", ".nav", ".footer", ".sidebar", ".menu"))


class Path:
    """An open element and, by its parents, its tag path; equal paths of all pages are one object while they are remembered."""

    __slots__ = ("parent", "name", "marks", "main", "side", "kids", "vector", "hidden")

    def __init__(self, parent: Path | None, name: str, marks: tuple[str, ...]):
        self.parent, self.name, self.marks = parent, name, marks
        names = (name, *marks)
        self.main = parent is not None and parent.main or not MAIN.isdisjoint(names)
        self.side = parent is not None and parent.side or not SIDE.isdisjoint(names)
        self.kids: dict[tuple[str, str], Path] = {}
        self.vector: np.ndarray | None = None
        self.hidden: np.ndarray | None = None


class Paths:
    """The tree of the paths met by a worker; begun anew between pages once it has grown over REMEMBERED."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.root, self.size = Path(None, "", ()), 0

    def step(self, at: Path, name: str, attributes: str) -> Path:
        found = at.kids.get((name, attributes))
        if found is None:
            marks = tuple("." + w for x in CLASS.findall(attributes) for w in x.lower().split()) if attributes else ()
            # Elements that differ in other attributes only are the same step.
            plain = ("", name + " ".join(marks))
            found = at.kids.get(plain)
            if found is None:
                found = at.kids[plain] = Path(at, name, marks)
            if len(attributes) <= 200 and len(at.kids) < REMEMBERED:
                at.kids[name, attributes] = found
            self.size += 1
        return found


_paths = Paths()


@dataclass(slots=True)
class Block:
    at: Path
    parts: list[str] = field(default_factory=list)
    linked: int = 0

    @property
    def text(self) -> str:
        return " ".join(unescape("".join(self.parts)).split())

    @property
    def path(self) -> tuple[str, ...]:
        """Names and marks from the root down."""
        out, at = [], self.at
        while at.parent is not None:
            out.append((at.name, *at.marks))
            at = at.parent
        return tuple(n for names in reversed(out) for n in names)


def blocks_of(page: str | None) -> list[Block]:
    """Leaf blocks with text, in order; comments, scripts and styles are left out, unclosed tags end with their parent."""
    out: list[Block] = []
    if not page:
        return out
    if _paths.size > REMEMBERED:
        _paths.clear()
    stack: list[str] = []
    opened: dict[str, int] = {}
    where = _paths.root
    now: Block | None = None
    links = at = 0

    def add(text: str) -> None:
        nonlocal now
        if now is None:
            if not text.strip():
                return
            now = Block(where)
            out.append(now)
        now.parts.append(text)
        if links:
            now.linked += len(text)

    def leave() -> str:
        nonlocal where
        name = stack.pop()
        opened[name] -= 1
        where = where.parent
        return name

    for m in MARKUP.finditer(page):
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        name = m[3]
        if name is None:
            continue
        name = name.lower()
        if name in INLINE:
            if name == "a":
                links = max(0, links + (-1 if m[2] else 1))
            continue
        if name == "br":
            add(" ")
            continue
        now = None
        links = 0
        if m[2]:
            if opened.get(name):
                while leave() != name:
                    pass
        elif name not in VOID:
            if name in ALONE and stack and stack[-1] == name:
                leave()
            stack.append(name)
            opened[name] = opened.get(name, 0) + 1
            where = _paths.step(where, name, m[4])
    if at < len(page):
        add(page[at:])
    return out


@lru_cache(100_000)
def _slot(name: str, size: int) -> tuple[int, float]:
    h = 0
    for b in name.encode():
        h = (h * 1000003 ^ b) & 0xFFFFFFFFFFFFFFFF
    h ^= h >> 29
    return h % size, 1.0 if h >> 40 & 1 else -1.0


def path_vector(at: Path, hide: bool = False) -> np.ndarray:
    """Hashed names of the path, an element's own mark apart and its parents' fading by FADE a level; ``hide`` leaves out telling names."""
    kept = "hidden" if hide else "vector"
    todo = []
    while at is not None and getattr(at, kept) is None:
        todo.append(at)
        at = at.parent
    for at in reversed(todo):
        v = np.zeros(2 * PATH_DIM, np.float32)
        if at.parent is not None:
            v[:PATH_DIM] = getattr(at.parent, kept)[:PATH_DIM] * FADE
            for name in (at.name, *at.marks):
                if not hide or name not in MAIN and name not in SIDE:
                    for mark, start in ((name, 0), ("0:" + name, PATH_DIM)):
                        k, sign = _slot(mark, PATH_DIM)
                        v[start + k] += sign
        setattr(at, kept, v)
    v = getattr(todo[0] if todo else at, kept)
    return v[:PATH_DIM] + v[PATH_DIM:]


def vectors(blocks: list[Block], texts: list[str], hide: np.ndarray | None = None) -> np.ndarray:
    """Input rows of blocks; ``hide`` marks those whose telling tags are left out."""
    n = len(blocks)
    x = np.zeros((n, PATH_DIM + WORD_DIM + SIZE_DIM), np.float32)
    if not n:
        return x
    for k, b in enumerate(blocks):
        x[k, :PATH_DIM] = path_vector(b.at, hide is not None and bool(hide[k]))
    h, at = words(pa.array(texts, pa.string()))
    count = np.diff(at)
    slot = np.repeat(np.arange(n), count) * WORD_DIM + (h % np.uint64(WORD_DIM)).astype(np.int64)
    sign = np.where(h >> np.uint64(40) & np.uint64(1), 1.0, -1.0)
    bag = np.bincount(slot, sign, minlength=n * WORD_DIM).reshape(n, WORD_DIM)
    x[:, PATH_DIM : PATH_DIM + WORD_DIM] = bag / np.sqrt(np.maximum(count, 1))[:, None]
    size = np.array([len(t) for t in texts], np.float32)
    linked = np.array([b.linked for b in blocks], np.float32)
    marks = np.array([sum(map(t.count, ".,;:!?")) for t in texts], np.float32)
    x[:, -SIZE_DIM:] = np.stack([np.log1p(size) / 4, np.log1p(count) / 3, np.minimum(1, linked / np.maximum(size, 1)), np.minimum(1, marks / np.maximum(count, 1)), np.ones(n)], axis=1)
    return x


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Labeller:
    """Weights of both directions and the output layer."""

    def __init__(self, seed: int = SEED):
        rng, size = np.random.default_rng(seed), PATH_DIM + WORD_DIM + SIZE_DIM
        self.w = {}
        for d in ("f", "b"):
            self.w["x" + d] = rng.normal(0, 1 / np.sqrt(size), (size, 4 * HIDDEN)).astype(np.float32)
            self.w["h" + d] = rng.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, 4 * HIDDEN)).astype(np.float32)
        self.w["o"] = rng.normal(0, 0.1, (2 * HIDDEN + 1, 1)).astype(np.float32)

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str) -> tuple[np.ndarray, list]:
        """Hidden states (time, page, HIDDEN) of one direction, and what the gradient needs."""
        steps, n, _ = x.shape
        z_x = (x.reshape(steps * n, -1) @ self.w["x" + d]).reshape(steps, n, -1)
        h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
        states, tape = np.zeros((steps, n, HIDDEN), np.float32), []
        for t in range(steps):
            z = z_x[t] + h @ self.w["h" + d]
            i, f, o = (_sigmoid(z[:, k * HIDDEN : (k + 1) * HIDDEN] + (k == 1)) for k in range(3))
            g = np.tanh(z[:, 3 * HIDDEN :])
            m = mask[t][:, None]
            new = f * c + i * g
            tape.append((h, c, i, f, o, g, np.tanh(new), m))
            c = m * new + (1 - m) * c
            h = m * (o * np.tanh(new)) + (1 - m) * h
            states[t] = h
        return states, tape

    def _back(self, x: np.ndarray, d: str, tape: list, grad: np.ndarray, out: dict) -> None:
        steps, n, size = x.shape
        dh, dc = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
        dz_all = np.zeros((steps, n, 4 * HIDDEN), np.float32)
        for t in range(steps - 1, -1, -1):
            h, c, i, f, o, g, tc, m = tape[t]
            dh = dh + grad[t]
            new_h, new_c = dh * m, dc * m + dh * m * o * (1 - tc * tc)
            dz = np.concatenate([new_c * g * i * (1 - i), new_c * c * f * (1 - f), new_h * tc * o * (1 - o), new_c * i * (1 - g * g)], axis=1)
            dz_all[t] = dz
            out["h" + d] += h.T @ dz
            dh = dh * (1 - m) + dz @ self.w["h" + d].T
            dc = dc * (1 - m) + new_c * f
        out["x" + d] += x.reshape(steps * n, size).T @ dz_all.reshape(steps * n, -1)

    @staticmethod
    def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Inputs (time, page, size), the same with each page turned round, and the mask."""
        steps = max(map(len, pages))
        x = np.zeros((steps, len(pages), pages[0].shape[1]), np.float32)
        y, mask = x.copy(), np.zeros((steps, len(pages)), np.float32)
        for k, p in enumerate(pages):
            x[: len(p), k], y[: len(p), k], mask[: len(p), k] = p, p[::-1], 1
        return x, y, mask

    def _both(self, pages: list[np.ndarray]) -> tuple:
        x, y, mask = self.padded(pages)
        (ahead, tape_f), (behind, tape_b) = self._run(x, mask, "f"), self._run(y, mask, "b")
        turned = np.zeros_like(behind)
        for k, p in enumerate(pages):
            turned[: len(p), k] = behind[: len(p), k][::-1]
        state = np.concatenate([ahead, turned, np.ones((*mask.shape, 1), np.float32)], axis=2)
        return x, y, mask, tape_f, tape_b, state, _sigmoid(state @ self.w["o"])[:, :, 0]

    def gradient(self, pages: list[np.ndarray], labels: list[np.ndarray]) -> tuple[dict, float]:
        """Gradient of the mean log loss, and the loss."""
        x, y, mask, tape_f, tape_b, state, p = self._both(pages)
        truth = np.zeros_like(mask)
        for k, lab in enumerate(labels):
            truth[: len(lab), k] = lab
        total = mask.sum()
        loss = float(-(mask * (truth * np.log(p + 1e-7) + (1 - truth) * np.log(1 - p + 1e-7))).sum() / total)
        d = (mask * (p - truth) / total)[:, :, None].astype(np.float32)
        out = {k: np.zeros_like(v) for k, v in self.w.items()}
        out["o"] = np.tensordot(state, d, axes=([0, 1], [0, 1]))
        back = d @ self.w["o"].T
        self._back(x, "f", tape_f, back[:, :, :HIDDEN], out)
        turned = np.zeros_like(back[:, :, HIDDEN : 2 * HIDDEN])
        for k, q in enumerate(pages):
            turned[: len(q), k] = back[: len(q), k, HIDDEN : 2 * HIDDEN][::-1]
        self._back(y, "b", tape_b, turned, out)
        return out, loss

    def fit(self, pages: list[np.ndarray], labels: list[np.ndarray], epochs: int = EPOCHS, seed: int = SEED) -> Labeller:
        """Adam over batches of pages of like length."""
        rng = np.random.default_rng(seed)
        m, v, step = {k: np.zeros_like(w) for k, w in self.w.items()}, {k: np.zeros_like(w) for k, w in self.w.items()}, 0
        order = sorted(range(len(pages)), key=lambda k: len(pages[k]))
        batches = [order[k : k + 16] for k in range(0, len(order), 16)]
        for _ in range(epochs):
            for b in rng.permutation(len(batches)):
                g, _ = self.gradient([pages[k] for k in batches[b]], [labels[k] for k in batches[b]])
                step += 1
                for k in self.w:
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    v[k] = 0.99 * v[k] + 0.01 * g[k] * g[k]
                    self.w[k] -= (RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
        return self

    def scores(self, pages: list[np.ndarray]) -> np.ndarray:
        """Probabilities (time, page), both directions run together and nothing kept for a gradient.

        sigmoid(z) = (1 + tanh(z / 2)) / 2, so that one tanh a step does for all gates.
        """
        x, y, mask = self.padded(pages)
        steps, n, size = x.shape
        halves = np.full(4 * HIDDEN, 0.5, np.float32)
        halves[3 * HIDDEN :] = 1
        bias = np.zeros(4 * HIDDEN, np.float32)
        bias[HIDDEN : 2 * HIDDEN] = 1
        inputs = [(x, self.w["xf"]), (y, self.w["xb"])]
        w_h = np.stack([self.w["hf"], self.w["hb"]]) * halves
        o = np.stack([self.w["o"][:HIDDEN], self.w["o"][HIDDEN : 2 * HIDDEN]])
        h, c = np.zeros((2, n, HIDDEN), np.float32), np.zeros((2, n, HIDDEN), np.float32)
        told = np.zeros((steps, 2, n), np.float32)
        full = mask.all(axis=1)
        for begin in range(0, steps, STEPS_AT_ONCE):
            end = min(steps, begin + STEPS_AT_ONCE)
            z_x = np.stack([(a[begin:end].reshape(-1, size) @ w + bias).reshape(end - begin, n, -1) for a, w in inputs], axis=1) * halves
            for t in range(begin, end):
                z = np.tanh(z_x[t - begin] + h @ w_h)
                gates = 0.5 * z[..., : 3 * HIDDEN] + 0.5
                new = gates[..., HIDDEN : 2 * HIDDEN] * c + gates[..., :HIDDEN] * z[..., 3 * HIDDEN :]
                out = gates[..., 2 * HIDDEN :] * np.tanh(new)
                if full[t]:
                    h, c = out, new
                else:
                    m = mask[t][:, None]
                    h, c = m * out + (1 - m) * h, m * new + (1 - m) * c
                told[t] = (h @ o)[:, :, 0]
        total = told[:, 0] + self.w["o"][-1, 0]
        for k, p in enumerate(pages):
            total[: len(p), k] += told[: len(p), 1, k][::-1]
        return _sigmoid(total)

    def label(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """Probability of main text for every block; pages of like length run side by side."""
        out: list[np.ndarray] = [np.zeros(0, np.float32)] * len(pages)
        order = sorted((k for k in range(len(pages)) if len(pages[k])), key=lambda k: len(pages[k]))
        at = 0
        while at < len(order):
            end = at + 1
            while end < len(order) and len(pages[order[end]]) * (end + 1 - at) <= SIDE_BY_SIDE:
                end += 1
            some = order[at:end]
            p = self.scores([pages[k] for k in some])
            for j, k in enumerate(some):
                out[k] = p[: len(pages[k]), j]
            at = end
        return out


def weak_labels(blocks: list[Block]) -> np.ndarray:
    """1 under article or main outside of boilerplate containers, else 0."""
    return np.array([b.at.main and not b.at.side for b in blocks], np.float32)


def fit_pages(pages: list[str], seed: int = SEED) -> Labeller:
    """Fit on pages that have both kinds of block; without any, all text counts as main text."""
    rng, inputs, labels = np.random.default_rng(seed), [], []
    for page in pages:
        blocks = blocks_of(page)
        truth = weak_labels(blocks)
        if 0 < truth.sum() < len(truth):
            x = vectors(blocks, [b.text for b in blocks], rng.random(len(blocks)) < 0.5)
            inputs += [x[k : k + TRAIN_BLOCKS] for k in range(0, len(x), TRAIN_BLOCKS)]
            labels += [truth[k : k + TRAIN_BLOCKS] for k in range(0, len(x), TRAIN_BLOCKS)]
    model = Labeller(seed)
    if inputs:
        return model.fit(inputs, labels)
    model.w["o"][:] = 0
    model.w["o"][-1] = 5
    return model


def train(pages: DataFrame, rows: int = TRAIN_PAGES) -> Labeller:
    """Fit on about ``rows`` pages of up to TRAIN_CHARS characters; only those reach the driver."""
    sound = pages.where(F.col("page_id").isNotNull() & (F.length("html") <= TRAIN_CHARS))
    chosen = hash_sample(sound, "page_id", rows).select("page_id", "html").collect()
    return fit_pages([h for _, h in sorted((r["page_id"], r["html"]) for r in chosen)])


def answer(model: Labeller, pages: list[str | None]) -> list[tuple[int, int, str | None]]:
    found = [blocks_of(p) for p in pages]
    texts = [[b.text for b in bs] for bs in found]
    every = vectors([b for bs in found for b in bs], [t for ts in texts for t in ts])
    ends = np.cumsum([len(bs) for bs in found])
    scores = model.label([every[e - len(bs) : e] for bs, e in zip(found, ends)])
    out = []
    for page, ts, p in zip(pages, texts, scores):
        kept = [t for t, q in zip(ts, p) if q >= 0.5]
        out.append((len(ts), len(kept), None if page is None else "\n".join(kept)))
    return out


def main_text(html: Column, model: Labeller) -> Column:
    """Struct column (n_blocks, n_main, main_text) of a column of HTML."""
    shared = SparkSession.getActiveSession().sparkContext.broadcast(model)
    kind = pa.struct([("n_blocks", pa.int32()), ("n_main", pa.int32()), ("main_text", pa.string())])

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for pages in batches:
            rows = [r for piece in slices(pages) for r in answer(shared.value, piece.to_pylist())]
            yield pa.array([dict(zip(FIELDS, r)) for r in rows], kind)

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "n_blocks int, n_main int, main_text string")(html)


def extract_main_text(pages: DataFrame, model: Labeller) -> DataFrame:
    """Append n_blocks, n_main and main_text (the main blocks, one a line, white space squeezed) to every row.

    Null HTML has no blocks and null text; empty HTML, or HTML without text, has no blocks and an empty
    text.  Input without tags is one block.  Whole pages are labelled whatever their length; repeated rows
    get equal answers and stay.  Other columns stay, except those with an output's name, which it
    replaces.  An empty table gives an empty table.
    """
    return with_struct(pages, main_text(F.col("html"), model), FIELDS)


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "html")
    return extract_main_text(pages, train(pages)).drop("html")
