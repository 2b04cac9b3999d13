"""Main text of web pages by a linear-chain conditional random field.

Method. A page is cut into its leaf blocks in order. Each block has features of the elements
around it (tags, words of their class, id and role) and of its text (length, punctuation, share of links).
A linear-chain CRF with two labels is trained on labelled pages (html_training) by maximum
likelihood with a Gaussian prior, and each page is decoded by Viterbi; blocks labelled as article make the
text. The model is a few hundred numbers, trained once per driver in about a second from a fixed seed.

Defined results: null, empty and text-less pages give an empty text; scripts, styles, comments of the
markup, titles and forms' fields have no text, and do not split the block that they are in; hidden elements and what is shown without
scripts are blocks like others, with a feature that says so; a br is white space within its block; a page of any
length is read whole, one page at a time, in time and memory that grow with its length; equal rows get equal texts; an empty table gives an empty
table; columns of the input that have an output's name are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eddyline.llm import base
from eddyline.llm.html_blocks import NAMED, Block, blocks
from eddyline.llm.html_training import MARK, labelled_pages

TRAINING_PAGES, SEED = 800, 11
#: Training pages of more blocks are left out, as they are padded to one length.
MOST_BLOCKS = 50


def _text_features(text: str, linked: int) -> list[str]:
    n = len(text)
    words = text.count(" ") + 1
    links = linked / n
    return [
        "bias",
        f"words:{min(6, words.bit_length())}",
        f"links:{0 if not links else 1 if links < 0.3 else 2 if links < 0.8 else 3}",
        f"ends:{'.' if text[-1] in '.!?:;…»\"”' else 'x'}",
        f"stops:{min(4, text.count('. '))}",
        *(["copyright"] if "©" in text[:40] else []),
    ]


def features(block: Block) -> list[str]:
    around = block.around
    leaf = next(f for f in around if f[:5] == "leaf:")
    out = [*(around - {NAMED}), *_text_features(block.text, block.linked)]
    out += [f"{leaf}+{x}" for x in out[-5:]]
    if "in:article" not in around and "in:main" not in around and NAMED not in around:
        out.append("plain")
    return out


@dataclass
class Model:
    index: dict[str, int]
    weights: np.ndarray  # of label 1; label 0 has none
    moves: np.ndarray  # moves[a, b]: from label a to b
    start: np.ndarray

    @cached_property
    def known(self) -> frozenset[str]:
        return frozenset(self.index)

    def decode(self, found: list[Block]) -> list[int]:
        """The most probable labels (Viterbi)."""
        if not found:
            return []
        get, w = self.index.get, self.weights
        (m00, m01), (m10, m11) = self.moves.tolist()
        back: list[tuple[int, int]] = []
        a = b = 0.0
        for k, x in enumerate(found):
            e = sum(w[i] for f in features(x) if (i := get(f)) is not None)
            if not k:
                a, b = self.start[0], self.start[1] + e
            else:
                stay0, stay1 = a + m00 >= b + m10, b + m11 >= a + m01
                back.append((0 if stay0 else 1, 1 if stay1 else 0))
                a, b = max(a + m00, b + m10), max(b + m11, a + m01) + e
        labels = [int(b > a)]
        for from0, from1 in reversed(back):
            labels.append(from1 if labels[-1] else from0)
        return labels[::-1]

    def text(self, page: str | None) -> str:
        found = blocks(page or "", self.known)
        return "\n".join(x.text for x, y in zip(found, self.decode(found), strict=True) if y)


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis=axis, keepdims=True))).squeeze(axis)


def _expectations(emit: np.ndarray, length: np.ndarray, moves: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of label 1, and expected counts of the moves, over pages padded to one length. emit: page x place."""
    pages, t = emit.shape
    two = np.stack([np.zeros_like(emit), emit], axis=2)
    inside = np.arange(t)[None, :] < length[:, None]
    fwd, bwd = np.zeros((pages, t, 2)), np.zeros((pages, t, 2))
    fwd[:, 0] = start + two[:, 0]
    for k in range(1, t):
        step = _log_sum(fwd[:, k - 1, :, None] + moves, 1) + two[:, k]
        fwd[:, k] = np.where(inside[:, k, None], step, fwd[:, k - 1])
    for k in range(t - 2, -1, -1):
        step = _log_sum(moves + (two[:, k + 1] + bwd[:, k + 1])[:, None, :], 2)
        bwd[:, k] = np.where(inside[:, k + 1, None], step, 0)
    z = _log_sum(fwd[:, -1], 1)
    marginal = np.exp(fwd[..., 1] + bwd[..., 1] - z[:, None]) * inside
    pair = fwd[:, :-1, :, None] + moves + (two[:, 1:] + bwd[:, 1:])[:, :, None, :] - z[:, None, None, None]
    return marginal, (np.exp(pair) * inside[:, 1:, None, None]).sum(axis=(0, 1))


def train(pages: list[str], rounds: int = 160, rate: float = 0.08, prior: float = 1e-3) -> Model:
    """Maximum likelihood with a Gaussian prior, by Adam. pages: labelled by MARK."""
    cut, gold = [], []
    for page in pages:
        if 0 < len(found := blocks(page)) <= MOST_BLOCKS:
            gold.append([int(b.text.startswith(MARK)) for b in found])
            cut.append([b._replace(text=b.text.removeprefix(MARK).strip() or "x") for b in found])
    count: dict[str, int] = {}
    listed = [[features(b) for b in page] for page in cut]
    for page in listed:
        for fs in page:
            for f in fs:
                count[f] = count.get(f, 0) + 1
    index = {f: i for i, f in enumerate(sorted(f for f, n in count.items() if n >= 5))}
    length = np.array([len(p) for p in cut])
    shape = (len(cut), int(length.max()))
    y = np.zeros(shape)
    rows, cols = [], []
    for p, page in enumerate(listed):
        y[p, : len(page)] = gold[p]
        for k, fs in enumerate(page):
            these = [index[f] for f in fs if f in index]
            rows += [p * shape[1] + k] * len(these)
            cols += these
    rows, cols = np.array(rows), np.array(cols)
    size = len(index)
    theta = np.zeros(size + 6)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    real = np.zeros((2, 2))
    for g in gold:
        for a, b in zip(g, g[1:], strict=False):
            real[a, b] += 1
    first = np.array([sum(1 for g in gold if g[0] == a) for a in (0, 1)])
    for t in range(1, rounds + 1):
        moves, start = theta[size : size + 4].reshape(2, 2), theta[size + 4 :]
        emit = np.bincount(rows, theta[cols], minlength=y.size).reshape(shape)
        marginal, pairs = _expectations(emit, length, moves, start)
        begun = marginal[:, 0].sum()
        g = np.concatenate([np.bincount(cols, (y - marginal).ravel()[rows], minlength=size), (real - pairs).ravel(), first - np.array([len(cut) - begun, begun])])
        g = g / len(cut) - prior * theta
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta + rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Model(index, theta[:size].copy(), theta[size : size + 4].reshape(2, 2).copy(), theta[size + 4 :].copy())


@lru_cache(4)
def default_model(pages: int = TRAINING_PAGES, seed: int = SEED) -> Model:
    return train(labelled_pages(pages, seed))


def extract(pages: DataFrame, model: Model | None = None, html: str = "html", text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """Adds the main text of each page and its code points. The markup stays unless it has an output's name."""
    base.ship(pages.sparkSession)
    held = pages.sparkSession.sparkContext.broadcast(model or default_model())

    @F.arrow_udf("string")
    def texts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for array in batches:
            yield pa.array([held.value.text(page.as_py()) for page in array], pa.string())

    own = base.spare(pages, "__html")
    out = base.fresh(pages.withColumn(own, F.col(html)), text, n_chars).withColumn(text, texts(own)).drop(own)
    return out.withColumn(n_chars, F.char_length(text).cast("long"))


def op10_html_text(spark, sf_dir: str) -> DataFrame:
    return extract(base.read(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")
