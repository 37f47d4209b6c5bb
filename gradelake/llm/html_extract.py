"""Main text of pages by a linear-chain conditional random field over DOM leaf blocks.

A page is a sequence of leaf blocks; each is in the article or not. Features are the tags and names above a block, the shape and wording of its
text, the heading it stands under, and how much of the page's text its element holds. The weights and the transitions are fitted by gradient
steps on the likelihood of labelled pages, and a page is decoded by Viterbi.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradelake.llm.common import aside, quoted
from gradelake.llm.html_blocks import Block, blocks
from gradelake.llm.html_training import CUES, NAMES, RECIPES, labelled_page

#: Labelled pages that the model is fitted on: the bound of its training sample.
TRAIN_PAGES = 800
STEPS = 110
RATE = 0.15
PENALTY = 3e-4
LONGEST = 80
#: Names that count: all parts of names that the labelled pages give to things.
VOCABULARY = frozenset(p for x in NAMES.values() for p in x.split()) | {"banner", "contentinfo", "complementary", "dialog", "entry", "region", "wrap"}
_CUE = {w: kind for kind, words in reversed(CUES.items()) for w in words.split()}
_WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)?")
_CLOCK = re.compile(r"\b\d{1,2}:\d\d\b|\bago\b")
#: Longer texts are told by their length, not by single words.
CUE_CHARS = 240


def cues(text: str) -> set[str]:
    if len(text) > CUE_CHARS:
        return set()
    return {_CUE[w] for w in _WORD.findall(text.lower()) if w in _CUE}


def page_features(page: list[Block]) -> list[list[str]]:
    """The features of each block of a page."""
    held: dict[int, int] = {}
    for b in page:
        held[b.holder] = held.get(b.holder, 0) + len(b.text) - b.linked
    most = max(held.values(), default=0)
    out, under = [], "none"
    for b in page:
        words = b.text.count(" ") + 1
        size = "1" if words == 1 else "2-4" if words < 5 else "5-10" if words < 11 else "11-25" if words < 26 else "26+"
        share = b.linked / len(b.text)
        links = "none" if share == 0 else "some" if share < 0.5 else "most"
        said = cues(b.text)
        heading = b.leaf[0] == "h" and b.leaf[1:].isdigit() or words < 6
        if heading and (said or b.leaf[0] == "h"):
            under = "comments" if "comments" in said else "sidebar" if "sidebar" in said else "other" if said else "none"
        own = held[b.holder] / most if most else 0
        part = "most" if own > 0.99 else "much" if own > 0.4 else "some" if own > 0.1 else "little"
        stop = "full" if b.text[-1] in ".!?…" else "none" if b.text[-1].isalnum() else "other"
        f = ["bias", f"size {size}", f"links {links}", f"links {links} {size}", f"leaf {b.leaf}", f"leaf {b.leaf} {size}", f"stop {stop} {size}", f"part {part}", f"part {part} {size}", f"under {under} {size}"]
        f.append(f"mark {'©' in b.text}")
        f.append(f"clock {words < 12 and bool(_CLOCK.search(b.text))}")
        short = "short" if words < 6 else "longer"
        f += [f"cue {c} {short}" for c in said] + [f"tag {t}" for t in b.tags] + [f"name {n}" for n in b.names]
        out.append(f)
    return out


class Model:
    """weights: of each feature for both labels; start and step: of the first label and of label after label."""

    def __init__(self, index: dict[str, int], weights: np.ndarray, start: np.ndarray, step: np.ndarray):
        self.index, self.weights, self.start, self.step = index, weights, start, step

    def scores(self, page: list[Block]) -> np.ndarray:
        out = np.zeros((len(page), 2))
        for i, own in enumerate(page_features(page)):
            out[i] = self.weights[[self.index[f] for f in own if f in self.index]].sum(0)
        return out

    def decode(self, page: list[Block]) -> list[bool]:
        """The most probable labels of the whole sequence (Viterbi)."""
        if not page:
            return []
        s = self.scores(page).tolist()
        (a, b), (c, d) = self.step.tolist()
        x, y = s[0][0] + float(self.start[0]), s[0][1] + float(self.start[1])
        back = []
        for p, q in s[1:]:
            from_x, from_y = x + a >= y + c, x + b >= y + d
            back.append((not from_x, not from_y))
            x, y = (x + a if from_x else y + c) + p, (x + b if from_y else y + d) + q
        at = y > x
        out = [at]
        for u, v in reversed(back):
            at = v if at else u
            out.append(at)
        return out[::-1]


def fit(pages: list[tuple[list[Block], list[bool]]], steps: int = STEPS, rate: float = RATE, penalty: float = PENALTY) -> Model:
    """Maximum penalised likelihood by Adam steps; all sequences advance together, the longest first. Pages of more than LONGEST blocks are no help."""
    pages = sorted((p for p in pages if 0 < len(p[0]) <= LONGEST), key=lambda p: -len(p[0]))
    index: dict[str, int] = {}
    rows = [[index.setdefault(f, len(index)) for f in own] for page, _ in pages for own in page_features(page)]
    x = np.zeros((len(rows), len(index)), np.float32)
    for i, own in enumerate(rows):
        x[i, own] = 1
    length = np.array([len(p) for p, _ in pages])
    n, longest = len(pages), int(length[0])
    at = (np.repeat(np.arange(n), length), np.concatenate([np.arange(k) for k in length]))
    running = [int((length > t).sum()) for t in range(longest)]
    label = np.zeros((n, longest), int)
    label[at] = [k for _, labels in pages for k in labels]
    one = np.eye(2)[label[at]]
    seen = np.zeros((2, 2))
    for t in range(longest - 1):
        np.add.at(seen, (label[: running[t + 1], t], label[: running[t + 1], t + 1]), 1)
    params = [np.zeros((len(index), 2)), np.zeros(2), np.zeros((2, 2))]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for k in range(1, steps + 1):
        w, start, step = params
        s, ahead, behind = (np.zeros((n, longest, 2)) for _ in range(3))
        s[at] = x @ w.astype(np.float32)
        ahead[:, 0] = s[:, 0] + start
        for t in range(1, longest):
            m = running[t]
            before = ahead[:m, t - 1]
            ahead[:m, t] = np.logaddexp(before[:, :1] + step[0], before[:, 1:] + step[1]) + s[:m, t]
        end = ahead[np.arange(n), length - 1]
        total = np.logaddexp(end[:, 0], end[:, 1])
        joint = np.zeros((2, 2))
        for t in range(longest - 2, -1, -1):
            m = running[t + 1]
            onward = s[:m, t + 1] + behind[:m, t + 1]
            behind[:m, t] = np.logaddexp(step[:, 0] + onward[:, :1], step[:, 1] + onward[:, 1:])
            joint += np.exp(ahead[:m, t, :, None] + step + onward[:, None, :] - total[:m, None, None]).sum(0)
        differ = one - np.exp(ahead[at] + behind[at] - total[at[0], None])
        grads = [(x.T @ differ.astype(np.float32)).astype(float), differ[at[1] == 0].sum(0), seen - joint]
        for i, g in enumerate(grads):
            g = g / n - penalty * params[i]
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.999 * second[i] + 0.001 * g * g
            params[i] = params[i] + rate * (first[i] / (1 - 0.9**k)) / (np.sqrt(second[i] / (1 - 0.999**k)) + 1e-8)
    return Model(index, *params)


def labelled(seed: int, recipe: str | None = None) -> tuple[list[Block], list[str]]:
    """The blocks of a labelled page and the kind of each."""
    page, kinds = labelled_page(seed, recipe)
    found = blocks(page, VOCABULARY)
    return found, [kinds.get(re.sub("^© (site · )?", "", b.text), kinds.get(b.text, "mixed")) for b in found]


@functools.cache
def trained(n_pages: int = TRAIN_PAGES, recipes: tuple[str, ...] = tuple(RECIPES)) -> Model:
    """The model of `n_pages` labelled pages by `recipes` in turn, the same wherever it is fitted."""
    pages = [labelled(k, recipes[k % len(recipes)]) for k in range(n_pages)]
    return fit([(found, [k == "article" for k in kinds]) for found, kinds in pages])


def main_text(page: str | None, model: Model) -> str:
    found = blocks(page, VOCABULARY)
    return " ".join(b.text for b, keep in zip(found, model.decode(found), strict=True) if keep)


def extract(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """`pages` without html, with text: the article of the whole html. A null or empty html, or one without an article, gives ''.

    Other columns pass through whatever their names, an old text is replaced. Equal rows give equal rows, no rows none.
    """
    kept = [c for c in pages.columns if c not in ("html", "text")]
    own, back = aside(pages.select(*quoted(kept), "html"), ("html",))
    names = own.columns[:-1]
    sent = pages.sparkSession.sparkContext.broadcast(model or trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = [main_text(h.as_py(), sent.value) for h in b.column("html")]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(text, pa.string())], names=[*names, "text"])

    return own.mapInArrow(run, own.drop("html").withColumn("text", F.lit("")).schema).select(*back[:-1], "text")
