"""Main text of pages by a linear-chain conditional random field over leaf blocks.

Each block has binary features of its open tags, the names those tags bear and its text.  Weights of features and of the transitions between neighbouring blocks are
trained by maximum likelihood (forward-backward, Adagrad) on labelled pages and the labels of a page are decoded by Viterbi.  Training takes a few seconds on the driver
on a fixed number of pages; the weights are a small dictionary.  Pages are independent rows: no shuffle.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quantloom.llm.html_blocks import Block, leaf_blocks
from quantloom.llm.labelled_pages import labelled_pages

SKIN = frozenset("html body b i em strong span a u small br font tbody".split())


def block_features(blocks: list[Block]) -> list[list[str]]:
    """Names of the features that hold for each block."""
    total = sum(len(b.text) for b in blocks) or 1
    seen, out = 0, []
    for b in blocks:
        t, n = b.text, len(b.text)
        words = t.split(" ")
        f = {"bias", f"len{min(6, n.bit_length() - 3 if n > 7 else 0)}", f"words{min(5, len(words).bit_length())}"}
        for o in b.path:
            if o.tag not in SKIN:
                f.add("tag:" + o.tag)
            f.update("name:" + x for x in o.names)
        blocks_only = [o for o in b.path if o.tag not in SKIN]
        f.add("leaf:" + (blocks_only[-1].tag if blocks_only else "none"))
        f.add(f"link{int(3.99 * b.linked / n)}")
        f.add("stop" if t[-1] in ".?!:;\"'" else "open")
        f.add("upper" if t[:1].isupper() else "lower")
        if "," in t:
            f.add("comma")
        if "©" in t or "all rights reserved" in t.lower():
            f.add("copyright")
        low = t.lower() if n < 200 else ""
        for key in ("cookie", "subscribe", "newsletter", "comment", "reply", "share", "advert", "sponsor", "log in", "sign up", "search", "privacy", "related"):
            if key in low:
                f.add("says:" + key)
        f.add(f"place{int(4 * seen / total)}")
        seen += n
        out.append(list(f))
    return out


@dataclass
class Field:
    weight: dict[str, float]        # of label 1 against label 0
    turn: np.ndarray                # 2 x 2 transition weights
    first: np.ndarray

    def decode(self, features: list[list[str]]) -> list[bool]:
        """Viterbi: the most likely labels of the whole sequence."""
        if not features:
            return []
        get = self.weight.get
        gain = [sum(get(x, 0.0) for x in f) for f in features]
        (t00, t01), (t10, t11) = self.turn.tolist()
        a, b = self.first[0], self.first[1] + gain[0]
        back = []
        for g in gain[1:]:
            x0, x1, y0, y1 = a + t00, b + t10, a + t01, b + t11
            back.append((x1 > x0, y1 > y0))
            a, b = max(x0, x1), max(y0, y1) + g
        label = b > a
        out = [label]
        for step in reversed(back):
            label = step[1] if label else step[0]
            out.append(label)
        return out[::-1]


def train(pages: list[list[tuple[str, bool]]], steps: int = 120, rate: float = 0.3, decay: float = 0.02) -> Field:
    """Maximum likelihood on pages given as pieces with labels."""
    chains, names = [], {}
    for parts in pages:
        blocks, labels = [], []
        whole = "".join(p for p, _ in parts)
        blocks = leaf_blocks(whole)
        labels = [bool(y) for p, y in parts if y is not None for _ in leaf_blocks(p)]
        if len(blocks) == len(labels) and blocks:
            chains.append(([[names.setdefault(x, len(names)) for x in f] for f in block_features(blocks)], labels))
    longest = max(len(c[1]) for c in chains)
    n = len(chains)
    y, mask = np.zeros((n, longest), int), np.zeros((n, longest), bool)
    row, col = [], []
    for k, (feats, labels) in enumerate(chains):
        y[k, :len(labels)], mask[k, :len(labels)] = labels, True
        for i, f in enumerate(feats):
            row += [k * longest + i] * len(f)
            col += f
    row, col = np.array(row), np.array(col)
    w, turn, first = np.zeros(len(names)), np.zeros((2, 2)), np.zeros(2)
    hw, ht, hf = np.full(len(names), 1e-2), np.full((2, 2), 1e-2), np.full(2, 1e-2)
    pair = mask[:, 1:]
    for _ in range(steps):
        gain = np.bincount(row, w[col], n * longest).reshape(n, longest)
        unit = np.stack((np.zeros_like(gain), gain), 2)
        p, q = _marginals(unit, mask, turn, first)
        err = np.where(mask, p - y, 0.0)
        gw = np.bincount(col, err.ravel()[row], len(names)) + decay * w
        want = np.zeros((2, 2))
        np.add.at(want, (y[:, :-1][pair], y[:, 1:][pair]), 1)
        gt = q - want + decay * turn
        gf = np.array([(1 - p[:, 0] - (y[:, 0] == 0)).sum(), (p[:, 0] - (y[:, 0] == 1)).sum()]) + decay * first
        for v, g, h in ((w, gw, hw), (turn, gt, ht), (first, gf, hf)):
            h += g * g
            v -= rate * g / np.sqrt(h)
    return Field(dict(zip(names, w.tolist())), turn, first)


def _marginals(unit, mask, turn, first):
    """P(label 1) of every block and the summed pair marginals, by forward-backward in log space over all chains at once."""
    n, size, _ = unit.shape
    add = lambda x: np.logaddexp(x[..., 0], x[..., 1])
    alpha, beta = np.zeros_like(unit), np.zeros_like(unit)
    alpha[:, 0] = first + unit[:, 0]
    for i in range(1, size):
        step = add(np.moveaxis(alpha[:, i - 1, :, None] + turn, 1, 2)) + unit[:, i]
        alpha[:, i] = np.where(mask[:, i, None], step, alpha[:, i - 1])
    for i in range(size - 2, -1, -1):
        step = add(turn + (unit[:, i + 1] + beta[:, i + 1])[:, None, :])
        beta[:, i] = np.where(mask[:, i + 1, None], step, 0.0)
    z = add(alpha[:, -1])
    p = np.exp(alpha[:, :, 1] + beta[:, :, 1] - z[:, None])
    joint = alpha[:, :-1, :, None] + turn + (unit + beta)[:, 1:, None, :] - z[:, None, None, None]
    return p, np.where(mask[:, 1:, None, None], np.exp(np.minimum(joint, 0)), 0.0).sum((0, 1))


@functools.lru_cache(maxsize=1)
def trained() -> Field:
    return train(labelled_pages())


def main_text(page: str | None, model: Field) -> str:
    blocks = leaf_blocks(page)
    keep = model.decode(block_features(blocks))
    return "\n\n".join(b.text for b, k in zip(blocks, keep) if k)


def extract(df: DataFrame, html: str = "html", text: str = "text", model: Field | None = None) -> DataFrame:
    """All rows and columns of `df` and the main text; a column of that name is replaced.  Null, empty and text-less pages give the empty text."""
    keep = [c for c in df.columns if c != text]
    at, model = keep.index(html), model or trained()
    shared = df.sparkSession.sparkContext.broadcast(model)          # some thousand weights
    schema = ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep] + [f"`{text}` string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [main_text(p, shared.value) for p in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string())], [*keep, text])

    return df.select(*[df[c] for c in keep]).mapInArrow(run, schema)
