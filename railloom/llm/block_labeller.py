"""Recurrent block labeller: a bidirectional LSTM in numpy over the leaf blocks of a page.

Every block is classified as main text or not from its own features and, through the two
recurrences, from all blocks before and after it on the page.
"""

from __future__ import annotations

import os

import numpy as np

from railloom.llm import html_blocks

HIDDEN = 40
WEIGHTS = os.path.join(os.path.dirname(os.path.abspath(__file__)), "block_labeller.npz")
#: Blocks, padding included, that go through the recurrence at once.
BATCH_BLOCKS = 1 << 14


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def new_weights(seed: int = 0) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    made = {}
    for side in "fb":
        made[f"{side}x"] = (rng.normal(size=(html_blocks.WIDTH, 4 * HIDDEN)) * 0.1).astype(np.float32)
        made[f"{side}h"] = (rng.normal(size=(HIDDEN, 4 * HIDDEN)) * 0.1).astype(np.float32)
        made[f"{side}c"] = np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)]).astype(np.float32)
    made["out"] = (rng.normal(size=2 * HIDDEN) * 0.1).astype(np.float32)
    made["bias"] = np.zeros(1, np.float32)
    return made


def _flip(x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Each page's blocks in reverse, padding left at the end. x: block, page, ..."""
    steps = np.arange(x.shape[0])[:, None]
    at = np.where(steps < lengths, lengths - 1 - steps, steps)
    return x[at, np.arange(x.shape[1])]


def _run(x: np.ndarray, w: dict[str, np.ndarray], side: str, start: tuple | None = None, keep: bool = False) -> tuple[np.ndarray, list, tuple]:
    """Hidden states (block, page, HIDDEN) of one direction, with ``keep`` what its gradient needs, and the last state."""
    steps, pages, _ = x.shape
    given = x.reshape(steps * pages, -1) @ w[f"{side}x"] + w[f"{side}c"]
    given = given.reshape(steps, pages, 4 * HIDDEN)
    h, c = start or (np.zeros((pages, HIDDEN), np.float32), np.zeros((pages, HIDDEN), np.float32))
    hs, saved = np.empty((steps, pages, HIDDEN), np.float32), []
    for t in range(steps):
        z = given[t] + h @ w[f"{side}h"]
        gates = _sigmoid(z[:, : 3 * HIDDEN])
        i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
        g = np.tanh(z[:, 3 * HIDDEN :])
        before = c, h
        c = f * c + i * g
        tc = np.tanh(c)
        h = o * tc
        hs[t] = h
        if keep:
            saved.append((i, f, o, g, tc, *before))
    return hs, saved, (h, c)


def _back(x: np.ndarray, w: dict[str, np.ndarray], side: str, saved: list, dhs: np.ndarray, grads: dict[str, np.ndarray]) -> None:
    steps, pages, width = x.shape
    dz = np.empty((steps, pages, 4 * HIDDEN), np.float32)
    dh, dc = np.zeros((pages, HIDDEN), np.float32), np.zeros((pages, HIDDEN), np.float32)
    dwh = np.zeros_like(w[f"{side}h"])
    for t in range(steps - 1, -1, -1):
        i, f, o, g, tc, c0, h0 = saved[t]
        dh = dh + dhs[t]
        dc = dc + dh * o * (1 - tc**2)
        dz[t] = np.concatenate([dc * g * i * (1 - i), dc * c0 * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g**2)], axis=1)
        dwh += h0.T @ dz[t]
        dh, dc = dz[t] @ w[f"{side}h"].T, dc * f
    flat = dz.reshape(steps * pages, -1)
    grads[f"{side}x"], grads[f"{side}h"], grads[f"{side}c"] = x.reshape(steps * pages, width).T @ flat, dwh, flat.sum(axis=0)


def scores(x: np.ndarray, lengths: np.ndarray, w: dict[str, np.ndarray]) -> np.ndarray:
    """Log odds (block, page) that a block is main text."""
    fwd, _, _ = _run(x, w, "f")
    bwd, _, _ = _run(_flip(x, lengths), w, "b")
    return np.concatenate([fwd, _flip(bwd, lengths)], axis=2) @ w["out"] + w["bias"]


def long_scores(page: html_blocks.Blocks, w: dict[str, np.ndarray]) -> np.ndarray:
    """The same for one page of any number of blocks, a stretch of them at a time."""
    n = len(page.texts)
    z = np.full(n, w["bias"][0], np.float32)
    stretches = [(a, min(n, a + BATCH_BLOCKS)) for a in range(0, n, BATCH_BLOCKS)]
    state = None
    for a, b in stretches:
        hs, _, state = _run(html_blocks.features([page.part(a, b)])[:, None], w, "f", state)
        z[a:b] += hs[:, 0] @ w["out"][:HIDDEN]
    state = None
    for a, b in reversed(stretches):
        hs, _, state = _run(html_blocks.features([page.part(a, b)])[::-1, None], w, "b", state)
        z[a:b] += (hs[:, 0] @ w["out"][HIDDEN:])[::-1]
    return z


def gradients(x: np.ndarray, lengths: np.ndarray, y: np.ndarray, w: dict[str, np.ndarray]) -> tuple[float, dict[str, np.ndarray]]:
    """Mean cross entropy per block, and its gradients."""
    real = np.arange(x.shape[0])[:, None] < lengths
    fwd, saved_f, _ = _run(x, w, "f", keep=True)
    flipped = _flip(x, lengths)
    bwd, saved_b, _ = _run(flipped, w, "b", keep=True)
    both = np.concatenate([fwd, _flip(bwd, lengths)], axis=2)
    z = both @ w["out"] + w["bias"]
    p = _sigmoid(z)
    n = real.sum()
    loss = float(-(np.where(y, np.log(p + 1e-9), np.log(1 - p + 1e-9)) * real).sum() / n)
    dz = (((p - y) * real) / n).astype(np.float32)
    grads = {"out": np.einsum("tp,tph->h", dz, both), "bias": np.array([dz.sum()], np.float32)}
    dboth = dz[:, :, None] * w["out"]
    _back(x, w, "f", saved_f, dboth[:, :, :HIDDEN], grads)
    _back(flipped, w, "b", saved_b, _flip(dboth[:, :, HIDDEN:], lengths), grads)
    return loss, grads


def batches(pages: list[html_blocks.Blocks]):
    """(indices, features (block, page, ...), lengths) of pages of like length; all blocks of all pages."""
    order = sorted(range(len(pages)), key=lambda i: len(pages[i].texts))
    order = [i for i in order if pages[i].texts]
    at = 0
    while at < len(order):
        end = at + 1
        while end < len(order) and (end + 1 - at) * len(pages[order[end]].texts) <= BATCH_BLOCKS:
            end += 1
        own = order[at:end]
        lengths = np.array([len(pages[i].texts) for i in own])
        flat = html_blocks.features([pages[i] for i in own])
        x = np.zeros((lengths.max(), len(own), html_blocks.WIDTH), np.float32)
        page = np.repeat(np.arange(len(own)), lengths)
        step = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        x[step, page] = flat
        yield own, x, lengths
        at = end


class Labeller:
    """A trained labeller."""

    def __init__(self, weights: dict[str, np.ndarray] | None = None):
        self.weights = weights or dict(np.load(WEIGHTS))

    def label(self, pages: list[html_blocks.Blocks]) -> list[np.ndarray]:
        """For each page, which of its blocks are main text."""
        out = [np.zeros(0, bool)] * len(pages)
        short = [i for i, p in enumerate(pages) if len(p.texts) <= BATCH_BLOCKS]
        for own, x, lengths in batches([pages[i] for i in short]):
            z = scores(x, lengths, self.weights)
            for k, i in enumerate(own):
                out[short[i]] = z[: lengths[k], k] > 0
        for i, p in enumerate(pages):
            if len(p.texts) > BATCH_BLOCKS:
                out[i] = long_scores(p, self.weights) > 0
        return out

    def main_texts(self, pages: list[str | None]) -> list[str]:
        """The main text of each page: its main blocks in order, joined by a space."""
        read = [html_blocks.read(p) for p in pages]
        return [" ".join(t for t, main in zip(b.texts, mains, strict=True) if main) for b, mains in zip(read, self.label(read), strict=True)]
