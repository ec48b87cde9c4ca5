"""Training of the block labeller on generated pages: ``python -m railloom.llm.train_labeller``.

Pages of many layouts are made from a seed, with every block's label known by construction. They
share no text with any table.
"""

from __future__ import annotations

import random

import numpy as np

from railloom.llm import block_labeller, html_blocks

PAGES, EPOCHS, BATCH = 40000, 20, 48


class _Page:
    """A page in the making: its HTML and the label of each block."""

    def __init__(self, rng: random.Random):
        self.rng, self.html, self.labels = rng, [], []
        syllables = ["".join(rng.choice("bcdfghklmnprstvwz") + rng.choice("aeiouyéöüñ")) for _ in range(40)]
        self.vocabulary = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(rng.choice([30, 200, 800]))]

    def words(self, low: int, high: int) -> str:
        rng = self.rng
        style = rng.random()
        own = [rng.choice(self.vocabulary) for _ in range(rng.randint(low, high))]
        if style < 0.06:
            own = [w + rng.choice(["%%%", "***", "&amp;&amp;", "###"]) for w in own]
        elif style < 0.12:
            own = [x for w in own for x in (w, "|")]
        elif style < 0.17:
            own = [w.upper() + "!!" for w in own]
        elif style < 0.24:
            own = own[:1] * len(own)
        elif style < 0.75:
            own = [w + rng.choice(["", "", "", ",", "."]) for w in own]
        own[0] = own[0].capitalize()
        return " ".join(own) + rng.choice([".", ".", ".", "!", "", " &middot;"])

    def put(self, tag: str, text: str, main: bool, names: str = "", close: bool = True) -> None:
        self.html.append(f"<{tag}{names}>{text}" + (f"</{tag}>" if close else ""))
        self.labels.append(main)

    def open(self, tag: str, names: str = "") -> None:
        self.html.append(f"<{tag}{names}>")

    def close(self, tag: str) -> None:
        self.html.append(f"</{tag}>" + self.rng.choice(["", "\n", "\n  "]))

    def name(self, *names: str) -> str:
        rng = self.rng
        own = rng.choice(names)
        own = rng.choice([own, own.capitalize(), f"{own}-{rng.choice(['box', 'wrap', 'area', 'x1'])}", f"site-{own}", f"{own}_{rng.randint(1, 9)}"])
        return f' {rng.choice(["class", "class", "id"])}="{own}"'

    def links(self, n: int, main: bool = False) -> None:
        self.open("ul")
        for _ in range(n):
            self.put("li", f'<a href="/{self.rng.randint(1, 999)}">{self.words(1, 3)}</a>', main)
        self.close("ul")

    def boilerplate(self, kind: str, semantic: bool) -> None:
        rng = self.rng
        div = lambda tag, *names: (tag, self.name(*names) if rng.random() < 0.4 else "") if semantic else ("div", self.name(*names))
        if kind == "nav":
            tag, names = div("nav", "nav", "menu", "navbar", "navigation", "breadcrumb")
        elif kind == "header":
            tag, names = div("header", "header", "masthead", "banner", "topbar")
        elif kind == "footer":
            tag, names = div("footer", "footer", "copyright", "colophon")
        elif kind == "sidebar":
            tag, names = div("aside", "sidebar", "side", "related", "widget", "recommended", "trending")
        elif kind == "comments":
            tag, names = ("section", self.name("comments", "comment", "discussion", "responses", "replies")) if semantic else ("div", self.name("comments", "comment", "discussion", "responses", "replies"))
        elif kind == "form":
            tag, names = div("form", "form", "newsletter", "subscribe", "signup", "login", "search")
        elif kind == "notice":
            tag, names = "div", self.name("notice", "cookie", "consent", "alert", "gdpr", "popup", "modal", "paywall")
        else:
            tag, names = rng.choice(["div", "div", "div", "section"]), self.name("ad", "ads", "advert", "advertisement", "sponsored", "promo", "sponsor")
        self.open(tag, names)
        if kind == "nav" or kind in ("header", "sidebar", "footer") and rng.random() < 0.5:
            if kind in ("header", "sidebar") and rng.random() < 0.6:
                self.put(rng.choice(["h1", "h2", "h3", "p", "div"]), self.words(1, 6), False)
            self.links(rng.randint(2, 9))
        elif kind == "comments":
            for _ in range(rng.randint(1, 6)):
                self.open("div", self.name("comment", "reply", "response", "post"))
                if rng.random() < 0.5:
                    self.put(rng.choice(["h4", "div"]), self.words(1, 2), False)
                self.put("p", self.words(3, 90), False)
                self.close("div")
        elif kind == "form":
            for _ in range(rng.randint(1, 4)):
                self.html.append('<input type="text">' if rng.random() < 0.5 else "<button>")
                self.html.append(f"<label>{self.words(1, 4)}</label>")
                self.html.append("<br>")
                self.labels.append(False)
        elif rng.random() < 0.45:
            text = self.words(2, 40)
            self.html.append(rng.choice(["&copy; ", "", ""]) + text)
            self.labels.append(False)
        else:
            for _ in range(rng.randint(1, 4)):
                self.put(rng.choice(["p", "div", "h3"]), self.words(1, 60), False)
        self.close(tag)

    def article(self, semantic: bool) -> None:
        rng = self.rng
        outer = ("article", rng.choice(["", "", self.name("post", "story", "entry")])) if semantic else ("div", self.name("article", "content", "post", "story", "entry", "body", "text"))
        if rng.random() < 0.4:
            wrap = rng.choice([("main", ""), ("div", self.name("content", "main", "page", "container")), ("section", "")])
            self.open(*wrap)
        else:
            wrap = None
        self.open(*outer)
        if rng.random() < 0.85:
            self.put(rng.choice(["h1", "h1", "h2"]), self.words(1, 14), True)
        for _ in range(rng.choice([1, 2, 3, 5, 8, 13, 30])):
            what = rng.random()
            if what < 0.62:
                self.put("p", self.words(1, rng.choice([2, 12, 60, 160])), True, close=rng.random() < 0.8)
            elif what < 0.70:
                self.put("p", f"<b>{self.words(2, 60)}<br>", True, close=False)
            elif what < 0.76:
                self.put(rng.choice(["h2", "h3", "h4"]), self.words(1, 8), True)
            elif what < 0.81:
                self.open("ul")
                for _ in range(rng.randint(1, 5)):
                    self.put("li", self.words(1, 25), True)
                self.close("ul")
            elif what < 0.85:
                self.put("blockquote", self.words(4, 60), True)
            elif what < 0.88:
                self.put("pre", self.words(4, 40), True)
            elif what < 0.91:
                self.put("p", f'{self.words(3, 30)} <a href="x">{self.words(1, 4)}</a> {self.words(1, 30)}', True)
            elif what < 0.93:
                self.open("table")
                for _ in range(rng.randint(1, 3)):
                    self.open("tr")
                    self.put("td", self.words(1, 4), True)
                    self.put("td", self.words(1, 4), True)
                    self.close("tr")
                self.close("table")
            else:
                self.boilerplate(rng.choice(["ad", "ad", "sidebar", "form", "notice"]), semantic)
        self.close(outer[0])
        if wrap:
            self.close(wrap[0])

    def make(self) -> tuple[str, list[bool]]:
        rng = self.rng
        semantic = rng.random() < 0.65
        self.html.append('<!DOCTYPE html><html lang="en"><head><title>x</title><style>p{}</style></head><body>')
        for kind in rng.choice([["nav"], ["nav"], ["header", "nav"], ["notice", "header"], ["header"], ["nav", "notice"], []]):
            self.boilerplate(kind, semantic)
        for kind in rng.sample(["ad", "form", "sidebar", "notice"], rng.choice([0, 0, 1, 2])):
            self.boilerplate(kind, semantic)
        if rng.random() < 0.97:
            self.article(semantic)
        for kind in rng.sample(["ad", "form", "sidebar", "comments", "nav", "comments"], rng.choice([0, 0, 1, 2, 3])):
            self.boilerplate(kind, semantic)
        if rng.random() < 0.9:
            self.boilerplate("footer", semantic)
        self.html.append(rng.choice(["</body></html>", ""]))
        return "".join(self.html), self.labels


def generated(n: int, seed: int) -> tuple[list[html_blocks.Blocks], list[np.ndarray]]:
    """Blocks and labels of ``n`` made pages."""
    rng = random.Random(seed)
    pages, labels = [], []
    while len(pages) < n:
        page, own = _Page(rng).make()
        blocks = html_blocks.read(page)
        if len(blocks.texts) != len(own):
            raise AssertionError(f"{len(blocks.texts)} blocks for {len(own)} labels in {page}")
        if own:
            pages.append(blocks)
            labels.append(np.array(own))
    return pages, labels


def accuracy(labeller: block_labeller.Labeller, pages, labels) -> tuple[float, float]:
    """Share of blocks, and of whole pages, that are labelled right."""
    got = labeller.label(pages)
    right = [(g == y) for g, y in zip(got, labels, strict=True)]
    return float(np.concatenate(right).mean()), float(np.mean([r.all() for r in right]))


def train(pages: int = PAGES, epochs: int = EPOCHS, seed: int = 1) -> dict[str, np.ndarray]:
    """Weights fitted with Adam."""
    made, labels = generated(pages, seed)
    w = block_labeller.new_weights(seed)
    first = {k: np.zeros_like(v) for k, v in w.items()}
    second = {k: np.zeros_like(v) for k, v in w.items()}
    rng = np.random.default_rng(seed)
    step, steps = 0, epochs * (pages // BATCH)
    for _ in range(epochs):
        order = rng.permutation(pages)
        # neighbours of like length share a batch, batches come in any order
        parts = [order[i : i + 8 * BATCH] for i in range(0, pages, 8 * BATCH)]
        groups = [p[np.argsort([len(made[i].texts) for i in p], kind="stable")][j : j + BATCH] for p in parts for j in range(0, len(p), BATCH)]
        for own in rng.permutation(len(groups)):
            index = list(groups[own])
            for at, x, lengths in block_labeller.batches([made[i] for i in index]):
                y = np.zeros(x.shape[:2], bool)
                for k, i in enumerate(at):
                    y[: lengths[k], k] = labels[index[i]]
                _, grads = block_labeller.gradients(x, lengths, y, w)
                step += 1
                rate = 0.004 * max(0.02, 1 - step / steps)
                scale = min(1.0, 1.0 / (np.sqrt(sum(float((g**2).sum()) for g in grads.values())) + 1e-9))
                for k, g in grads.items():
                    g = g * scale
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g**2
                    w[k] = (w[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return w


if __name__ == "__main__":
    weights = train()
    np.savez_compressed(block_labeller.WEIGHTS, **weights)
    print("held-out accuracy of blocks and pages:", accuracy(block_labeller.Labeller(weights), *generated(2000, 99)))
