"""HTML as a sequence of leaf blocks with the features that a labeller reads.

A block is the text between two tags that end a line; inline tags do not end one. Its features are
the tags, classes and ids on its path, its words, and a few measures, all hashed to fixed widths.
"""

from __future__ import annotations

import html
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np

from railloom.llm.word_hashes import word_hashes

PATH_BINS, WORD_BINS = 320, 24
MEASURES = 9
WIDTH = PATH_BINS + WORD_BINS + MEASURES

#: Elements whose tags do not end a block; formulas, drawings and embedded media stand within a line.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr "
    "audio canvas map meter noscript object output picture progress ruby rb rp rt rtc slot video "
    "math mi mn mo ms mtext mrow mfrac msqrt mroot msub msup msubsup mover munder munderover mpadded mphantom mspace mstyle mtable mtr mtd semantics annotation "
    "svg text tspan textpath g path circle ellipse line polygon polyline rect defs use desc".split()
)
#: Elements whose content is no markup up to their own end tag, and no text of the page.
SILENT = frozenset("script style template title iframe textarea select".split())
#: Those of them that take the rest of the page if they have no end tag.
ENDLESS = frozenset("script style".split())
#: Elements that have no end.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that end an open one of the same row before they begin.
SIBLINGS = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
#: Block elements that end an open paragraph.
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol pre section table ul".split())

_OPEN = re.compile(r"""<(?:(!--)|([!?])|(/?)([a-zA-Z][^\s/<>"']*+))""")
#: What follows a tag's name up to its end or the next tag; only a quote after an equals sign begins a quoted value.
_BODY = re.compile(r"""(?:[^'"<>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+|['"])*+""")
_BARE_BODY = re.compile(r"[^<>]*+")
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PARTS = re.compile(r"[A-Za-z]+")
_END = {name: re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I) for name in SILENT}
_HEAD_END = re.compile(r"</head\b[^>]*>|<body\b", re.I)


@dataclass
class Blocks:
    """Blocks of one page: texts, and per block the hashed path, link share and kind."""

    texts: list[str] = field(default_factory=list)
    paths: list[tuple[int, ...]] = field(default_factory=list)
    linked: list[float] = field(default_factory=list)
    kinds: list[int] = field(default_factory=list)

    def part(self, start: int, end: int) -> Blocks:
        return Blocks(self.texts[start:end], self.paths[start:end], self.linked[start:end], self.kinds[start:end])


_memo: dict[str, tuple[int, ...]] = {}


def _bins(name: str, attributes: str) -> tuple[int, ...]:
    """Path bins of one element: its tag, and the words of its class, id and role."""
    key = name + " " + attributes if attributes and ("class" in attributes or "id" in attributes or "role" in attributes or "CLASS" in attributes) else name
    found = _memo.get(key)
    if found is None:
        words = {f"<{name}>"}
        for m in _NAMES.finditer(attributes):
            words.update(w.lower() for w in _PARTS.findall(m[1] or m[2] or m[3] or ""))
        found = tuple(sorted({zlib.crc32(w.encode()) % PATH_BINS for w in words}))
        if len(_memo) > 50_000:
            _memo.clear()
        _memo[key] = found
    return found


def _tags(page: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """Markup in order: start, end, name (empty for comments and declarations), whether it closes, and its attributes.

    One pass: every character is looked at a bounded number of times. A tag without an end ends where
    the next one begins. What no tag ends before the page does is read again, once, with quotes as
    plain characters; a last tag that is still open is text. A caller that skips content sends the
    place to go on from.
    """
    at, quotes = 0, True
    missing: set[str] = set()  # ends that the rest of the page does not hold
    while m := _OPEN.search(page, at):
        if m[4] is None:
            close = "-->" if m[1] else ">"
            found = -1 if close in missing else page.find(close, m.end())
            if found < 0:
                missing.add(close)
            at = (yield m.start(), found + len(close) if found >= 0 else len(page), "", False, "") or (found + len(close) if found >= 0 else len(page))
            continue
        end = (_BODY if quotes else _BARE_BODY).match(page, m.end()).end()
        if end == len(page):
            if not quotes:
                return
            quotes, at = False, m.start()
            continue
        attributes = page[m.end() : end]
        end += page[end] == ">"
        at = (yield m.start(), end, m[4].lower(), bool(m[3]), attributes) or end


def read(page: str | None) -> Blocks:
    """The blocks of a page in order."""
    out = Blocks()
    if not page:
        return out
    stack: list[tuple[str, tuple[int, ...]]] = []
    open_names: Counter[str] = Counter()
    bins_open: Counter[int] = Counter()
    held: list[str] = []
    link_chars = links = 0
    at = 0

    def flush() -> None:
        nonlocal link_chars
        if held:
            text = " ".join("".join(held).split())
            if text:
                out.texts.append(text)
                out.paths.append(tuple(bins_open))
                out.linked.append(min(1.0, link_chars / len(text)))
                last = stack[-1][0] if stack else ""
                out.kinds.append(1 if last in ("h1", "h2", "h3", "h4", "h5", "h6") else 2 if last in ("li", "dt", "dd") else 0)
            held.clear()
        link_chars = 0

    def say(text: str) -> None:
        nonlocal link_chars
        if text:
            text = html.unescape(text) if "&" in text else text
            held.append(text)
            if links:
                link_chars += len(text)

    def push(name: str, bins: tuple[int, ...]) -> None:
        stack.append((name, bins))
        open_names[name] += 1
        bins_open.update(bins)

    def pop() -> str:
        name, bins = stack.pop()
        open_names[name] -= 1
        for b in bins:
            bins_open[b] -= 1
            if not bins_open[b]:
                del bins_open[b]
        return name

    tags = _tags(page)
    unended: set[str] = set()
    go_on = None
    while True:
        try:
            start, end, name, closes, attributes = tags.send(go_on)
        except StopIteration:
            break
        go_on = None
        say(page[at:start])
        at = end
        if not name:
            continue
        if name == "a":
            links = max(0, links - 1) if closes else links + (not attributes.endswith("/"))
        if name in INLINE:
            continue
        if name in SILENT and not closes and not attributes.endswith("/") and name not in unended:
            found = _END[name].search(page, at)
            if found or name in ENDLESS:
                flush()
                go_on = at = found.end() if found else len(page)
                continue
            unended.add(name)
        flush()
        if closes:
            if open_names[name]:
                while pop() != name:
                    pass
            links = 0
            continue
        if name in VOID or attributes.endswith("/"):
            continue
        if name == "head":
            found = None if "head" in unended else _HEAD_END.search(page, at)
            if found:
                go_on = at = found.start() if page[found.start() + 1] != "/" else found.end()
            else:
                unended.add("head")
            continue
        ended = SIBLINGS.get(name) or ({"p"} if name in ENDS_P else ())
        while stack and stack[-1][0] in ended:
            pop()
        push(name, _bins(name, attributes))
    say(page[at:])
    flush()
    return out


def features(pages: list[Blocks]) -> np.ndarray:
    """One row per block of all pages."""
    texts = [t for p in pages for t in p.texts]
    n = len(texts)
    out = np.zeros((n, WIDTH), np.float32)
    if not n:
        return out
    paths = [x for p in pages for x in p.paths]
    sizes = np.array([len(x) for x in paths])
    out[np.repeat(np.arange(n), sizes), np.fromiter((b for x in paths for b in x), np.int64, int(sizes.sum()))] = 1
    words = list(word_hashes(texts))
    counts = np.array([len(w) for w in words])
    flat = np.concatenate(words)
    block = np.repeat(np.arange(n), counts)
    bins = np.bincount(block * WORD_BINS + (flat % np.uint64(WORD_BINS)).astype(np.int64), minlength=n * WORD_BINS).reshape(n, WORD_BINS)
    out[:, PATH_BINS : PATH_BINS + WORD_BINS] = bins / np.maximum(counts, 1)[:, None]
    chars = np.array([len(t) for t in texts], np.float32)
    kinds = np.array([k for p in pages for k in p.kinds])
    measures = out[:, PATH_BINS + WORD_BINS :]
    measures[:, 0] = np.minimum(np.log1p(chars) / 8, 1.5)
    measures[:, 1] = np.minimum(np.log1p(counts) / 6, 1.5)
    measures[:, 2] = [x for p in pages for x in p.linked]
    measures[:, 3] = kinds == 1
    measures[:, 4] = kinds == 2
    measures[:, 5] = [t[-1] in ".!?" for t in texts]
    measures[:, 6] = np.array([t.count(",") + t.count(".") for t in texts]) / np.maximum(counts, 1)
    measures[:, 7] = [t[0] in "©|»›·" for t in texts]
    measures[:, 8] = 1
    return out
