"""Words of whole texts as 64-bit hashes, by array operations over their bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from railloom.llm.common import mix64

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Bytes hashed in one go, but for longer single texts.
GROUP_BYTES = 1 << 18
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, GROUP_BYTES + 1)
        made = []
        for base in (_BASE, _INVERSE):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            made.append(np.multiply.accumulate(table))
        if n > 8 * GROUP_BYTES:  # a rare giant is not worth keeping tables for
            return made[0], made[1]
        _powers[:] = made
    return _powers[0], _powers[1]


def _group(raw: list[bytes]) -> list[np.ndarray]:
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    space = _SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space])))
    starts, ends = edge[::2], edge[1::2]
    power, inverse = _power_tables(len(data) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], dtype=np.uint64)])
    hashes = mix64((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    text_ends = np.cumsum([len(r) + 1 for r in raw])
    return np.split(hashes, np.searchsorted(starts, text_ends[:-1]))


def word_hashes(texts: list[str]) -> Iterator[np.ndarray]:
    """For each text the hashes of its words, runs of anything but ASCII white space."""
    held, size = [], 0
    for text in texts:
        raw = text.encode("utf-8", "surrogatepass")
        if held and size + len(raw) > GROUP_BYTES:
            yield from _group(held)
            held, size = [], 0
        held.append(raw)
        size += len(raw) + 1
    if held:
        yield from _group(held)
