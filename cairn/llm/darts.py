"""Weighted min-wise signatures by DartMinHash (Christiani, 2020), many texts at a time.

Every element owns a plane of weight by rank on which darts lie as a Poisson
process drawn from hashes of the element alone. A weighted set is hit by the
darts whose weight position lies below the element's weight; each dart belongs
to one hashed coordinate, and the dart of lowest rank is that coordinate's
value. Two sets agree on a coordinate with the probability of their weighted
Jaccard similarity. About k ln k darts are drawn for k coordinates, whatever
the size of the set: heavy sets need low ranks only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
#: Odd multipliers for mixing 64-bit words.
MIX1, MIX2, STEP = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB), U(0x9E3779B97F4A7C15)
POWER = 0x5851F42D4C957F2D
WORDS = 5
#: Ranks below 1 are cut into dyadic cells, [0, 2**LOWEST) the first; above 1 cells are one wide.
LOWEST = -8
MOST_DARTS = 12


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit words."""
    x = (x ^ (x >> U(30))) * MIX1
    x = (x ^ (x >> U(27))) * MIX2
    return x ^ (x >> U(31))


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base, U)
    steps[:1] = 1
    return np.multiply.accumulate(steps)


class Powers:
    """Powers of an odd number and of its inverse modulo 2**64, grown as needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, U)

    def need(self, n: int) -> None:
        """At least ``n`` powers."""
        if len(self.up) < n:
            self.up, self.down = _powers(POWER, n), _powers(pow(POWER, -1, 1 << 64), n)


SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LETTERS = mix(np.arange(1, 257, dtype=U) * STEP)


def word_hashes(texts: pa.Array, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word (run of other than ASCII blanks), and the text it stands in."""
    texts = texts.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    if len(texts) == 0 or offsets[-1] == offsets[0]:
        return np.zeros(0, U), np.zeros(0, np.int64)
    raw = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0]:offsets[-1]]
    offsets = offsets - offsets[0]
    letter = ~SPACE[raw]
    begins = letter.copy()
    begins[1:] &= ~letter[:-1]
    heads = offsets[:-1][offsets[:-1] < len(raw)]
    begins[heads] = letter[heads]
    ends = letter.copy()
    ends[:-1] &= ~letter[1:]
    tails = offsets[1:][offsets[1:] > 0] - 1
    ends[tails] = letter[tails]
    first, last = np.flatnonzero(begins), np.flatnonzero(ends)
    powers.need(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, U)
    np.cumsum(LETTERS[raw] * powers.up[:len(raw)], out=sums[1:])
    words = mix((sums[last + 1] - sums[first]) * powers.down[first])
    return words, np.searchsorted(offsets, first, side="right") - 1


def shingles(texts: pa.Array, powers: Powers, width: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Elements of every text and the text of each, grouped by text.

    An element is a shingle of ``width`` words with its number among equal
    shingles of the text, so the weight of a shingle is its count. A text of
    fewer words has one shingle, a text without words has none.
    """
    words, doc = word_hashes(texts, powers)
    count = np.bincount(doc, minlength=len(texts)) if len(doc) else np.zeros(len(texts), np.int64)
    n = len(words)
    made = np.zeros(n, U)
    place = np.arange(n) - np.repeat(np.cumsum(count) - count, count)
    for k in range(width):
        ahead = words[k:]
        made[:n - k if k else n] += np.where(
            place[:n - k if k else n] + k < count[doc[:n - k if k else n]], ahead, STEP
        ) * U(2 * k * k + 2 * k + 1) if len(ahead) else U(0)
        made = made ^ (made >> U(29))
    good = (place + width <= count[doc]) | ((place == 0) & (count[doc] < width)) if n else np.zeros(0, bool)
    made, doc = mix(made[good] * STEP), doc[good]
    order = np.lexsort((made, doc))
    made, doc = made[order], doc[order]
    fresh = np.ones(len(made), bool)
    fresh[1:] = (made[1:] != made[:-1]) | (doc[1:] != doc[:-1])
    run = np.arange(len(made)) - np.maximum.accumulate(np.where(fresh, np.arange(len(made)), 0))
    return mix(made + run.astype(U) * MIX2), doc


def _at_least(mean: float) -> np.ndarray:
    """For 1, 2, ...: chance that a Poisson count of this mean is so high, as 32-bit thresholds."""
    p, below, found = float(np.exp(-mean)), 0.0, []
    for n in range(1, MOST_DARTS + 1):
        below += p
        found.append(max(0.0, 1.0 - below))
        p *= mean / n
    return (np.array(found) * 2.0**32).astype(U)


def _throw(best: np.ndarray, elements: np.ndarray, slot: np.ndarray, cell: np.ndarray | int,
           low: np.ndarray | float, width: float, k: int) -> None:
    """Throw the darts of one cell for each element; ``best`` keeps the earliest per coordinate."""
    seed = mix(elements ^ (np.asarray(cell, U) * STEP))
    chance = seed >> U(32)
    low = np.broadcast_to(low, len(elements))
    for dart, threshold in enumerate(_at_least(width)):
        hit = np.flatnonzero(chance < threshold)
        if not hit.size:
            break
        own = mix(seed[hit] + U((dart + 1) * int(MIX1) & (1 << 64) - 1))
        rank = low[hit] + width * ((own & U(0xFFFFFF)).astype(np.float64) / 2.0**24)
        coordinate = (((own >> U(24)) & U(0xFFFFFF)) * U(k)) >> U(24)
        name = mix(own + STEP) >> U(32)
        value = (rank.astype(np.float32).view(np.uint32).astype(U) << U(32)) | name
        np.minimum.at(best, slot[hit] * k + coordinate.astype(np.int64), value)


def signatures(elements: np.ndarray, doc: np.ndarray, docs: int, k: int) -> np.ndarray:
    """k values per text; a text without elements has the highest value throughout."""
    best = np.full(docs * k, ~U(0), U)
    weight = np.bincount(doc, minlength=docs) if len(doc) else np.zeros(docs, np.int64)
    need = k * (np.log(k) + 1.0) / np.maximum(weight, 1)
    top = 2.0 ** np.ceil(np.log2(need))
    reach = top[doc]
    for j in range(LOWEST, 1):
        low = 0.0 if j == LOWEST else 2.0 ** (j - 1)
        in_cell = reach > low
        if not in_cell.any():
            break
        some = slice(None) if in_cell.all() else np.flatnonzero(in_cell)
        _throw(best, elements[some], doc[some], j - LOWEST, low, 2.0**j - low, k)
    own = np.arange(len(doc))
    _unit_cells(best, elements, doc, own, np.ones(len(own), np.int64), np.maximum(reach, 1).astype(np.int64), k)
    reached = np.maximum(top, 2.0**LOWEST)
    while True:  # the few texts that still lack a coordinate throw further darts
        lacking = (best.reshape(docs, k) == ~U(0)).any(axis=1) & (weight > 0)
        if not lacking.any():
            return best.reshape(docs, k)
        own = np.flatnonzero(lacking[doc])
        now = reached[doc[own]]
        for value in np.unique(now[now < 1]):
            some = own[now == value]
            j = int(round(np.log2(value))) + 1
            _throw(best, elements[some], doc[some], j - LOWEST, value, value, k)
        high = own[now >= 1]
        from_rank = reached[doc[high]].astype(np.int64)
        _unit_cells(best, elements, doc, high, from_rank, 2 * from_rank, k)
        reached = np.where(lacking, 2 * reached, reached)


def _unit_cells(best, elements, doc, own, begin, end, k, at_once: int = 1 << 19) -> None:
    """Cells [r, r + 1) for r from begin to end, for the elements ``own``."""
    cells = end - begin
    own, begin, cells = own[cells > 0], begin[cells > 0], cells[cells > 0]
    ends = np.cumsum(cells)
    at = 0
    while at < len(own):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + at_once, side="right")))
        many = cells[at:stop]
        index = np.repeat(np.arange(at, stop), many)
        step = np.arange(len(index)) - np.repeat(np.cumsum(many) - many, many)
        rank = begin[index] + step
        _throw(best, elements[own[index]], doc[own[index]], rank + 64, rank.astype(np.float64), 1.0, k)
        at = stop


def band_keys(values: np.ndarray, bands: int) -> np.ndarray:
    """One 64-bit key per text and band of consecutive coordinates."""
    docs, k = values.shape
    parts = values.reshape(docs, bands, k // bands)
    keys = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=U) * STEP), (docs, bands)).copy()
    for row in range(parts.shape[2]):
        keys = mix(keys ^ parts[:, :, row]) + STEP
    return mix(keys).view(np.int64)
