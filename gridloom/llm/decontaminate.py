"""Benchmark decontamination by greedy string tiling.

Words are runs of letters, digits and underscores in lower case. A document's word sequence is joined with the items of
a benchmark on the seeds that they share, a seed being `min_match` words in a row. For every item whose seeds could cover
enough of it, tiles are laid by running Karp-Rabin: hashes of all unmarked runs of one length are compared, the longest
length that item and text have in common is found by bisection, its matches are marked from the item's first on, each at
its first free place in the text, and the search goes on below that length. No word is marked twice on either side. The
share of an item's words that tiles mark is its coverage; so passages that were cut up and reordered are found as well.
All steps work on whole arrays of the text's length, so repetitive texts and items cost no more than others.

The benchmark is taken in blocks of at most BLOCK_WORDS words (or one item), each broadcast with that bound and held
against all documents; a benchmark of any size is covered by as many blocks as it needs.

Cases: null texts count as empty; items with fewer words than `min_match` are found where they stand alone, as a whole
line; items without words give no rows; rows that repeat an item id are one item each and the best of them counts;
repeated documents give repeated rows; whole texts are read whatever their length; other columns are ignored; an empty
table on either side gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import bounded, mix64, text_batches, written

BLOCK_WORDS = 1_000_000
MIN_MATCH = 5
THRESHOLD = 0.5

_WORD = re.compile(r"\w+")
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


class Runs:
    """Karp-Rabin hashes of runs of any length over a sequence of ids, by prefix sums; marked and negative ids are in none."""

    def __init__(self, ids: np.ndarray) -> None:
        self.ids = ids
        self.free = ids >= 0
        n = len(ids)
        self.down = np.full(n, _INVERSE, np.uint64)
        up = np.full(n, _BASE, np.uint64)
        if n:
            self.down[0] = up[0] = 1
        self.down = np.cumprod(self.down, dtype=np.uint64)
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix64(ids.astype(np.uint64)) * np.cumprod(up, dtype=np.uint64), dtype=np.uint64)))

    def of(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, hashes) of the runs of that length without a marked word."""
        taken = np.concatenate(([0], np.cumsum(~self.free)))
        at = np.flatnonzero(taken[size:] == taken[:-size]) if size <= len(self.ids) else np.zeros(0, np.int64)
        return at, (self.sums[at + size] - self.sums[at]) * self.down[at]


def tiles(item: np.ndarray, text: np.ndarray, min_match: int) -> list[tuple[int, int, int]]:
    """(start in item, start in text, length) of the tiles of two sequences of ids; negative ids match nothing."""
    a, b = Runs(item), Runs(text)
    found: list[tuple[int, int, int]] = []
    high = len(item)
    while True:
        low, best = min_match, 0
        while low <= high:  # the longest length in common
            size = (low + high) // 2
            if np.isin(a.of(size)[1], b.of(size)[1]).any():
                low, best = size + 1, size
            else:
                high = size - 1
        if not best:
            return found
        (starts, own), (places, other) = a.of(best), b.of(best)
        order = np.argsort(other, kind="stable")
        places, other = places[order], other[order]
        next_at: dict[int, int] = {}  # by hash: the first place that may still be free
        for i, h in zip(starts[np.isin(own, other)].tolist(), own[np.isin(own, other)].tolist(), strict=True):
            if not a.free[i : i + best].all():
                continue
            k = next_at.get(h, -1)
            k = int(np.searchsorted(other, np.uint64(h))) if k < 0 else k
            while k < len(other) and other[k] == h:
                t = int(places[k])
                if b.free[t : t + best].all() and (item[i : i + best] == text[t : t + best]).all():
                    a.free[i : i + best] = False
                    b.free[t : t + best] = False
                    found.append((i, t, best))
                    break
                k += 1
            next_at[h] = k
        high = best - 1


class Index:
    """The seeds of a block of items, as sorted arrays."""

    def __init__(self, items: list[tuple[int, list[str]]], min_match: int) -> None:
        self.min_match = min_match
        self.short: dict[tuple[str, ...], list[int]] = {}
        for i, ws in items:
            if len(ws) < min_match:
                self.short.setdefault(tuple(ws), []).append(i)
        items = [(i, ws) for i, ws in items if len(ws) >= min_match]
        self.vocabulary: dict[str, int] = {}
        self.items = [(i, np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in ws], np.int64)) for i, ws in items]
        seeds = [Runs(ids).of(min_match)[1] for _, ids in self.items]
        seed = np.concatenate([np.zeros(0, np.uint64), *seeds])
        order = np.argsort(seed, kind="stable")
        self.seed = seed[order]
        self.item = np.concatenate([np.zeros(0, np.int64), *[np.full(len(x), k, np.int64) for k, x in enumerate(seeds)]])[order]
        self.at = np.concatenate([np.zeros(0, np.int64), *[np.arange(len(x)) for x in seeds]])[order]

    def matches(self, text: str | None, threshold: float) -> list[tuple[int, int, int, int]]:
        """(item id, its words, words that tiles mark, tiles) of the items that are covered enough."""
        k, known = self.min_match, self.vocabulary.get
        out = []
        if self.short and text:
            alone = {tuple(ws) for line in text.split("\n") if (ws := words(line)) and len(ws) < k}
            out += [(i, len(ws), len(ws), 1) for ws in alone for i in self.short.get(ws, ())]
        ids = np.array([known(w, -1) for w in words(text)], np.int64)
        if len(ids) < k or not len(self.seed):
            return out
        runs = Runs(ids)
        whole, hashes = runs.of(k)
        lo = np.searchsorted(self.seed, hashes, "left")
        hit = self.seed[np.minimum(lo, len(self.seed) - 1)] == hashes
        if not hit.any():
            return out
        whole, hashes = whole[hit], hashes[hit]
        different = np.unique(hashes)
        lo, hi = np.searchsorted(self.seed, different, "left"), np.searchsorted(self.seed, different, "right")
        n = hi - lo
        which = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)  # the places in items, not those in the text
        which = which[np.argsort(self.item[which], kind="stable")]
        item = self.item[which]
        for part in np.split(which, np.flatnonzero(np.diff(item)) + 1):
            own, own_ids = self.items[self.item[part[0]]]
            covered = np.zeros(len(own_ids) + 1, np.int64)
            np.add.at(covered, self.at[part], 1)
            np.add.at(covered, self.at[part] + k, -1)
            if (np.cumsum(covered)[:-1] > 0).sum() < threshold * len(own_ids):
                continue
            laid = tiles(own_ids, self._near(ids, whole[np.isin(hashes, self.seed[part])]), k)
            marked = sum(x[2] for x in laid)
            if marked >= threshold * len(own_ids):
                out.append((own, len(own_ids), marked, len(laid)))
        return out

    def _near(self, ids: np.ndarray, seeds: np.ndarray) -> np.ndarray:
        """The words of the text that are in the seeds, those of one stretch together, with -1 between stretches."""
        inside = np.zeros(len(ids) + 1, np.int64)
        np.add.at(inside, seeds, 1)
        np.add.at(inside, seeds + self.min_match, -1)
        at = np.flatnonzero(np.cumsum(inside)[:-1] > 0)
        return np.insert(ids[at], np.flatnonzero(np.diff(at) > 1) + 1, -1)


def _blocks(benchmark: DataFrame, item_id: str, item_text: str, min_match: int) -> Iterator[Index]:
    held: list[tuple[int, list[str]]] = []
    size = 0
    for row in benchmark.select(item_id, item_text).toLocalIterator():
        found = words(row[1])
        if not found:
            continue
        if held and size + len(found) > BLOCK_WORDS:
            yield Index(held, min_match)
            held, size = [], 0
        held.append((row[0], found))
        size += len(found)
    if held:
        yield Index(held, min_match)


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", min_match: int = MIN_MATCH, threshold: float = THRESHOLD) -> DataFrame:
    """(id, item_id, n_words, n_marked, n_tiles, coverage) of the pairs whose coverage reaches the threshold."""
    text_batches(docs.sparkSession)
    spark = docs.sparkSession
    schema = f"`{id_col}` {dict(docs.dtypes)[id_col]}, item_id bigint, n_words bigint, n_marked bigint, n_tiles bigint, coverage double"

    def against(index: Index) -> DataFrame:
        held = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = held.value
            for batch in bounded(batches):
                rows, found = [], []
                for k, text in enumerate(batch.column(1).to_pylist()):
                    best: dict[int, tuple[int, int, int, int]] = {}
                    for x in own.matches(text, threshold):
                        if x[0] not in best or x[2] * best[x[0]][1] > best[x[0]][2] * x[1]:
                            best[x[0]] = x
                    rows += [k] * len(best)
                    found += best.values()
                columns = [pa.array([x[c] for x in found], pa.int64()) for c in range(4)]
                cover = pa.array([x[2] / x[1] for x in found], pa.float64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *columns, cover], [id_col, "item_id", "n_words", "n_marked", "n_tiles", "coverage"])

        return docs.select(id_col, text_col).mapInArrow(run, schema)

    parts: list[DataFrame] = []
    for index in _blocks(benchmark, item_id, item_text, min_match):
        if parts:  # more than one block: each result is kept before the next index is sent
            parts[-1] = written(parts[-1], "contaminated")
        parts.append(against(index))
    return reduce(DataFrame.unionAll, parts) if parts else spark.createDataFrame([], schema)
