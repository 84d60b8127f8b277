"""Benchmark decontamination with an FM-index over each training shard.

A shard is a run of documents of one partition. Its words become symbols: the words of the benchmark are numbered, any
other word is symbol 0, which no phrase holds; runs between zeros that are shorter than the shortest phrase can't hold
one and collapse into the zero. The suffixes of the remaining runs are sorted (a run ends in a unique stop, ties are
broken by position), which gives the Burrows-Wheeler symbols; a wavelet matrix answers rank queries over them.
Every distinct test phrase (window of `width` words) is searched backward, all phrases of a shard at once. The
occurrences are located by walking back to a sampled suffix position (every SAMPLE-th and each start of a run), and
their word spans are merged for each document.

Words are `[0-9A-Za-z]` and all characters beyond ASCII, with A-Z lower-cased. An item with fewer words than `width`
but at least one is one window. Defined cases: null or empty text has no words and is never hit; an item without words
is never found; repeated items are found each, repeated rows are judged each; a null item_id is counted but not
listed; an empty benchmark hits nothing. Other columns pass unchanged; columns named like a result are replaced.
The benchmark is collected for the search, and its size is checked against MAX_PHRASES.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tideline.llm.common import appended, int_lists

WIDTH = 10
SHARD_BYTES = 2 << 20
SAMPLE = 8
#: The most benchmark words that are sent to the tasks.
MAX_PHRASES = 20_000_000
_SPLIT = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_SPLIT).split()


@dataclass
class Phrases:
    """Distinct windows as symbol rows of equal length, and the items of each."""

    symbols: dict[bytes, int]
    windows: list[tuple[int, np.ndarray, np.ndarray]]  # length, symbols (windows x length), window numbers
    items: list[np.ndarray]  # item numbers by window
    names: list[str]  # id by item number
    shortest: int


def phrases(items: list[tuple[object, bytes]], width: int) -> Phrases:
    symbols: dict[bytes, int] = {}
    owners: dict[tuple[int, ...], set[int]] = {}
    for k, (_, text) in enumerate(items):
        row = [symbols.setdefault(w, len(symbols) + 1) for w in words_of(text)]
        size = min(width, len(row))
        for i in range(len(row) - size + 1 if row else 0):
            owners.setdefault(tuple(row[i : i + size]), set()).add(k)
    by_length: dict[int, list[int]] = {}
    for n, window in enumerate(owners):
        by_length.setdefault(len(window), []).append(n)
    rows = list(owners)
    windows = [(size, np.array([rows[n] for n in numbers], np.int64), np.array(numbers)) for size, numbers in by_length.items()]
    return Phrases(symbols, windows, [np.array(sorted(x)) for x in owners.values()], [None if i is None else str(i) for i, _ in items], min(by_length, default=0))


class WaveletMatrix:
    """Rank queries over a row of small integers: one bit vector for each binary digit, with counts every 64 bits."""

    def __init__(self, values: np.ndarray, digits: int):
        self.digits, self.levels = digits, []
        for d in range(digits - 1, -1, -1):
            bit = (values >> d & 1).astype(bool)
            padded = np.zeros(-(-(len(bit) + 1) // 64) * 64, bool)
            padded[: len(bit)] = bit
            blocks = np.packbits(padded, bitorder="little").view(np.uint64)
            counts = np.concatenate([[0], np.cumsum(np.bitwise_count(blocks), dtype=np.int64)])
            zeros = len(bit) - int(bit.sum())
            self.levels.append((d, blocks, counts, zeros))
            values = np.concatenate([values[~bit], values[bit]])

    @staticmethod
    def _ones(blocks: np.ndarray, counts: np.ndarray, at: np.ndarray) -> np.ndarray:
        block = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return counts[block] + np.bitwise_count(blocks[block] & below)

    def rank(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How often each symbol occurs before `low` and before `high`."""
        start = np.zeros(len(symbol), np.int64)
        for d, blocks, counts, zeros in self.levels:
            one = (symbol >> d & 1).astype(bool)
            a, b, c = (self._ones(blocks, counts, x) for x in (start, low, high))
            start, low, high = (np.where(one, zeros + x, y - x) for x, y in ((a, start), (b, low), (c, high)))
        return low - start, high - start

    def symbol_and_rank(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place and how often it occurs before it."""
        symbol, start = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        for d, blocks, counts, zeros in self.levels:
            block = at >> 6
            one = (blocks[block] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
            a, b = self._ones(blocks, counts, start), self._ones(blocks, counts, at)
            start, at = np.where(one, zeros + a, start - a), np.where(one, zeros + b, at - b)
            symbol |= one.astype(np.int64) << d
        return symbol, at - start


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Suffixes by their symbols up to the next zero, then by position; only groups still tied are sorted again."""
    n = len(text)
    order = np.argsort(text, kind="stable")
    head = np.empty(n, bool)
    head[:1] = True
    head[1:] = text[order[1:]] != text[order[:-1]]
    head |= text[order] == 0  # a stop is unique
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    step = 1
    while True:
        tied = ~head
        tied[:-1] |= ~head[1:]
        places = np.flatnonzero(tied)
        if not len(places):
            return order
        own = order[places]
        first, second = rank[own], rank[own + step]  # a tied suffix has no stop within `step`, so own + step is in the text
        again = np.lexsort((own, second, first))
        own, first, second = own[again], first[again], second[again]
        order[places] = own
        fresh = np.ones(len(own), bool)
        fresh[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
        head[places] = fresh
        starts = np.maximum.accumulate(np.where(fresh, places, 0))
        rank[own] = starts
        step *= 2


class FMIndex:
    """Backward search and location over runs of symbols that end in zeros."""

    def __init__(self, text: np.ndarray, symbols: int):
        order = suffix_order(text)
        before = np.where(order > 0, text[order - 1], 0)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols + 1))])
        self.bwt = WaveletMatrix(before, max(1, int(symbols).bit_length()))
        self.size = len(text)
        marked = (order % SAMPLE == 0) | (before == 0)
        self.sampled = WaveletMatrix(marked.astype(np.int64), 1)
        self.positions = order[marked]

    def search(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffix interval of each window (rows of symbols of one length)."""
        low, high = np.zeros(len(windows), np.int64), np.full(len(windows), self.size)
        live = np.arange(len(windows))
        for k in range(windows.shape[1] - 1, -1, -1):
            symbol = windows[live, k]
            a, b = self.bwt.rank(symbol, low[live], high[live])
            low[live], high[live] = self.first[symbol] + a, self.first[symbol] + b
            live = live[a < b]
        return low, high

    def locate(self, at: np.ndarray) -> np.ndarray:
        """Text positions of suffixes, by steps back to a sampled one."""
        out, steps, open_ = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64), np.arange(len(at))
        while len(open_):
            found, number = self.sampled.symbol_and_rank(at[open_])
            hit = found == 1
            out[open_[hit]] = self.positions[number[hit]] + steps[open_[hit]]
            open_ = open_[~hit]
            symbol, rank = self.bwt.symbol_and_rank(at[open_])
            at[open_] = self.first[symbol] + rank
            steps[open_] += 1
        return out


def shard_text(symbols: np.ndarray, lengths: np.ndarray, shortest: int) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of runs of `shortest` or more, each followed by a zero, and the word number of every symbol."""
    stops = np.zeros(len(symbols), bool)
    ends = np.cumsum(lengths)
    stops[(symbols == 0)] = True
    edge = np.zeros(len(symbols) + 1, bool)  # a run ends before this word
    edge[ends] = True
    edge[:-1] |= stops
    edge[1:] |= stops
    edge[0] = True
    bounds = np.flatnonzero(edge)
    size = np.diff(bounds)
    good = (size >= shortest) & (symbols[bounds[:-1]] != 0)
    begin, size = bounds[:-1][good], size[good]
    total = size + 1
    at = np.arange(total.sum()) - np.repeat(np.cumsum(total) - total, total)
    place = np.repeat(begin, total) + at
    stop = at == np.repeat(size, total)
    return np.where(stop, 0, symbols[np.minimum(place, len(symbols) - 1)]), place


def hits(texts: list[bytes], wanted: Phrases) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]:
    """Of each text: words, hit words, the items found; then, over all texts, which words are hit and the text of each word."""
    rows = [words_of(x) for x in texts]
    lengths = np.array([len(x) for x in rows], np.int64)
    symbols = np.fromiter(map(wanted.symbols.get, chain.from_iterable(rows), repeat(0)), np.int64, int(lengths.sum()))
    owner = np.repeat(np.arange(len(texts)), lengths)
    cover = np.zeros(len(symbols) + 1, np.int64)
    pairs: list[np.ndarray] = []
    text, place = shard_text(symbols, lengths, wanted.shortest) if wanted.shortest and len(symbols) else (np.zeros(0, np.int64),) * 2
    if len(text):
        index = FMIndex(text, len(wanted.symbols))
        for size, windows, numbers in wanted.windows:
            low, high = index.search(windows)
            count = np.maximum(high - low, 0)
            if count.any():
                at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
                start = place[index.locate(at)]
                np.add.at(cover, start, 1)
                np.add.at(cover, start + size, -1)
                seen = np.unique(owner[start] * len(wanted.items) + np.repeat(numbers, count))
                pairs.append(seen)
    hit = np.cumsum(cover[:-1]) > 0
    n_hit = np.bincount(owner[hit], minlength=len(texts))
    items: list[np.ndarray] = [np.zeros(0, np.int64)] * len(texts)
    if pairs:
        seen = np.concatenate(pairs)
        doc, window = seen // len(wanted.items), seen % len(wanted.items)
        order = np.argsort(doc, kind="stable")
        doc, window = doc[order], window[order]
        cuts = np.flatnonzero(np.diff(doc)) + 1
        for d, part in zip(doc[np.concatenate([[0], cuts])].tolist(), np.split(window, cuts)):
            items[d] = np.unique(np.concatenate([wanted.items[w] for w in part.tolist()]))
    return lengths, n_hit, items, hit, owner


def spans_of(hit: np.ndarray, owner: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merged spans (first word, end exclusive) laid end to end, and how many each text has."""
    edge = np.zeros(len(hit) + 1, bool)
    edge[np.cumsum(lengths)] = True
    before = np.concatenate([[False], hit[:-1]]) & ~edge[:-1]
    after = np.concatenate([hit[1:], [False]]) & ~edge[1:]
    first, last = np.flatnonzero(hit & ~before), np.flatnonzero(hit & ~after)
    base = np.cumsum(lengths) - lengths
    count = np.bincount(owner[first], minlength=len(lengths))
    return np.stack([first - base[owner[first]], last + 1 - base[owner[first]]], 1).ravel(), count


def contaminated(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """`docs` with n_words, n_hit, item_ids (sorted strings) and hit_spans (first word and end of each span, in turn)."""
    size = benchmark.agg(F.count("*"), F.coalesce(F.sum(F.length(item_text)), F.lit(0))).first()
    if size[1] > MAX_PHRASES:
        raise ValueError(f"the benchmark has {size[1]} characters; at most {MAX_PHRASES} are sent to the tasks")
    items = benchmark.select(item_id, F.coalesce(F.col(item_text), F.lit("")).cast("binary")).collect()
    wanted = docs.sparkSession.sparkContext.broadcast(phrases([(x[0], bytes(x[1])) for x in items], width))

    def prepare() -> Callable[[list], list]:
        def work(texts: list) -> list:
            p = wanted.value
            lengths, n_hit, found, hit, owner = hits(texts, p)
            spans, count = spans_of(hit, owner, lengths)
            names = [sorted({p.names[i] for i in x} - {None}) for x in found]
            return [
                pa.array(lengths), pa.array(n_hit.astype(np.int64)), pa.array([len(x) for x in found], pa.int64()),
                pa.array(names, pa.list_(pa.string())), int_lists(spans, count * 2, pa.int64()),
            ]

        return work

    return appended(docs, prepare, "n_words long, n_hit long, n_items long, item_ids array<string>, hit_spans array<long>", SHARD_BYTES, text)
