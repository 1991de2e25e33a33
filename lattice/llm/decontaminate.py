"""Benchmark decontamination by suffix arrays over shards of the training text.

A shard is about SHARD_WORDS words of documents. Words become the test set's word numbers (0: a word that no item
has); stretches of known words shorter than the shortest test window can hold no window and are left out. The
suffixes of all other stretches are sorted to their very end by prefix doubling. Every test suffix that begins a
window is binary-searched in each shard: that gives the places where its window occurs, as one range of the array,
and its longest verbatim match. Longest matches of documents follow from these and from the array's own common
prefixes (LCP) by running minima. So all that is laid out is bounded by the words of the shard and of the test
set, however repetitive both are: places are marked, never paired with test places. Nothing is shuffled; the test
set is sent in parts of at most PART_WORDS words, which are looked up one after the other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WINDOW = 8
#: Words of test items that are indexed, and broadcast, at once.
PART_WORDS = 1_000_000
#: Words of a shard, and bytes of a text that are split into words at once.
SHARD_WORDS, SLICE = 1_000_000, 1 << 22
#: (document, item set) pairs that are spelled out as (document, item) at once.
SPELLED = 1 << 20


class SuffixArray:
    """All suffixes of a sequence of words (positive numbers; 0 ends a stretch), sorted to the end of their stretch."""

    def __init__(self, words: np.ndarray, top: int):
        """top: the largest number that any word, here or searched for, has."""
        n = len(words)
        self.words = np.concatenate([words.astype(np.int64), np.zeros(1, np.int64)])
        zero = np.flatnonzero(self.words == 0)
        self.run = zero[np.searchsorted(zero, np.arange(n + 1))] - np.arange(n + 1)  # words to the stretch's end
        bits = max(1, top.bit_length())
        self.step = max(1, min(8, 62 // bits))  # words of a key
        self.bits = bits
        self.key = np.zeros(n + 1 + self.step, np.int64)
        for j in range(self.step):
            self.key[: n + 1] <<= bits
            part = np.zeros(n + 1, np.int64)
            part[: max(0, n + 1 - j)] = self.words[j:]
            self.key[: n + 1] |= np.where(self.run > j, part, 0)
        at = np.flatnonzero(self.words)
        self.array = at[np.argsort(self.key[at], kind="stable")]
        #: ranks[k][p] is equal for places whose first step * 2**k words (or all that are left) are equal.
        self.ranks: list[np.ndarray] = []
        self._sort()

    def _sort(self) -> None:
        array, m = self.array, len(self.array)
        value = self.key[array]
        start = np.ones(m, bool)
        start[1:] = value[1:] != value[:-1]
        length, rank = self.step, np.zeros(len(self.words), np.int32)
        open_ = np.arange(m)  # slots of groups that are not told apart yet, whole groups at a time
        group = np.maximum.accumulate(np.where(start, open_, 0)) if m else open_
        rank[array] = group + 1
        while True:
            self.ranks.append(rank)
            # Groups with more than one member of which any stretch goes on.
            first = np.flatnonzero(start[open_])
            size = np.diff(np.append(first, len(open_)))
            on = np.logical_or.reduceat(self.run[array[open_]] > length, first) if len(first) else np.empty(0, bool)
            open_ = open_[np.repeat(on & (size > 1), size)]
            if not len(open_):
                return
            place = array[open_]
            after = np.where(self.run[place] > length, rank[np.minimum(place + length, len(rank) - 1)], 0).astype(np.int64)
            both = rank[place].astype(np.int64) * (len(rank) + 1) + after
            order = np.argsort(both, kind="stable")
            array[open_], both = place[order], both[order]
            start[open_[1:]] |= both[1:] != both[:-1]
            group = open_[np.maximum.accumulate(np.where(start[open_], np.arange(len(open_)), 0))]
            rank = rank.copy()
            rank[array[open_]] = group + 1
            length *= 2

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words the suffixes at the places a and b share at their start."""
        a, b = a.copy(), b.copy()
        length = np.zeros(len(a), np.int64)
        for k in reversed(range(len(self.ranks))):
            # Equal ranks: equal for this many words, or to the end of both.
            same = (self.ranks[k][a] == self.ranks[k][b]) & (self.run[a] > 0) & (self.run[b] > 0)
            by = np.where(same, np.minimum(np.minimum(self.run[a], self.run[b]), self.step << k), 0)
            length, a, b = length + by, a + by, b + by
        return length + self._few(a, self.words, b, self.words)

    def _few(self, a: np.ndarray, of_a: np.ndarray, b: np.ndarray, of_b: np.ndarray) -> np.ndarray:
        """Words in common from a and b on, of which there are less than a key's."""
        length, going = np.zeros(len(a), np.int64), np.ones(len(a), bool)
        for j in range(self.step):
            x, y = of_a[np.minimum(a + j, len(of_a) - 1)], of_b[np.minimum(b + j, len(of_b) - 1)]
            going &= (x == y) & (x > 0)
            length += going
        return length

    def search(self, test: np.ndarray, places: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Where each test suffix (test[p:] up to a 0) belongs: (below, above, slot, longest).

        [below, above) are the slots of suffixes that begin with its first `most` words, slot is where it would be
        put in, longest how many words it shares with the slots before and after that, whichever shares more.
        """
        low, high = np.zeros(len(places), np.int64), np.full(len(places), len(self.array), np.int64)
        words = np.concatenate([test.astype(np.int64), np.zeros(self.step + 1, np.int64)])
        zero = np.flatnonzero(words == 0)
        left = zero[np.searchsorted(zero, places)] - places
        whole = np.minimum(left, most)
        below, above = low.copy(), high.copy()
        done = 0
        going = np.arange(len(places))
        while len(going):
            p = places[going] + done
            rest = left[going] - done
            key, mask = np.zeros(len(going), np.int64), np.zeros(len(going), np.int64)
            want = np.clip(whole[going] - done, 0, self.step)
            for j in range(self.step):
                w = words[np.minimum(p + j, len(words) - 1)]
                key = (key << self.bits) | np.where(rest > j, w, 0)
                mask = (mask << self.bits) | np.where(want > j, (1 << self.bits) - 1, 0)
            asked = want > 0
            if asked.any():  # the range that shares the words asked for, within the range so far
                g = going[asked]
                k, free = key[asked] & mask[asked], ~mask[asked] & ((1 << (self.bits * self.step)) - 1)
                below[g] = self._bound(low[g], high[g], done, k, False)
                above[g] = self._bound(low[g], high[g], done, k | free, True)
            a = self._bound(low[going], high[going], done, key, False)
            b = self._bound(low[going], high[going], done, key, True)
            low[going], high[going] = a, np.where(b > a, b, a)
            done += self.step
            going = going[(b > a) & (rest > self.step)]
        before, behind = np.maximum(low - 1, 0), np.minimum(low, len(self.array) - 1)
        return below, above, low, self._shared(words, places, before, behind)

    def _shared(self, words: np.ndarray, places: np.ndarray, *slots: np.ndarray) -> np.ndarray:
        """The most words that each test suffix shares with the suffix in any of the slots."""
        best = np.zeros(len(places), np.int64)
        for s in slots:
            best = np.maximum(best, self.extend(words, places, s))
        return best

    def extend(self, words: np.ndarray, places: np.ndarray, slots: np.ndarray) -> np.ndarray:
        """Words that each test suffix shares with the suffix in the slot given for it."""
        length = np.zeros(len(places), np.int64)
        if not len(self.array):
            return length
        at, going = self.array[slots], np.arange(len(places))
        while len(going):
            got = self._few(at[going] + length[going], self.words, places[going] + length[going], words)
            length[going] += got
            going = going[got == self.step]
        return length

    def _bound(self, low: np.ndarray, high: np.ndarray, done: int, key: np.ndarray, right: bool) -> np.ndarray:
        """Binary search of each key among the keys `done` words into the suffixes of slots low to high."""
        if not done and len(low) and not low.any() and (high == len(self.array)).all():
            if not hasattr(self, "_keys"):
                self._keys = self.key[self.array]
            return np.searchsorted(self._keys, key, "right" if right else "left")
        low, high = low.copy(), high.copy()
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                return low
            middle = (low[open_] + high[open_]) // 2
            place = self.array[middle]
            value = np.where(self.run[place] > done, self.key[np.minimum(place + done, len(self.key) - 1)], 0)
            on = value <= key[open_] if right else value < key[open_]
            low[open_] = np.where(on, middle + 1, low[open_])
            high[open_] = np.where(on, high[open_], middle)


class TestIndex:
    """The word numbers of some test items and their suffixes that begin a window, sorted."""

    __test__ = False

    def __init__(self, items: list[tuple[object, list[bytes]]], window: int):
        items = sorted(items, key=lambda x: (x[0] is None, x[0] or 0, x[1]))
        self.window = window
        #: The distinct ids, in order; None for items without one, which are no item of a document's list.
        self.item_ids = list(dict.fromkeys(i for i, _ in items))
        number = {i: k for k, i in enumerate(self.item_ids)}
        self.vocabulary: dict[bytes, int] = {}
        flat: list[int] = []
        starts, items_of, sizes = [], [], []
        for i, words in items:
            starts.append(len(flat))
            items_of.append(number[i])
            sizes.append(len(words))
            flat += [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words]
            flat.append(0)
        self.words = np.asarray(flat, np.int64)
        own = SuffixArray(self.words, len(self.vocabulary))
        n = np.minimum(np.asarray(sizes, np.int64), window)
        self.shortest = int(n.min(initial=window))
        size_at, item_at = np.zeros(len(self.words) + 1, np.int64), np.zeros(len(self.words) + 1, np.int64)
        for s, c, k, w in zip(starts, sizes, items_of, n.tolist(), strict=True):
            size_at[s : s + c - w + 1], item_at[s : s + c] = w, k
        #: By window length: the test places that begin a window, as their suffixes are ordered, and of each the number of its window and its item.
        self.windows: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        #: By window length: which set of items each window has; the sets, end to end.
        self.sets: dict[int, np.ndarray] = {}
        sets: dict[bytes, int] = {}
        held: list[np.ndarray] = []
        for w in np.unique(n).tolist():
            places = own.array[size_at[own.array] == w]
            shared = own.common(places[:-1], places[1:]) if len(places) > 1 else np.empty(0, np.int64)
            name = np.concatenate([[0], np.cumsum(shared < w)])
            item = item_at[places]
            both = np.unique(name * len(self.item_ids) + item)
            of, which = both // len(self.item_ids), both % len(self.item_ids)
            of_window = []
            for some in np.split(which, np.flatnonzero(np.diff(of)) + 1):
                if some.tobytes() not in sets:
                    sets[some.tobytes()] = len(held)
                    held.append(some)
                of_window.append(sets[some.tobytes()])
            self.windows[w] = (places, name, item)
            self.sets[w] = np.asarray(of_window, np.int64)
        self.set_start = np.concatenate([[0], np.cumsum([len(x) for x in held])]).astype(np.int64)
        self.set_items = np.concatenate(held) if held else np.empty(0, np.int64)

    def numbers(self, text: str) -> np.ndarray:
        """A text's words as the test set's word numbers; 0: a word that no item has."""
        raw = common.plain_bytes(text)
        get = self.vocabulary.get
        out, a = [], 0
        while a < len(raw):
            b = len(raw) if a + SLICE >= len(raw) else raw.find(b" ", a + SLICE)
            b = len(raw) if b < 0 else b
            words = raw[a:b].split()
            out.append(np.fromiter((get(w, 0) for w in words), np.int32, len(words)))
            a = b
        return np.concatenate(out) if out else np.empty(0, np.int32)


def known_stretches(words: np.ndarray, shortest: int) -> np.ndarray:
    """The places of the words in stretches of at least `shortest` known ones."""
    known = np.concatenate([[False], words > 0, [False]])
    edges = np.flatnonzero(known[1:] != known[:-1])
    a, b = edges[::2], edges[1::2]
    a, b = a[b - a >= shortest], b[b - a >= shortest]
    mark = np.zeros(len(words) + 1, np.int64)
    mark[a] += 1
    mark[b] -= 1
    return np.flatnonzero(np.cumsum(mark[:-1]))


class Shard:
    """What of a part of the test set occurs in some documents (rows of word numbers)."""

    def __init__(self, index: TestIndex, rows: list[np.ndarray]):
        self.index, self.n = index, len(rows)
        ends = np.cumsum([len(r) + 1 for r in rows])
        words = np.zeros(int(ends[-1]) if len(rows) else 0, np.int32)  # a 0 after each document
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(rows) else np.empty(0, np.int64)
        for s, r in zip(starts.tolist(), rows, strict=True):
            words[s : s + len(r)] = r
        at = known_stretches(words, index.shortest) if index.windows else np.empty(0, np.int64)
        # Stretches end to end, a 0 after each.
        gap = np.flatnonzero(np.diff(at) > 1) + 1
        self.place = np.insert(at, gap, -1)
        self.words = np.where(self.place < 0, 0, words[self.place]) if len(at) else np.empty(0, np.int32)
        self.doc = np.where(self.place < 0, -1, np.searchsorted(starts, self.place, "right") - 1)
        self.start = starts

    def look(self, longest: bool) -> None:
        """hit: whether a word lies inside an occurring window; dirty: documents; pairs: (document, item); best: each document's longest match."""
        size = len(self.words)
        cover, index = np.zeros(size + 1, np.int64), self.index
        self.best = (np.zeros(self.n, np.int64), np.full(self.n, -1), np.full(self.n, -1))
        pairs: list[np.ndarray] = []
        array = SuffixArray(self.words, len(index.vocabulary)) if size else None
        for w, (places, name, item) in index.windows.items() if array is not None else ():
            below, above, slot, most = array.search(index.words, places, w)
            if not (above > below).any():
                continue
            # One range of slots a window; ranges of different windows have no slot in common.
            first = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]]) & (above > below))
            a, b = below[first], above[first]
            count = b - a
            slots = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(a, count)
            found = array.array[slots]
            np.add.at(cover, found, 1)
            np.add.at(cover, found + w, -1)
            which = index.sets[w][np.repeat(name[first], count)]
            pairs.append(np.unique(self.doc[found] * len(index.set_start) + which))
            if longest:
                self._longest(array, w, places, item, below, above, slot, most, a, b, slots)
        self.hit = np.cumsum(cover[:-1]) > 0
        sets = np.unique(np.concatenate(pairs)) if pairs else np.empty(0, np.int64)
        self.dirty = np.zeros(self.n, bool)
        self.dirty[sets // len(index.set_start)] = True
        self.pairs = self._spell(sets // len(index.set_start), sets % len(index.set_start))

    def _spell(self, doc: np.ndarray, which: np.ndarray) -> np.ndarray:
        """Distinct document * items + item, a bounded number at once."""
        index, out, a = self.index, np.empty(0, np.int64), 0
        size = index.set_start[which + 1] - index.set_start[which]
        total = np.cumsum(size)
        while a < len(doc):
            b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + SPELLED, "right")))
            n = size[a:b]
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(index.set_start[which[a:b]], n)
            out = np.unique(np.concatenate([out, np.repeat(doc[a:b], n) * len(index.item_ids) + index.set_items[at]]))
            a = b
        return out

    def _longest(self, array: SuffixArray, w: int, places: np.ndarray, item: np.ndarray, below: np.ndarray, above: np.ndarray, slot: np.ndarray, most: np.ndarray, a: np.ndarray, b: np.ndarray, slots: np.ndarray) -> None:
        """The longest match at each occurrence: with the test suffix next above or next below it in order."""
        here = np.flatnonzero(above > below)
        places, item, slot = places[here], item[here], slot[here]
        m = len(array.array)
        test = np.concatenate([self.index.words, np.zeros(array.step + 1, np.int64)])
        after = np.where(slot < m, array.extend(test, places, np.minimum(slot, m - 1)), 0)
        before = np.where(slot > 0, array.extend(test, places, np.maximum(slot - 1, 0)), 0)
        inner = np.ones(len(slots), bool)  # slots whose neighbour before is in the same range
        inner[np.cumsum(b - a) - (b - a)] = False
        lcp = np.zeros(len(slots), np.int64)
        lcp[inner] = array.common(array.array[slots[inner] - 1], array.array[slots[inner]])
        big = np.int64(len(test) + len(array.words) + 1)
        # Downwards: the last test suffix put in at or above a slot; a running minimum starts anew at each.
        k = np.searchsorted(slot, slots, "right") - 1
        value = np.where((k >= 0) & (slot[np.maximum(k, 0)] == slots), after[np.maximum(k, 0)], lcp)
        down = np.minimum.accumulate(value - k * big) + k * big
        # Upwards: the first one put in below a slot.
        j = np.searchsorted(slot, slots, "right")
        next_lcp = np.append(lcp[1:], 0)
        inside = j < len(slot)
        value = np.where(inside & (slot[np.minimum(j, len(slot) - 1)] == slots + 1), before[np.minimum(j, len(slot) - 1)], next_lcp)
        turned, seg = value[::-1], (len(slot) - j)[::-1]
        up = (np.minimum.accumulate(turned - seg * big) + seg * big)[::-1]
        down, up = np.where(k >= 0, down, 0), np.where(inside, up, 0)
        length = np.maximum(down, up)
        of = np.where(down >= up, np.maximum(k, 0), np.minimum(j, len(slot) - 1))
        place = array.array[slots]
        doc = self.doc[place]
        ok = length >= w
        order = np.lexsort((place[ok], -length[ok], doc[ok]))
        top = order[np.concatenate([[True], np.diff(doc[ok][order]) > 0])] if len(order) else order
        best, best_item, best_at = self.best
        for d, n, p, q in zip(doc[ok][top].tolist(), length[ok][top].tolist(), place[ok][top].tolist(), of[ok][top].tolist(), strict=True):  # one row a document
            at = int(self.place[p] - self.start[d])
            who = int(self._lowest_item(test, places, item, q, n))
            if (-n, at, who) < (-int(best[d]), int(best_at[d]), int(best_item[d])):
                best[d], best_item[d], best_at[d] = n, who, at

    @staticmethod
    def _lowest_item(test: np.ndarray, places: np.ndarray, item: np.ndarray, q: int, n: int) -> int:
        """The first of the items that have these n words; their suffixes are neighbours in order."""
        words, who = test[places[q] : places[q] + n], item[q]
        for step in (-1, 1):
            k = q + step
            while 0 <= k < len(places) and np.array_equal(test[places[k] : places[k] + n], words):
                who = min(who, item[k])
                k += step
        return who

    def spans(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, first word, word after the last) of each stretch of hit words, in order."""
        hit = np.flatnonzero(self.hit & (self.place >= 0))
        if not len(hit):
            return (np.empty(0, np.int64),) * 3  # type: ignore[return-value]
        place = self.place[hit]
        new = np.flatnonzero(np.concatenate([[True], np.diff(place) > 1]))
        last = np.append(new[1:], len(place)) - 1
        doc = self.doc[hit[new]]
        return doc, place[new] - self.start[doc], place[last] + 1 - self.start[doc]


def _pieces(row: np.ndarray, longest: int) -> list[tuple[int, np.ndarray]]:
    """(first word, words) of the pieces of a very long document; neighbours share as many words as the longest item has."""
    if len(row) <= SHARD_WORDS:
        return [(0, row)]
    step = max(SHARD_WORDS - longest, SHARD_WORDS // 2)
    return [(a, row[a : a + step + longest]) for a in range(0, len(row), step)]


def _parts(benchmark: DataFrame, part_words: int) -> Iterator[list[tuple[int | None, list[bytes]]]]:
    part: list[tuple[int | None, list[bytes]]] = []
    size = 0
    for row in benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").distinct().toLocalIterator():
        words = common.plain_words(row.text or "")
        if not words:
            continue
        part.append((row.item_id, words))
        size += len(words)
        if size >= part_words:
            yield part
            part, size = [], 0
    if part:
        yield part


def _judged(index: TestIndex, rows: list[np.ndarray], longest: bool) -> list[tuple]:
    """(spans, items, longest, its item, its place) of each row."""
    most = int(np.diff(np.flatnonzero(np.concatenate([[True], index.words == 0]))).max(initial=1))
    pieces = [(k, a, r) for k, row in enumerate(rows) for a, r in _pieces(row, most)]
    spans: list[list[tuple[int, int]]] = [[] for _ in rows]
    items: list[set] = [set() for _ in rows]
    best: list[tuple] = [(0, None, None)] * len(rows)
    a = 0
    while a < len(pieces):
        b, size = a, 0
        while b < len(pieces) and (b == a or size + len(pieces[b][2]) <= SHARD_WORDS):
            size += len(pieces[b][2])
            b += 1
        shard = Shard(index, [r for _, _, r in pieces[a:b]])
        shard.look(longest)
        for d, x, y in zip(*(v.tolist() for v in shard.spans()), strict=True):
            k, start, _ = pieces[a + d]
            spans[k].append((start + x, start + y))
        for d, i in zip((shard.pairs // max(1, len(index.item_ids))).tolist(), (shard.pairs % max(1, len(index.item_ids))).tolist(), strict=True):
            items[pieces[a + d][0]].add(index.item_ids[i])
        for d in np.flatnonzero(shard.best[0]).tolist():
            k, start, _ = pieces[a + d]
            new = (int(shard.best[0][d]), index.item_ids[int(shard.best[1][d])], start + int(shard.best[2][d]))
            best[k] = _better(best[k], new)
        a = b
    return [(s, i, *x) for s, i, x in zip(spans, items, best, strict=True)]


def _better(a: tuple, b: tuple) -> tuple:
    """The longer match; of equally long ones the first, then that of the lesser item."""
    rank = lambda x: (-x[0], x[2] if x[2] is not None else -1, x[1] is None, x[1] or 0)
    return min(a, b, key=rank)


def _union(spans: list[tuple[int, int]]) -> list[dict]:
    """Sorted spans without overlap."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [{"a": a, "b": b} for a, b in out]


_FOUND = {"n_words": "long", "spans": "array<struct<a:int,b:int>>", "items": "array<long>", "longest": "long", "longest_item": "long", "longest_at": "long"}
_TYPES = [pa.int64(), pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.int64()]


def _batches(batches: Iterator[pa.RecordBatch], index: TestIndex) -> Iterator[tuple[list[pa.RecordBatch], list[np.ndarray]]]:
    """Batches and their rows of word numbers, as many as make a shard."""
    held: list[pa.RecordBatch] = []
    rows: list[np.ndarray] = []
    size = 0
    for batch in batches:
        new = [index.numbers(t) for t in common.texts(batch)]
        held.append(batch)
        rows += new
        size += sum(map(len, new))
        if size >= SHARD_WORDS:
            yield held, rows
            held, rows, size = [], [], 0
    if held:
        yield held, rows


def _match_part(docs: DataFrame, items: list[tuple[int | None, list[bytes]]], window: int, longest: bool, first: bool, last: bool) -> DataFrame:
    """docs (doc_id, text and, unless first, what earlier parts found) with what of this part occurs; text goes with the last part."""
    sent = docs.sparkSession.sparkContext.broadcast(TestIndex(items, window))
    names = ["doc_id", *([] if last else ["text"]), *_FOUND]
    schema = ", ".join(["doc_id long", *([] if last else ["text string"]), *[f"{k} {t}" for k, t in _FOUND.items()]])

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: TestIndex = sent.value
        for held, rows in _batches(batches, index):
            found = _judged(index, rows, longest)
            at = 0
            for batch in held:
                part, sizes = found[at : at + batch.num_rows], [len(r) for r in rows[at : at + batch.num_rows]]
                at += batch.num_rows
                if not first:
                    old = [batch.column(c).to_pylist() for c in ("spans", "items", "longest", "longest_item", "longest_at")]
                    old = list(zip(*old, strict=True))
                    part = [([(x["a"], x["b"]) for x in o[0]] + f[0], set(o[1]) | f[1], *_better((o[2], o[3], o[4]), f[2:])) for o, f in zip(old, part, strict=True)]
                cols = [sizes, [_union(f[0]) for f in part], [sorted(x for x in f[1] if x is not None) for f in part], *([f[k] for f in part] for k in (2, 3, 4))]
                kept = [batch.column("doc_id"), *([] if last else [batch.column("text")])]
                yield pa.RecordBatch.from_arrays([*kept, *(pa.array(c, t) for c, t in zip(cols, _TYPES, strict=True))], names)

    return common.map_rows(docs, match, schema)


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, part_words: int = PART_WORDS, longest: bool = True) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_hit, n_items, item_ids, longest, longest_item, longest_at.

    n_hit counts the document's words inside any occurrence of a test window (window consecutive words of an
    item; an item of fewer words is one window), item_ids are the items with an occurring window, longest is
    the longest verbatim match in words (0: none), with its item and its place; of equally long ones the first,
    then that of the lesser item. Null and empty texts and items have no words and match nothing. Items without
    an id count for n_hit and longest, but are no item of item_ids. Rows with equal or null ids are judged each
    for itself (an exact repeated row, too); items repeated under one id count once. A very long document is
    looked up in pieces that overlap by the longest item; memory is bounded by a shard and the test set, however
    repetitive they are. Other columns are not read, whatever their names. An empty table gives an empty result;
    without test words nothing is hit.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    parts = list(_parts(benchmark, part_words)) or [[]]
    for k, items in enumerate(parts):
        rows = _match_part(rows, items, window, longest, k == 0, k == len(parts) - 1)
    hit = F.aggregate("spans", F.lit(0), lambda n, x: n + x["b"] - x["a"]).cast("long")
    return rows.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.col("items").alias("item_ids"), "longest", "longest_item", "longest_at")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, part_words: int = PART_WORDS) -> DataFrame:
    """docs (with all their columns) without the rows in which any test window occurs; nothing is shuffled.

    Null and empty texts stay. Items without an id count like others. Repeated rows, null ids and added columns,
    whatever their names, are kept as they are. Very long texts are looked up whole, in overlapping pieces. An
    empty table gives an empty result; without test words all rows stay.
    """
    for items in _parts(benchmark, part_words):
        docs = _without(docs, items, window)
    return docs


def _without(docs: DataFrame, items: list[tuple[int | None, list[bytes]]], window: int) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(TestIndex(items, window))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: TestIndex = sent.value
        for held, rows in _batches(batches, index):
            clean = [not f[0] for f in _judged(index, rows, False)]
            at = 0
            for batch in held:
                yield batch.filter(pa.array(clean[at : at + batch.num_rows], pa.bool_()))
                at += batch.num_rows

    return common.map_rows(docs, keep, docs.schema)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    names = F.array_join(F.array_sort(F.transform("item_ids", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(names, 256).alias("items_sha256"), (F.col("n_items") >= 2).alias("contaminated"), "longest")
