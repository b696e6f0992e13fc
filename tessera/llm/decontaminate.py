"""Benchmark decontamination: CGK random walks and repeated bit-sampling LSH over item-sized windows, exact edit verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Words, chunks, flat, mix, runs, settle

#: Walks by round: a window that meets no item walks again. Sampled steps of a key, and keys of a walk. Items with the full 0.15 edits
#: met their windows in 200 of 200 trials at every length from 3 to 80 words, with half of the walks in 0.97 and more.
ROUNDS, SAMPLED, KEYS = (1, 2, 3), 4, 64
#: Most bytes of a window: longer items have several, one of which holds no more than its share of the edits.
PART = 256
#: Windows by walks that are walked at once.
HELD = 1 << 15
#: Unbroken pieces that a run should hold at least, and of which so many more than edits are looked up at most.
LEAST, MOST = 8, 10
#: Cells of items by bins that are counted without sorting.
DENSE = 1 << 23
#: Bytes whose pieces are looked up at a time.
SLICE = 1 << 16
#: Bytes of items in one index: more items make more passes.
BLOCK = 16 << 20

ODD = np.uint64(0xD6E8FEB86659FD93)
PLAIN = np.array([chr(c).isalnum() if c < 128 else True for c in range(256)])


def plain(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Texts as lower-cased letters and digits, all else a space."""
    if column.null_count:
        column = column.fill_null("")
    buf, off = flat(pc.utf8_lower(column))
    return np.where(PLAIN[buf], buf, np.uint8(32)), off


def moves(walks: range, steps: int) -> np.ndarray:
    """Whether walk w moves on after step s at byte c, as [s, w, c]: a bit fixed by all three."""
    at = np.arange(steps, dtype=np.uint64)[:, None, None] * np.uint64(256) + np.arange(256, dtype=np.uint64)
    seeds = mix(np.arange(walks.start, walks.stop, dtype=np.uint64), 41)[:, None]
    return (mix(at ^ seeds, 42) & np.uint64(1)).astype(np.uint8)


#: Of this worker, over its tasks.
_moves: dict[range, np.ndarray] = {}


def walk(buf: np.ndarray, start: np.ndarray, steps: np.ndarray, walks: range) -> np.ndarray:
    """CGK: each step emits the byte it stands on and moves on or stays, as a bit fixed for the walk, step and byte says. The bytes
    emitted, as [step, walk, start]: strings within few edits become strings of small Hamming distance. Steps must not rise."""
    most = int(steps[0])
    if walks not in _moves or len(_moves[walks]) < most:
        _moves[walks] = moves(walks, most).reshape(most, -1)
    table = _moves[walks]
    at = np.repeat(start[None, :].astype(np.int32), len(walks), 0)
    row = (np.arange(len(walks), dtype=np.int32) * 256)[:, None]
    out = np.zeros((most, *at.shape), np.uint8)
    left = len(steps) - np.searchsorted(steps[::-1], np.arange(most), "right")
    for s in range(most):
        if left[s] < at.shape[1]:
            at = at[:, : left[s]].copy()
        out[s, :, : left[s]] = c = np.take(buf, at)
        at += np.take(table[s], row + c)
    return out


def keys(emitted: np.ndarray, steps: int, walks: range) -> np.ndarray:
    """Bit sampling: KEYS numbers a walk and start, each of the bytes at SAMPLED of the steps drawn for that walk and key."""
    drawn = mix(np.arange(walks.start * KEYS * SAMPLED, walks.stop * KEYS * SAMPLED, dtype=np.uint64), 43) % np.uint64(steps)
    drawn = drawn.astype(np.int64).reshape(len(walks), KEYS, SAMPLED)
    out = np.zeros((len(walks), KEYS, emitted.shape[2]), np.uint32)
    for w in range(len(walks)):
        for k in range(SAMPLED):
            out[w] = out[w] << np.uint32(8) | emitted[drawn[w, :, k], w]
    return out


def walked(buf: np.ndarray, start: np.ndarray, steps: np.ndarray, walks: range) -> tuple[np.ndarray, np.ndarray]:
    """Walks from each different start, and the number of each start's: as many steps as any asks for. Steps must not rise."""
    starts, at, number = np.unique(start, return_index=True, return_inverse=True)
    order = np.argsort(at, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return walk(buf, starts[order], steps[at[order]], walks), place[number]


def packed(buf: np.ndarray, n: int, shorter: tuple[int, np.ndarray] | None = None) -> np.ndarray:
    """Each run of n bytes, as a number; those of shorter runs, (length, numbers), save the work on their bytes."""
    size = max(len(buf) - n + 1, 0)
    have, out = (shorter[0], shorter[1][:size].copy()) if shorter else (0, np.zeros(size, np.uint64))
    for k in range(have, n):
        out |= buf[k : k + size].astype(np.uint64) << np.uint64(8 * k)
    return out


class Pieces:
    """Items cut into pieces of n bytes side by side. An edit breaks one piece at most, so a run within e edits of an item of p pieces
    holds p - e of them unbroken, and the places where the item would begin by them are at most e apart. Of more than e + MOST
    pieces the most common ones are left out, which leaves MOST to be found."""

    def __init__(self, n: int, items: list[tuple[int, bytes, int]]):
        self.n = n
        self.ids, self.most = (np.array([x[k] for x in items], np.int64) for k in (0, 2))
        runs_ = [packed(np.frombuffer(x, np.uint8), n) for _, x, _ in items]
        common = dict(zip(*(x.tolist() for x in np.unique(np.concatenate(runs_), return_counts=True)), strict=True))
        code, item, at = [], [], []
        self.least = np.zeros(len(items), np.int64)
        for k, (own, e) in enumerate(zip(runs_, self.most.tolist(), strict=True)):
            rare = sorted(range(0, len(own), n), key=lambda a, own=own: common[int(own[a])])[: e + MOST]
            self.least[k] = len(rare) - e
            code += [own[a] for a in rare]
            item += [k] * len(rare)
            at += rare
        code = np.array(code, np.uint64)
        order = np.argsort(code, kind="stable")
        self.item, self.at = np.array(item, np.int64)[order], np.array(at, np.int32)[order]
        self.codes, self.first, self.count = np.unique(code[order], return_index=True, return_counts=True)
        slots = self._slot(self.codes)
        self.table = np.full(1 << 20, -1, np.int32)  # a slot of several codes says so by their number
        self.table[slots] = np.where(np.bincount(slots, minlength=1 << 20)[slots] > 1, len(self.codes), np.arange(len(self.codes)))
        # bins of more places than edits, a power of two: the places of one run lie in one bin or two neighbours
        self.shift = np.array([int(e).bit_length() for e in self.most], np.int64)
        self.shifts = self.shift[self.item]
        self.ahead = int(self.at.max())
        self.low = int(self.ahead // n).bit_length()
        self.floor = int(self.least.min())
        #: Bytes from a run's bin to the end of its last piece, at most.
        self.reach = self.ahead + n + 2 * int(self.most.max()) + (2 << int(self.shift.max()))

    @staticmethod
    def _slot(code: np.ndarray) -> np.ndarray:
        return ((code * ODD) >> np.uint64(44)).view(np.int64)

    def places(self, code: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(item, from) of each item that may begin by the pieces found in `size` bytes: at from .. from + 2 bins. code: the runs of n bytes."""
        u = self.table[self._slot(code)]
        pos = np.flatnonzero(u >= 0)
        code, u = code[pos], u[pos]
        several = np.flatnonzero(u == len(self.codes))
        u[several] = np.minimum(np.searchsorted(self.codes, code[several]), len(self.codes) - 1)
        same = self.codes[u] == code
        pos, u = pos[same], u[same]
        n = self.count[u]
        row = np.repeat((self.first[u] - (np.cumsum(n) - n)).astype(np.int32), n)
        row += np.arange(len(row), dtype=np.int32)
        # an item may seem to begin before the first byte
        base = np.append(0, np.cumsum(((size + self.ahead) >> self.shift) + 2))
        cell = np.repeat(pos, n)
        cell += (self.ahead - self.at + (base[self.item] << self.shifts))[row]
        cell >>= self.shifts[row]
        if base[-1] <= max(DENSE, len(row)):
            # cells that would be left out with a piece counted as often as it stands there need no sorting; of two neighbours one has half
            n = np.bincount(cell, minlength=base[-1])
            half = np.flatnonzero(n >= (self.floor + 1) // 2)
            at = np.concatenate([half[half < len(n) - 1], half[half > 0] - 1])
            at = at[n[at] + n[at + 1] >= self.least[np.searchsorted(base, at, "right") - 1]]
            live = np.zeros(base[-1], bool)
            live[at] = live[at + 1] = True
            some = np.flatnonzero(live[cell])
            cell, row = cell[some], row[some]
        key = (cell << self.low) + self.at[row] // self.n
        key.sort()
        key = key[np.append(True, key[1:] != key[:-1])[: len(key)]] >> self.low  # a piece counts once a bin
        new = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
        both, key = np.diff(np.append(new, len(key))), key[new]
        # a bin below one that holds some counts too
        key, at = np.unique(np.append(key, key - 1), return_inverse=True)
        total = np.bincount(at, weights=np.append(both, both)).astype(np.int64)
        item = np.maximum(np.searchsorted(base, key, "right") - 1, 0)
        fine = total >= self.least[item]
        item, key = item[fine], key[fine]
        return item, ((key - base[item]) << self.shift[item]) - self.ahead


class Index:
    """The items: the words of those without room for an edit; of all others the pieces, and the parts to whose size windows are cut."""

    def __init__(self, ids: list[int], texts: list[str], ratio: float = 0.15):
        words = Words(*plain(pa.array(texts, pa.string())))
        self.ids = ids
        begin = words.at[words.begin]
        self.items = [words.bytes[x : max(x, y - 1)].tobytes() for x, y in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)]
        self.most = [int(ratio * len(x)) for x in self.items]
        self.grams = [np.unique(grams(x)) for x in self.items]
        by: dict[int, list[tuple[int, bytes, int]]] = {}
        offset, start, self.parts = [], [], []
        for i, (x, e) in enumerate(zip(self.items, self.most, strict=True)):
            cuts = np.arange(-(-len(x) // PART)) * len(x) // max(1, -(-len(x) // PART)) if e else np.zeros(0, np.int64)
            self.parts.append(range(len(offset), len(offset) + len(cuts)))
            offset += cuts.tolist()
            start += (begin[i] + cuts).tolist()
            if e:
                n = next((k for least in (LEAST, 2, 1) for k in (6, 5, 4, 3, 2) if len(x) // k - e >= least), 1)
                by.setdefault(n, []).append((i, x, e))
        #: Where a part begins in its item and in all items' bytes, and the steps of a walk that reads it to its end on average.
        self.offset, self.start = np.array(offset, np.int64), np.array(start, np.int64)
        size = np.array([-(-len(x) // max(1, len(p))) for x, p in zip(self.items, self.parts, strict=True) for _ in p], np.int64)
        self.steps = 1 << np.maximum(3, np.log2(np.maximum(3 * size // 2, 1)).astype(np.int64))
        self.bytes = np.append(words.bytes, np.full(2 * PART, 32, np.uint8))
        self.pieces = [Pieces(n, x) for n, x in sorted(by.items())]
        #: Of items without room for an edit: words, and hash to items.
        self.short: dict[int, dict[int, list[int]]] = {}
        n = np.diff(words.begin)
        for i in np.flatnonzero((np.array(self.most, np.int64) == 0) & (n > 0)):
            h = runs(words.hashes, words.begin[i : i + 1], words.begin[i + 1 : i + 2], 1)[0]
            self.short.setdefault(int(n[i]), {}).setdefault(int(h), []).append(int(i))

    def whole(self, words: Words) -> Iterator[tuple[int, int]]:
        """(text, item) of items without room for an edit, where the text holds their words."""
        h = words.hashes if self.short else ()
        for n, by in self.short.items():
            start = np.flatnonzero(np.arange(len(h)) + n <= words.begin[1:][words.doc]) if len(h) else np.zeros(0, np.int64)
            own = runs(h, start, start + n, 1) if len(start) else np.zeros(0, np.uint64)
            for s in np.flatnonzero(np.isin(own, np.array(list(by), np.uint64))):
                for i in by[int(own[s])]:
                    yield int(words.doc[start[s]]), i

    def regions(self, words: Words) -> list[tuple[int, int, int, int, int]]:
        """(text, item, from, to, last): all bytes of a text that can hold the item, which begins there at from .. last; those that overlap are
        one region. A run begins within the edits of where its unbroken pieces say."""
        found, both = [], max((p.reach for p in self.pieces), default=0)
        step = max(SLICE, 16 * both)
        for k in range(0, len(words.bytes), step):  # slices that fit the processor's cache, with what a run at their end needs
            part, code = words.bytes[k : k + step + both], None
            for pieces in self.pieces:
                code = pieces.n, packed(part, pieces.n, code)
                item, low = pieces.places(code[1], len(part))
                e, width = pieces.most[item], 1 << pieces.shift[item]
                found.append((pieces.ids[item], low + k - e, low + k + 2 * width + e, e))
        if not found or not words.n_docs:
            return []
        item, low, high, e = (np.concatenate(c) for c in zip(*found, strict=True))
        edge, size = words.at[words.begin], np.array([len(x) for x in self.items], np.int64)
        first, last = (np.clip(np.searchsorted(edge, x, "right") - 1, 0, words.n_docs - 1) for x in (low, high))
        n = last - first + 1
        text = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
        item, low, high, e = (np.repeat(x, n) for x in (item, low, high, e))
        x, y = np.maximum(low, edge[text]), np.minimum(high + size[item] + e, edge[text + 1])
        order = np.lexsort((x, item, text))
        text, item, x, y = (c[order] for c in (text, item, x, y))
        new = np.ones(len(text), bool)
        new[1:] = (text[1:] != text[:-1]) | (item[1:] != item[:-1]) | (x[1:] > y[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(text))[: len(first)] - 1
        wide = zip(text[first].tolist(), item[first].tolist(), x[first].tolist(), y[last].tolist(), strict=True)
        return [(t, i, x + a, min(y, x + b), x + last) for t, i, x, y in wide for a, b, last in able(self.grams[i], words.bytes[x:y], len(self.items[i]), self.most[i])]

    def _windows(self, words: Words, regions: list[tuple[int, int, int, int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(region, part, first byte) of each window: they begin at the words from which a region can hold a part of its item."""
        rows = []
        for r, (_, i, x, _, last) in enumerate(regions):
            for p in self.parts[i]:
                o = int(self.offset[p])
                rows.append((r, p, x + o - self.most[i] * (o > 0), last + o + self.most[i] * (o > 0) + 1))
        r, p, low, high = (np.array(c, np.int64) for c in zip(*rows, strict=True))
        a, b = np.searchsorted(words.at[:-1], low), np.searchsorted(words.at[:-1], high)
        n = np.maximum(b - a, 0)
        return np.repeat(r, n), np.repeat(p, n), words.at[np.repeat(a - (np.cumsum(n) - n), n) + np.arange(n.sum())]

    def met(self, words: Words, regions: list[tuple[int, int, int, int, int]], walks: range) -> set[int]:
        """The regions with a window and a part of their item that share a key of a walk."""
        region, part, first = self._windows(words, regions)
        buf, out = np.append(words.bytes, np.full(2 * PART, 32, np.uint8)), set()
        each = max(1, HELD // len(walks))
        order = np.lexsort((first, -self.steps[part]))
        for k in range(0, len(order), each):
            some = order[k : k + each]
            wide, here = walked(buf, first[some], self.steps[part[some]], walks)
            own, there = walked(self.bytes, self.start[part[some]], self.steps[part[some]], walks)
            for steps in np.unique(self.steps[part[some]]):
                at = np.flatnonzero(self.steps[part[some]] == steps)
                (x, i), (y, j) = (np.unique(z[at], return_inverse=True) for z in (here, there))
                mine, theirs, hit = keys(wide[:, :, x], int(steps), walks), keys(own[:, :, y], int(steps), walks), np.zeros(len(at), bool)
                for w in range(len(walks)):
                    hit |= (mine[w][:, i] == theirs[w][:, j]).any(0)
                out.update(region[some[at[hit]]].tolist())
        return out

    def search(self, words: Words) -> dict[tuple[int, int], int]:
        """(text, item) to the least distance found."""
        out = dict.fromkeys(self.whole(words), 0)
        open_, at = self.regions(words), 0
        for n in ROUNDS:
            if not open_:
                break
            met = self.met(words, open_, range(at, at + n))
            for r in met:
                t, i, x, y, _ = open_[r]
                d = self.verify(i, words.bytes[x:y].tobytes())
                if d <= self.most[i]:
                    out[t, i] = min(d, out.get((t, i), d))
            open_, at = [x for r, x in enumerate(open_) if r not in met], at + n
        return out

    def verify(self, i: int, run: bytes) -> int:
        """The least edit distance of an item to any part of a run of bytes, if it is in reach."""
        item, most = self.items[i], self.most[i]
        if item in run:
            return 0
        return distance(item, run, most)


def distance(item: bytes, text: bytes, most: int) -> int:
    """The least edit distance of the item to any run of the text (bit-parallel, exact)."""
    masks: dict[int, int] = {}
    for i, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << i
    m, full = len(item), (1 << len(item)) - 1
    pv, mv, score, best, top = full, 0, m, m, 1 << (m - 1)
    for c in text:
        eq = masks.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = ph << 1 & full, mh << 1 & full
        pv = mh | (full & ~(xv | ph))
        mv = ph & xv
        best = min(best, score)
    return best if best <= most else most + 1


def grams(text: bytes | np.ndarray) -> np.ndarray:
    """All runs of four bytes, as numbers."""
    x = np.frombuffer(text, np.uint8).astype(np.uint32)
    return x[:-3] | x[1:-2] << np.uint32(8) | x[2:-1] << np.uint32(16) | x[3:] << np.uint32(24) if len(x) > 3 else np.zeros(0, np.uint32)


def able(item_grams: np.ndarray, text: np.ndarray, size: int, most: int) -> list[tuple[int, int, int]]:
    """(from, to, last) of the parts of a text that hold all runs within `most` edits of an item of `size` bytes, which begin at from .. last:
    an edit breaks at most four runs of four, so enough of the item's stand in so many bytes and edits. item_grams: the item's different runs
    of four, sorted."""
    least, long_ = size - 3 - 4 * most, size + most
    if least <= 0:
        return [(0, len(text), len(text))]
    g = grams(text)
    total = np.zeros(len(g) + 1, np.int64)
    np.cumsum(item_grams[np.minimum(np.searchsorted(item_grams, g), len(item_grams) - 1)] == g, out=total[1:])
    ahead = max(1, min(long_ - 3, len(g)))
    live = np.flatnonzero(np.append(total[ahead:], np.full(ahead, total[-1])) - total >= least)
    if not len(live):
        return []
    cut = np.flatnonzero(np.diff(live) > long_)
    first, last = live[np.append(0, cut + 1)], live[np.append(cut, len(live) - 1)]
    return list(zip(first.tolist(), (last + long_).tolist(), last.tolist(), strict=True))


FOUND = "item_ids array<long>, distance int"


def _scan(index: Index, id_: str = "doc_id"):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, _, _ in chunks(batch):
                found: list[list[tuple[int, int]]] = [[] for _ in range(part.num_rows)]
                for (t, i), d in index.search(Words(*plain(part.column(1)))).items():
                    found[t].append((index.ids[i], d))
                yield pa.record_batch(
                    [part.column(0), pa.array([sorted((i for i, _ in f), key=lambda i: (i is None, i)) for f in found], pa.list_(pa.int64())), pa.array([min((d for _, d in f), default=None) for f in found], pa.int32())],
                    names=[id_, "item_ids", "distance"],
                )

    return scan


def _hits(index: Index):
    scan = _scan(index, "row")

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in scan(batches):
            yield found.filter(pc.is_valid(found.column("distance")))

    return hits


def blocks(items: DataFrame, block: int) -> int:
    """How many indexes of about `block` bytes the items make."""
    return -(-(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // block)


def index(items: DataFrame, n: int, k: int, ratio: float) -> Index:
    """The kth of n indexes: what one pass ships to its tasks."""
    rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).distinct().orderBy("item_id", "text").collect()
    return Index([r[0] for r in rows], [r[1] for r in rows], ratio)


def contamination(docs: DataFrame, items: DataFrame, ratio: float = 0.15, block: int = BLOCK) -> DataFrame:
    """(doc_id, contaminated, n_items, item_ids, distance): the items of which a text holds a run within ratio * length edits, both as
    lower-cased letters and digits with single spaces; the least of their distances over all places found, null without any.

    Windows of an item's size (of an item of more than PART bytes: of its equal parts, one of which has no more than its share of the edits)
    begin at the words of a text. CGK random walks turn windows and items into strings whose Hamming distance follows their edit
    distance; keys of sampled steps are compared and walks repeated until a window with the full edits has met its item with the
    recall that ROUNDS states: few walks, as keys are short. What has met is verified exactly, so that nothing is reported in error. Beforehand windows are left out that
    cannot hold an item: an edit breaks at most one of the pieces into which an item is cut, so that a run within the edits holds some unbroken.
    That loses no pair and keeps walks off most of the text.

    Items too short for one edit must match word for word. Items over `block` bytes make several passes; one index is held at a time, and
    what passes find is put together by row. Texts never travel; a null or empty text holds no item; very long texts are read whole; null
    or empty items are held by no text; equal items are all reported; an item with a null id counts, but has no id to list; null and
    repeated doc_ids stay rows of their own; no rows give no rows; extra columns are ignored."""
    docs, items = docs.select("doc_id", "text"), items.select("item_id", "text").filter("text is not null")
    n = blocks(items, block)
    if n == 1:
        found = docs.mapInArrow(_scan(index(items, 1, 0, ratio)), f"doc_id long, {FOUND}")
    elif n:
        rows = settle(docs.withColumn("row", F.monotonically_increasing_id()), "rows")
        hits = None
        for k in range(n):
            own = settle(rows.select("row", "text").mapInArrow(_hits(index(items, n, k, ratio)), f"row long, {FOUND}"), "hits")
            hits = own if hits is None else hits.unionByName(own)
        hits = hits.groupBy("row").agg(F.array_sort(F.flatten(F.collect_list("item_ids"))).alias("item_ids"), F.min("distance").alias("distance"))
        found = rows.select("row", "doc_id").join(hits, "row", "left").withColumn("item_ids", F.coalesce("item_ids", F.array().cast("array<long>")))
    else:
        found = docs.select("doc_id", F.array().cast("array<long>").alias("item_ids"), F.lit(None).cast("int").alias("distance"))
    return found.select("doc_id", F.col("distance").isNotNull().alias("contaminated"), F.size("item_ids").cast("long").alias("n_items"), F.array_join("item_ids", ",").alias("item_ids"), "distance")


def keep_clean(docs: DataFrame, items: DataFrame, ratio: float = 0.15, block: int = BLOCK) -> DataFrame:
    """The rows of docs that contamination() does not mark, each judged by its own text, with the columns of docs. A pass reads what the
    one before it kept."""

    def keep(own: Index):
        scan, at = _scan(own), docs.columns.index("text")

        def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part, _, _ in chunks(batch):
                    text = part.column(at)
                    for found in scan(iter([pa.record_batch([pa.nulls(part.num_rows, pa.int64()), text], names=["doc_id", "text"])])):
                        yield part.filter(pc.is_null(found.column("distance")))

        return kept

    items = items.select("item_id", "text").filter("text is not null")
    n, schema = blocks(items, block), docs.schema
    for k in range(n):
        docs = docs.mapInArrow(keep(index(items, n, k, ratio)), schema)
        if k + 1 < n:
            docs = settle(docs, "clean")
    return docs
