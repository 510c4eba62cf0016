"""Benchmark decontamination by greedy string tiling.

Words are runs of ASCII letters, digits and non-ASCII characters, lower-cased.
Shared runs of five words seed the join of documents with benchmark items.
Between an item and a document, the longest common runs are marked as tiles,
longest first and without overlap, found by running Karp-Rabin windows whose
length halves down to five. An item whose words are covered to the threshold
is contained, in whatever order its parts stand.

Every match is ranked: equal windows are taken a bounded number at a time and
only runs that can't be prolonged to the left are kept. A run that an earlier
tile has cut goes back into the queue with what is left of it, so the order is
that of a search for the longest free match before every tile.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._tokens import lean, mix, pieces, shingle_hashes, span_hashes, spans, text_bytes
from ._wordcache import ragged

SEED, COVERAGE, BLOCK_CHARS = 5, 0.75, 16_000_000
_WORD = np.zeros(256, dtype=bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_K = np.uint64(0xD1342543DE82EF95)
_PAIRS = 2_000_000  # held at once; the rest follows


def words(texts) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of a string column, and each row's offset among them."""
    data, off = text_bytes(texts)
    s, e = spans(data, off, _WORD[data])
    return span_hashes(data, s, e), np.searchsorted(s, off)


def _windows(x: np.ndarray, free: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of windows without a marked word, and their running hashes."""
    n = len(x) - width + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    pw = np.cumprod(np.r_[np.uint64(1), np.full(len(x) - 1, _K, dtype=np.uint64)], dtype=np.uint64)
    p = np.r_[np.uint64(0), np.cumsum(x * pw, dtype=np.uint64)]
    taken = np.r_[0, np.cumsum(~free)]
    at = np.flatnonzero(taken[width:] == taken[:n])
    # each window is shifted to the same power, from above, so no inverse is needed
    return at, (p[at + width] - p[at]) * pw[len(x) - 1 - at]


def _runs(a: np.ndarray, b: np.ndarray, free_a: np.ndarray, free_b: np.ndarray, width: int):
    """Queue entries (-length, start in a, start in b) of all free common runs of `width` words or more, as long as they go."""
    size = max(len(a), len(b))
    ia, ha = _windows(np.r_[a, np.zeros(size - len(a), np.uint64)], np.r_[free_a, np.zeros(size - len(a), bool)], width)
    ib, hb = _windows(np.r_[b, np.zeros(size - len(b), np.uint64)], np.r_[free_b, np.zeros(size - len(b), bool)], width)
    order = np.argsort(hb, kind="stable")
    lo, hi = np.searchsorted(hb[order], ha), np.searchsorted(hb[order], ha, "right")
    some = np.flatnonzero(hi > lo)
    upto = np.cumsum((hi - lo)[some])
    out, k = [], 0
    while k < len(some):
        end = max(k + 1, int(np.searchsorted(upto, (upto[k - 1] if k else 0) + _PAIRS, "right")))
        part = some[k:end]
        n = (hi - lo)[part]
        i, j = np.repeat(ia[part], n), ib[order[ragged(lo[part], n)]]
        k = end
        inner = (i > 0) & (j > 0)
        inner[inner] = (a[i[inner] - 1] == b[j[inner] - 1]) & free_a[i[inner] - 1] & free_b[j[inner] - 1]
        i, j = i[~inner], j[~inner]
        length = np.zeros(len(i), np.int64)
        live = np.arange(len(i))
        while len(live):
            x, y = i[live] + length[live], j[live] + length[live]
            ok = (x < len(a)) & (y < len(b))
            ok[ok] = (a[x[ok]] == b[y[ok]]) & free_a[x[ok]] & free_b[y[ok]]
            live = live[ok]
            length[live] += 1
        real = length >= width  # equal hashes of unequal windows end here
        out += zip((-length[real]).tolist(), i[real].tolist(), j[real].tolist())
    return out


def tiles(a: np.ndarray, b: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy tiling of word hashes a and b: (start in a, start in b, length), each of `least` words or more.

    Longer tiles come first; of equal ones, the leftmost in a, then in b.
    """
    free_a, free_b, out = np.ones(len(a), dtype=bool), np.ones(len(b), dtype=bool), []
    width, left = max(least, min(len(a), len(b))), len(a)
    while True:
        queue = _runs(a, b, free_a, free_b, width)
        heapq.heapify(queue)
        while queue and left >= width:
            n, x, y = heapq.heappop(queue)
            n = -n
            free = free_a[x : x + n] & free_b[y : y + n]
            if free.all():
                free_a[x : x + n] = free_b[y : y + n] = False
                out.append((x, y, n))
                left -= n
                continue
            edge = np.flatnonzero(np.diff(np.r_[False, free, False]))  # starts and ends of what is left
            for s, e in zip(edge[::2].tolist(), edge[1::2].tolist()):
                if e - s >= width:
                    heapq.heappush(queue, (s - e, x + s, y + s))
        if width <= least or left < least:
            return out
        width = max(least, width // 2)


class Benchmark:
    """Items' words and an index from seed to (item, position)."""

    def __init__(self, ids: list[int], texts: list[str | None]):
        h, off = words(pa.array(texts, pa.string()))
        self.ids, self.h, self.off = ids, h, off
        seeds, where, at = [], [], []
        self.widths = set()
        for k, (a, b) in enumerate(zip(off[:-1].tolist(), off[1:].tolist())):
            w = min(SEED, b - a)
            if w:
                self.widths.add(w)
                s = shingle_hashes(h[a:b], w)
                seeds.append(s)
                where.append(np.full(len(s), k))
                at.append(np.arange(len(s)))
        cat = lambda x, t: np.concatenate(x) if x else np.empty(0, t)
        seeds, where, at = cat(seeds, np.uint64), cat(where, np.int64), cat(at, np.int64)
        order = np.argsort(seeds, kind="stable")
        self.seeds, self.where, self.at = seeds[order], where[order], at[order]

    def find(self, texts, threshold: float) -> list[tuple[int, int, int, int, int]]:
        """(row, item id, words of the item, words covered, tiles) of items covered to the threshold."""
        h, off = words(texts)
        got, shingles = [], {}
        for w in sorted(self.widths):
            s = shingles[w] = shingle_hashes(h, w)
            if not len(s) or not len(self.seeds):
                continue
            near = np.searchsorted(self.seeds, s)
            near[near == len(self.seeds)] = 0
            p = np.flatnonzero(self.seeds[near] == s)
            r = np.searchsorted(off, p, "right") - 1
            p, r = (x[p + w <= off[r + 1]] for x in (p, r))
            # each seed once a row: what follows is bounded by rows and the index, not by repetitions
            order = np.lexsort((s[p], r))
            rows, seed = r[order], s[p[order]]
            once = np.r_[True, (rows[1:] != rows[:-1]) | (seed[1:] != seed[:-1])][: len(rows)]
            rows, seed = rows[once], seed[once]
            lo, hi = np.searchsorted(self.seeds, seed), np.searchsorted(self.seeds, seed, "right")
            cut = np.searchsorted(rows, np.arange(len(off)))
            upto = np.r_[0, np.cumsum(hi - lo)]
            k = 0
            while k < len(off) - 1:  # whole rows, a bounded number of entries at a time; a single row has no more than the index
                end = max(k + 1, int(np.searchsorted(upto[cut], upto[cut[k]] + _PAIRS, "right")) - 1)
                part = slice(cut[k], cut[end])
                if cut[end] > cut[k]:
                    got += self._candidates(rows[part], lo[part], hi[part], w, threshold)
                k = end
        out = []
        for r, k, w in sorted(got):
            own = self.h[self.off[k] : self.off[k + 1]]
            text = h[off[r] : off[r + 1]]
            pos = np.flatnonzero(np.isin(shingles[w][off[r] : off[r + 1] - w + 1], shingle_hashes(own, w)))
            near = np.unique((pos[:, None] + np.arange(w)).reshape(-1))
            gap = np.flatnonzero(np.diff(near) > 1) + 1
            # a word of no other place parts pieces that don't touch in the text
            there = np.insert(text[near], gap, mix(np.arange(1, len(gap) + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)))
            t = tiles(own, there, w)
            n = sum(x[2] for x in t)
            if n >= threshold * len(own):
                out.append((r, self.ids[k], len(own), n, len(t)))
        return out

    def _candidates(self, rows, lo, hi, w: int, threshold: float) -> list[tuple[int, int, int]]:
        """(row, item, w) where seeds cover enough of the item's words; tiles lie where seeds are."""
        n = hi - lo
        at = ragged(lo, n)
        rows, item, pos = np.repeat(rows, n), self.where[at], self.at[at]
        size = np.diff(self.off)
        ok = np.minimum(size, SEED)[item] == w
        rows, item, pos = rows[ok], item[ok], pos[ok]
        order = np.lexsort((pos, item, rows))
        rows, item, pos = rows[order], item[order], pos[order]
        if not len(rows):
            return []
        first = np.r_[True, (rows[1:] != rows[:-1]) | (item[1:] != item[:-1])]
        new = np.full(len(pos), w)
        new[1:] = np.where(first[1:], w, np.minimum(w, pos[1:] - pos[:-1]))
        start = np.flatnonzero(first)
        covered = np.add.reduceat(new, start)
        good = start[covered >= threshold * size[item[start]]]
        return [(int(rows[i]), int(item[i]), w) for i in good.tolist()]


def _blocks(benchmark: DataFrame):
    """The benchmark in blocks of about BLOCK_CHARS characters, so that none outgrows a worker."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("item_id is not null and text is not null")
    n = max(1, math.ceil((items.agg(F.sum(F.length("text"))).first()[0] or 0) / BLOCK_CHARS))
    for k in range(n):
        rows = sorted((r.item_id, r.text) for r in items.filter(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k).collect())
        yield Benchmark([r[0] for r in rows], [r[1] for r in rows])


def _find(shared, threshold: float):
    @lean
    def find(batches):
        bench = shared.value
        for batch in batches:
            for part in pieces(batch, "text", 1 << 20):
                got = bench.find(part.column("text"), threshold)
                if got:
                    ids = part.column("doc_id").to_numpy(zero_copy_only=False)
                    cols = [pa.array([ids[g[0]] for g in got], pa.int64()), *(pa.array([g[i] for g in got], pa.int64()) for i in range(1, 5))]
                    yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "item_id", "item_words", "covered_words", "tiles"])

    return find


def _clean(shared, threshold: float):
    @lean
    def clean(batches):
        bench = shared.value
        for batch in batches:
            for part in pieces(batch, "text", 1 << 20):
                keep = np.ones(part.num_rows, dtype=bool)
                keep[[g[0] for g in bench.find(part.column("text"), threshold)]] = False
                yield part.filter(pa.array(keep))

    return clean


def contaminated(documents: DataFrame, benchmark: DataFrame, threshold: float = COVERAGE) -> DataFrame:
    """doc_id, item_id, item_words, covered_words, tiles, coverage of each document and item covered to the threshold.

    documents(doc_id, text, ...), benchmark(item_id, text, ...). Null and empty
    texts, and texts without words, match nothing on either side. Items of
    fewer than five words are found only whole. Rows without doc_id or item_id
    are left out; a repeated row is returned again. Whole texts are searched.
    Empty tables give no rows.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null")
    out = None
    for block in _blocks(benchmark):
        got = docs.mapInArrow(_find(spark.sparkContext.broadcast(block), threshold), "doc_id long, item_id long, item_words long, covered_words long, tiles long")
        out = got if out is None else out.unionByName(got)
    return out.withColumn("coverage", F.col("covered_words") / F.col("item_words"))


def decontaminate(documents: DataFrame, benchmark: DataFrame, threshold: float = COVERAGE) -> DataFrame:
    """documents without rows that hold a benchmark item; all columns and other rows as they are.

    Null and empty texts and texts without words hold nothing and are kept, as
    are rows with a null doc_id unless their text holds an item. Repeated rows
    are judged alike. Whole texts are searched, however long. Columns are
    passed on whatever their names. Empty tables: of documents, no rows; of
    the benchmark, all documents.
    """
    out = documents
    for block in _blocks(benchmark):
        out = out.mapInArrow(_clean(documents.sparkSession.sparkContext.broadcast(block), threshold), documents.schema)
    return out
