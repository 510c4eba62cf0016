"""Interpolated modified Kneser-Ney model of bigrams or trigrams: counted in Spark, scored from memory-mapped arrays.

Counting passes arrays, not rows: a task reduces its texts to sorted unique
hashes with counts and sends a block of them to each shard; a shard's task
merges its blocks and writes sorted arrays to the shared folder. Words are
known by 64-bit hash; a word's id is its place in the sorted hashes of all
shards, so a bigram is one exact 64-bit key. Bigrams are dealt by their first
word, so its continuations are counted in one place; the few words that make
up a thousandth of all tokens or more are dealt by both words, their partial
counts summed. Workers map the files and look up sorted batches of keys; a
shard's arrays stand in few files, and the least used maps are closed before
the process runs out of file descriptors. What words are counted for in bigrams
meets in groups of words, as many as the vocabulary needs, not the corpus.
Blocks travel as differences of their sorted keys, compressed.

With order three a bigram's id is its place in the sorted bigrams of all
shards, and a trigram is the exact 64-bit key of its first two words' id and
its third word. It lies in the shard of its first two words. Bigrams then
count in how many trigrams they are the end; those at a text's start, which
have no word before, as often as they occur. A text has one start token: its
first word is scored by the bigram.
"""

from __future__ import annotations

import json
import math
import resource
from collections import OrderedDict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ._scratch import Scratch, local_path, put_file
from ._tokens import lean, mix, pieces, row_words, runs, text_bytes

HOT, SHARD_BYTES, FLUSH, GROUP_WORDS = 1000, 16 << 20, 3_000_000, 500_000
U = np.uint64
_BLOCK = "shard int, kind int, a binary, b binary"


def _save(uri: str, **arrays: np.ndarray) -> None:
    """A file of arrays: a line of JSON that lists them, filled up to a multiple of 64 bytes, then each on such a multiple."""
    head, at = [], 0
    for name, x in arrays.items():
        head.append([name, x.dtype.str, len(x), at])
        at += -(-x.nbytes // 64) * 64
    line = json.dumps(head).encode()
    line += b" " * (-(len(line) + 1) % 64) + b"\n"
    put_file(uri, [line, *(x.tobytes() + b"\0" * (-x.nbytes % 64) for x in arrays.values())])


def _packed(x: np.ndarray) -> bytes:
    """Integers as their differences, byte planes of these, compressed."""
    x = x.astype("<u8")
    planes = np.diff(x, prepend=U(0)).view(np.uint8).reshape(-1, 8).T
    return len(x).to_bytes(8, "little") + pa.compress(np.ascontiguousarray(planes), codec="zstd", asbytes=True)


def _unpacked(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    planes = np.frombuffer(pa.decompress(data[8:], decompressed_size=8 * n, codec="zstd", asbytes=True), np.uint8).reshape(8, n)
    return np.cumsum(np.ascontiguousarray(planes.T).reshape(-1).view("<u8"), dtype=np.uint64)


def _small(x: np.ndarray) -> np.ndarray:
    return x.astype(np.min_scalar_type(int(x.max()) if len(x) else 0))


def _sum_by(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sum of n of each."""
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
    return key[first], np.add.reduceat(n, first) if len(first) else n


def _block(shard: np.ndarray, kind: int, a: np.ndarray, b: np.ndarray):
    """A row for each shard in shard (ascending), with its part of a and b; columns of b follow each other."""
    cut = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]]) if len(shard) else np.empty(0, np.int64)
    end = np.r_[cut[1:], len(shard)]
    return pa.RecordBatch.from_arrays([pa.array(shard[cut].astype(np.int32)), pa.array(np.full(len(cut), kind, np.int32)), pa.array([_packed(a[i:j]) for i, j in zip(cut, end)], pa.binary()), pa.array([_packed(b[i:j].reshape(-1, order="F")) for i, j in zip(cut, end)], pa.binary())], names=["shard", "kind", "a", "b"])


def _joined(t: pa.Table, column: str, columns: int = 1) -> np.ndarray:
    parts = [_unpacked(x).reshape(columns, -1) for x in t[column].to_pylist()]
    out = np.concatenate(parts, axis=1) if parts else np.empty((columns, 0), np.uint64)
    return out[0] if columns == 1 else out


def _count_words(bits: int):
    @lean
    def count(batches):
        held = []
        size = 0

        def flush():
            h, n = np.unique(np.concatenate(held), return_counts=True)
            return _block((h >> U(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), np.int64), 0, h, n)

        docs = 0
        for batch in batches:
            docs += batch.num_rows
            for part in pieces(batch, "text", 3 << 20):
                held.append(row_words(*text_bytes(part.column("text")))[2])
                size += len(held[-1])
                if size > FLUSH:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    return count


def _merge_words(root: str):
    @lean
    def merge(batches):
        for t in runs(batches, ["shard"]):
            s = t["shard"][0].as_py()
            h, n = _sum_by(_joined(t, "a"), _joined(t, "b"))
            _save(f"{root}/word-{s}", hash=h, count=_small(n))
            total = int(n.sum())
            hot = np.flatnonzero(n * U(HOT) >= U(max(1, total)))
            yield pa.RecordBatch.from_pydict({"shard": pa.array([s], pa.int32()), "types": pa.array([len(h)], pa.int64()), "tokens": pa.array([total], pa.int64()), "hot": pa.array([[{"at": int(i), "n": int(n[i])} for i in hot]], pa.list_(pa.struct([("at", pa.int64()), ("n", pa.int64())])))})

    return merge


@dataclass
class Layout:
    """What the driver knows of a model: a few numbers per shard."""

    root: str
    bits: int  # of a word's hash that choose its shard
    start: np.ndarray  # first id of each word shard, and the number of words
    tokens: int  # with end tokens
    documents: int
    hot: np.ndarray  # ids of hot words, ascending
    pair_bits: int
    discounts: list | None = None  # (D1, D2, D3+) of words' continuations, of bigrams, of trigrams
    continuations: int = 0
    gamma0: float = 0.0
    order: int = 2
    pair_start: np.ndarray | None = None  # first id of each bigram shard, and the number of bigrams
    triples: np.ndarray | None = None  # number of trigrams of each bigram shard
    group: np.ndarray | None = None  # first id of each group of words, and the number of words

    @property
    def words(self) -> int:
        return int(self.start[-1])

    @property
    def types(self) -> int:
        return self.words + (self.documents > 0)

    def shard_of(self, pair: np.ndarray) -> np.ndarray:
        first = pair >> U(32)
        h = mix(first)
        hot = np.isin(first, self.hot.astype(np.uint64))
        h[hot] = mix(pair[hot])
        return (h >> U(64 - self.pair_bits)).astype(np.int64) if self.pair_bits else np.zeros(len(pair), np.int64)


#: Which file of a shard an array is in.
_FILE = {"hash": "word", "count": "word", "cont": "id", "total": "id", "gamma": "id", "pair": "pair", "times": "pair", "ends": "end", "pairgamma": "end", "weights": "end", "triple": "triple", "triples": "triple"}


def _most_maps() -> int:
    """Half of the file descriptors that this process may have."""
    soft, hard = resource.getrlimit(resource.RLIMIT_NOFILE)
    if hard != soft:
        try:
            soft = 65_536 if hard == resource.RLIM_INFINITY else min(hard, 65_536)
            resource.setrlimit(resource.RLIMIT_NOFILE, (soft, hard))
        except (ValueError, OSError):
            soft = resource.getrlimit(resource.RLIMIT_NOFILE)[0]
    return max(16, soft // 2)


class Arrays:
    """Memory-mapped files of a model, opened as they are needed and kept by the worker; a missing one is an error."""

    def __init__(self, root: str):
        self.root, self.open, self.most = local_path(root), OrderedDict(), _most_maps()

    def get(self, name: str, s: int) -> np.ndarray:
        key = (_FILE[name], s)
        if key in self.open:
            self.open.move_to_end(key)
        else:
            while len(self.open) >= self.most:
                self.open.popitem(last=False)
            path = f"{self.root}/{key[0]}-{s}"
            with open(path, "rb") as f:
                line = f.readline()
            data = np.memmap(path, dtype=np.uint8, mode="r")
            base = len(line)
            self.open[key] = {n: data[base + at : base + at + size * np.dtype(kind).itemsize].view(kind) for n, kind, size, at in json.loads(line)}
        return self.open[key][name]


_arrays: dict[str, Arrays] = {}


def _arrays_of(root: str) -> Arrays:
    if root not in _arrays:
        _arrays.clear()
        _arrays[root] = Arrays(root)
    return _arrays[root]


def _ids(m: Layout, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes as (distinct hashes' ids with -1 for unknown words, inverse)."""
    u, inverse = np.unique(h, return_inverse=True)
    arrays, out = _arrays_of(m.root), np.full(len(u), -1, dtype=np.int64)
    shard = (u >> U(64 - m.bits)).astype(np.int64) if m.bits else np.zeros(len(u), np.int64)
    edge = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1], True]) if len(u) else np.zeros(1, np.int64)
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
        s = int(shard[a])
        if m.start[s + 1] == m.start[s]:
            continue
        have = arrays.get("hash", s)
        at = np.searchsorted(have, u[a:b])
        ok = at < len(have)
        ok[ok] = have[at[ok]] == u[a:b][ok]
        out[a:b][ok] = at[ok] + m.start[s]
    return out, inverse


def _gather(m: Layout, name: str, ids: np.ndarray, extra: np.ndarray) -> np.ndarray:
    """Values by id for ascending ids; ids from the number of words on come from extra, -1 is 0."""
    out = np.zeros(len(ids), dtype=np.float64)
    start = m.start if _FILE[name] == "word" else m.group
    edge = np.searchsorted(ids, np.r_[start, np.iinfo(np.int64).max])
    arrays = _arrays_of(m.root)
    for s in np.flatnonzero(np.diff(edge)).tolist():
        own = slice(edge[s], edge[s + 1])
        out[own] = extra[ids[own] - m.words] if s == len(start) - 1 else arrays.get(name, s)[ids[own] - start[s]]
    return out


def _pairs(m: Layout, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and second id of each token's bigram (unknown: -1; end: words, start: words + 1), and each row's offset."""
    _, _, h, row = row_words(data, off)
    ids, inverse = _ids(m, h)
    at = row + np.arange(len(row))  # an end token more for each row
    second = np.full(len(h) + len(row) - 1, m.words, dtype=np.int64)
    second[np.arange(len(h)) + np.searchsorted(row[1:], np.arange(len(h)), "right")] = ids[inverse]
    first = np.empty_like(second)
    first[1:] = second[:-1]
    first[at[:-1]] = m.words + 1
    return first, second, at


def _pair_ids(m: Layout, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Id of each bigram, -1 for unknown ones."""
    out = np.full(len(first), -1, dtype=np.int64)
    both = np.flatnonzero((first >= 0) & (second >= 0))
    key, inverse = np.unique(first[both].astype(np.uint64) << U(32) | second[both].astype(np.uint64), return_inverse=True)
    shard, arrays = m.shard_of(key), _arrays_of(m.root)
    order = np.argsort(shard, kind="stable")
    edge = np.searchsorted(shard[order], np.arange((1 << m.pair_bits) + 1))
    ids = np.full(len(key), -1, dtype=np.int64)
    for s in np.flatnonzero(np.diff(edge)).tolist():
        own = order[edge[s] : edge[s + 1]]
        if m.pair_start[s + 1] > m.pair_start[s]:
            have = arrays.get("pair", s)
            p = np.minimum(np.searchsorted(have, key[own]), len(have) - 1)
            ids[own] = np.where(have[p] == key[own], p + m.pair_start[s], -1)
    out[both] = ids[inverse]
    return out


def _by_pair(m: Layout, name: str, pair: np.ndarray) -> np.ndarray:
    """Values by id of bigram; -1 is 0."""
    u, inverse = np.unique(pair, return_inverse=True)
    out, arrays = np.zeros(len(u)), _arrays_of(m.root)
    edge = np.searchsorted(u, m.pair_start)
    for s in np.flatnonzero(np.diff(edge)).tolist():
        own = slice(edge[s], edge[s + 1])
        x = arrays.get(name, s)[u[own] - m.pair_start[s]]
        out[own] = arrays.get("weights", s)[x] if name == "pairgamma" else x
    return out[inverse]


def _before(pair: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The bigram before each token, -1 for the first of a row."""
    out = np.full_like(pair, -1)
    out[1:] = pair[:-1]
    out[off[:-1]] = -1
    return out


def _count_triples(m: Layout):
    @lean
    def count(batches):
        held, size = [], 0

        def flush():
            key, n = np.unique(np.concatenate(held), return_counts=True)
            return _block(np.searchsorted(m.pair_start, (key >> U(32)).astype(np.int64), "right") - 1, 0, key, n)

        for batch in batches:
            for part in pieces(batch, "text", 3 << 20):
                first, second, off = _pairs(m, *text_bytes(part.column("text")))
                context = _before(_pair_ids(m, first, second), off)
                some = context >= 0
                held.append(context[some].astype(np.uint64) << U(32) | second[some].astype(np.uint64))
                size += len(held[-1])
                if size > FLUSH:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    return count


def _count_pairs(m: Layout):
    @lean
    def count(batches):
        held, size = [], 0

        def flush():
            key, n = np.unique(np.concatenate(held), return_counts=True)
            shard = m.shard_of(key)
            order = np.argsort(shard, kind="stable")
            return _block(shard[order], 0, key[order], n[order])

        for batch in batches:
            for part in pieces(batch, "text", 3 << 20):
                first, second, _ = _pairs(m, *text_bytes(part.column("text")))
                held.append(first.astype(np.uint64) << U(32) | second.astype(np.uint64))
                size += len(first)
                if size > FLUSH:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    return count


def _of_counts(n: np.ndarray) -> list[int]:
    return [int((n == k).sum()) for k in (1, 2, 3, 4)] + [int((n >= 3).sum())]


def _row(shard: int, kind: int, *numbers: int):
    return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([kind], pa.int32()), pa.array([np.array(numbers, "<u8").tobytes()], pa.binary()), pa.array([b""], pa.binary())], names=["shard", "kind", "a", "b"])


def _numbers(rows: DataFrame, where: str) -> list[tuple[int, list[int]]]:
    """(shard, numbers) of the rows that _row made."""
    return [(r.shard, np.frombuffer(r.a, "<u8").astype(np.int64).tolist()) for r in rows.filter(where).select("shard", "a").collect()]


def _to_words(m: Layout, key: np.ndarray, n: np.ndarray):
    """Blocks to the words' groups: continuations of second words (kind 1); of contexts the total and how many occur once, twice, more (kind 2)."""
    second, cont = np.unique(key & U(0xFFFFFFFF), return_counts=True)
    yield _block(np.searchsorted(m.group, second.astype(np.int64), "right") - 1, 1, second, cont)
    first = key >> U(32)
    cut = np.flatnonzero(np.r_[True, first[1:] != first[:-1]])
    sums = np.stack([np.add.reduceat(x.astype(np.uint64), cut) for x in (n, n == 1, n == 2, n >= 3)], axis=1)
    yield _block(np.searchsorted(m.group, first[cut].astype(np.int64), "right") - 1, 2, first[cut], sums)


def _merge_triples(m: Layout):
    """Writes a shard's trigrams; sends, to the shards of their last two words, how many end in them."""

    @lean
    def merge(batches):
        for t in runs(batches, ["shard"]):
            s = t["shard"][0].as_py()
            key, n = _sum_by(_joined(t, "a"), _joined(t, "b"))
            _save(f"{m.root}/triple-{s}", triple=key, triples=_small(n))
            yield _row(-1, 0, *_of_counts(n))
            yield _row(-2 - s, 0, len(key))
            for i in range(0, len(key), FLUSH):
                part = key[i : i + FLUSH]
                middle = _arrays_of(m.root).get("pair", s)[(part >> U(32)).astype(np.int64) - m.pair_start[s]] & U(0xFFFFFFFF)
                pair, cont = np.unique(_pair_ids(m, middle.astype(np.int64), (part & U(0xFFFFFFFF)).astype(np.int64)), return_counts=True)
                yield _block(np.searchsorted(m.pair_start, pair, "right") - 1, 1, pair.astype(np.uint64), cont)

    return merge


def _merge_ends(m: Layout, discounts):
    """Per shard of bigrams: how many trigrams end in each, and its back-off weight as a context; sends bigrams on."""

    @lean
    def merge(batches):
        for t in runs(batches, ["shard"]):
            s = t["shard"][0].as_py()
            arrays, lo = _arrays_of(m.root), int(m.pair_start[s])
            key = np.array(arrays.get("pair", s))
            part = t.filter(pa.array(t["kind"].to_numpy() == 1))
            ends = np.bincount(_joined(part, "a").astype(np.int64) - lo, _joined(part, "b"), len(key)).astype(np.uint64)
            ends = np.where(key >> U(32) == U(m.words + 1), arrays.get("times", s), ends).astype(np.uint64)
            context, n = np.empty(0, np.int64), np.empty(0, np.int64)
            if m.triples[s]:
                context, n = (arrays.get("triple", s) >> U(32)).astype(np.int64) - lo, np.array(arrays.get("triples", s), dtype=np.int64)
            gamma = np.bincount(context, n - _less(n, discounts), len(key)) / np.maximum(np.bincount(context, n, len(key)), 1)
            weights, which = np.unique(gamma, return_inverse=True)  # few differ
            _save(f"{m.root}/end-{s}", ends=_small(ends), pairgamma=_small(which), weights=weights)
            yield _row(-1, 0, *_of_counts(ends))
            yield from _to_words(m, key, ends)

    return merge


def _merge_pairs(m: Layout):
    """Writes a shard's bigrams; sends them on with order two, and else their number."""

    @lean
    def merge(batches):
        for t in runs(batches, ["shard"]):
            s = t["shard"][0].as_py()
            key, n = _sum_by(_joined(t, "a"), _joined(t, "b"))
            _save(f"{m.root}/pair-{s}", pair=key, times=_small(n))
            yield _row(-1, 0, *_of_counts(n))
            yield _row(-2 - s, 0, len(key))
            if m.order == 2:
                yield from _to_words(m, key, n)
            else:
                yield _row(s, 0, len(key))

    return merge


def _merge_ids(m: Layout, discounts):
    """Per group of words: continuation counts and the contexts' totals and back-off weights, in order of id."""

    @lean
    def merge(batches):
        for t in runs(batches, ["shard"]):
            s = t["shard"][0].as_py()
            lo = int(m.group[s])
            size = int(m.group[s + 1]) - lo if s < len(m.group) - 1 else 2
            kinds = t["kind"].to_numpy()
            of_second, of_first = (t.filter(pa.array(kinds == k)) for k in (1, 2))
            by_id = lambda part, x: np.bincount(_joined(part, "a").astype(np.int64) - lo, x, size).astype(np.int64)
            cont = by_id(of_second, _joined(of_second, "b"))
            total, once, twice, more = (by_id(of_first, x) for x in _joined(of_first, "b", 4))
            d1, d2, d3 = discounts
            gamma = (d1 * once + d2 * twice + d3 * more) / np.maximum(total, 1)
            gamma[total == 0] = 1.0
            _save(f"{m.root}/id-{s}", cont=_small(cont), total=_small(total), gamma=gamma)
            yield pa.RecordBatch.from_arrays([pa.array([_of_counts(cont)], pa.list_(pa.int64())), pa.array([int(cont.sum())], pa.int64())], names=["of", "cont"])

    return merge


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from counts of counts; within 0 and the count where these are too few."""
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    d = (1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5)
    return tuple(min(max(x, 0.05), k) for k, x in zip((1.0, 2.0, 3.0), d))


def _less(n: np.ndarray, d) -> np.ndarray:
    """Counts less their discounts."""
    return n - np.choose(np.clip(n, 0, 3).astype(int), (0.0, *d))


def _added(rows: DataFrame) -> list[int]:
    """Counts of counts of all shards, 1 to 4."""
    return np.sum([x for _, x in _numbers(rows, "shard = -1")] or [[0] * 5], axis=0)[:4].tolist()


def _sizes(rows: DataFrame, shards: int) -> np.ndarray:
    out = np.zeros(shards, np.int64)
    for s, (n,) in _numbers(rows, "shard < -1"):
        out[-2 - s] = n
    return out


def train(documents: DataFrame, tmp: Scratch, order: int = 2) -> Layout:
    """Count documents(text, ...) and write the model's arrays, of order two or three, to the scratch folder."""
    if order not in (2, 3):
        raise ValueError("order is two or three")
    spark = documents.sparkSession
    docs = documents.select(F.col("text").cast("string").alias("text"))
    n_docs, size = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    bits = max(3, math.ceil(math.log2(max(1, size / SHARD_BYTES))))
    parts = max(1 << bits, int(spark.conf.get("spark.sql.shuffle.partitions")))
    root = tmp.path("model")

    def dealt(df: DataFrame) -> DataFrame:
        return df.repartition(parts, "shard").sortWithinPartitions("shard")

    words = dealt(docs.mapInArrow(_count_words(bits), _BLOCK)).mapInArrow(_merge_words(root), "shard int, types long, tokens long, hot array<struct<at:bigint,n:bigint>>")
    got = {r.shard: r for r in tmp.save(words, "words").collect()}
    start = np.r_[0, np.cumsum([got[s].types if s in got else 0 for s in range(1 << bits)])].astype(np.int64)
    tokens = sum(r.tokens for r in got.values()) + n_docs
    hot = sorted(int(start[s]) + x["at"] for s, r in got.items() for x in r.hot if x["n"] * HOT >= tokens)
    if int(start[-1]) >= 1 << 32:
        raise ValueError("more than 2**32 words: ids no longer fit half a key")
    groups = min(1 << bits, max(8, math.ceil(int(start[-1]) / GROUP_WORDS)))
    m = Layout(root, bits, start, tokens, n_docs, np.array([*hot, int(start[-1]), int(start[-1]) + 1], dtype=np.int64), bits + 1, order=order)
    m.group = np.arange(groups + 1, dtype=np.int64) * int(start[-1]) // groups
    pairs = dealt(docs.mapInArrow(_count_pairs(m), _BLOCK)).mapInArrow(_merge_pairs(m), _BLOCK)
    pairs = tmp.save(pairs, "pairs")
    m.pair_start = np.r_[0, np.cumsum(_sizes(pairs, 1 << m.pair_bits))].astype(np.int64)
    of_triples = []
    if order == 3:
        if int(m.pair_start[-1]) >= 1 << 32:
            raise ValueError("more than 2**32 bigrams: ids no longer fit half a key")
        triples = tmp.save(dealt(docs.mapInArrow(_count_triples(m), _BLOCK)).mapInArrow(_merge_triples(m), _BLOCK), "triples")
        of_triples = [discounts(*_added(triples))]
        m.triples = _sizes(triples, 1 << m.pair_bits)
        ends = dealt(pairs.filter("shard >= 0").unionByName(triples.filter("shard >= 0"))).mapInArrow(_merge_ends(m, of_triples[0]), _BLOCK)
        pairs = tmp.save(ends, "ends")
        tmp.drop("pairs", "triples")
    of_pairs = discounts(*_added(pairs))
    ids = dealt(pairs.filter("shard >= 0")).mapInArrow(_merge_ids(m, of_pairs), "of array<bigint>, cont long")
    rows = ids.collect()
    tmp.drop("ends" if order == 3 else "pairs")
    of = np.sum([r.of for r in rows], axis=0) if rows else np.zeros(5, dtype=np.int64)
    of_words = discounts(*of[:4].tolist())
    m.discounts, m.continuations = [of_words, of_pairs, *of_triples], sum(r.cont for r in rows)
    m.gamma0 = float(of_words[0] * of[0] + of_words[1] * of[1] + of_words[2] * of[4]) / m.continuations if m.continuations else 1.0
    return m


def _triple_times(m: Layout, context: np.ndarray, last: np.ndarray) -> np.ndarray:
    """How often each trigram occurs in training; context is a known bigram."""
    out, arrays = np.zeros(len(context)), _arrays_of(m.root)
    known = np.flatnonzero(last >= 0)
    key, inverse = np.unique(context[known].astype(np.uint64) << U(32) | last[known].astype(np.uint64), return_inverse=True)
    edge = np.searchsorted((key >> U(32)).astype(np.int64), m.pair_start)
    n = np.zeros(len(key))
    for s in np.flatnonzero(np.diff(edge)).tolist():
        own = slice(edge[s], edge[s + 1])
        if m.triples[s]:
            have = arrays.get("triple", s)
            p = np.minimum(np.searchsorted(have, key[own]), len(have) - 1)
            n[own] = np.where(have[p] == key[own], arrays.get("triples", s)[p], 0)
    out[known] = n[inverse]
    return out


def _score(m: Layout):
    @lean
    def score(batches):
        arrays = _arrays_of(m.root)

        def extra(name: str) -> np.ndarray:
            """Of end and start, which are the last group."""
            return np.array(arrays.get(name, len(m.group) - 1), dtype=np.float64) if m.documents else np.zeros(2)

        rest = {name: extra(name) for name in ("cont", "total", "gamma")}
        for batch in batches:
            for part in pieces(batch, "text", 3 << 20):
                first, second, off = _pairs(m, *text_bytes(part.column("text")))
                u, at = np.unique(second, return_inverse=True)
                count = _gather(m, "count", u, np.array([m.documents, 0.0]))
                cont = _gather(m, "cont", u, rest["cont"])
                low = _less(cont, m.discounts[0]) / max(1, m.continuations) + m.gamma0 / (m.types + 1)
                base = np.log10((count + 0.5) / (m.tokens + 0.5 * (m.types + 1)))[at]
                known = (count > 0)[at]
                low = low[at]
                u, at = np.unique(first, return_inverse=True)
                total = _gather(m, "total", u, rest["total"])
                gamma = np.where(total > 0, _gather(m, "gamma", u, rest["gamma"]), 1.0)[at]
                total = np.maximum(total, 1)[at]
                pair = _pair_ids(m, first, second)
                p = _less(_by_pair(m, "times" if m.order == 2 else "ends", pair), m.discounts[1]) / total + gamma * low
                if m.order == 3:
                    context = _before(pair, off)
                    at = np.flatnonzero(context >= 0)
                    times = _triple_times(m, context[at], second[at])
                    p[at] = _less(times, m.discounts[2]) / _by_pair(m, "times", context[at]) + _by_pair(m, "pairgamma", context[at]) * p[at]
                model = np.log10(p)
                sums = [np.add.reduceat(x, off[:-1]) for x in (base, model, known.astype(np.int64))]
                with np.errstate(over="ignore"):
                    perplexity = np.power(10.0, -sums[1] / np.diff(off))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(np.diff(off)), pa.array(sums[2]), pa.array(np.full(part.num_rows, m.tokens, np.int64)), pa.array(sums[0]), pa.array(sums[1]), pa.array(perplexity)], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"])

    return score


def score(documents: DataFrame, m: Layout, held_out: Column) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and perplexity of each row of documents(doc_id, text, ...)."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_score(m), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")


def score_documents(documents: DataFrame, held_out: Column, order: int = 2) -> DataFrame:
    """Train a model of order two or three on the rows where held_out is false or null, then score all rows.

    Null and empty texts are the end token alone. Words are runs of bytes
    other than ASCII white space, A-Z lower-cased. Whole texts are counted and
    scored; repeated rows count as often as they occur. Unknown words have the
    probability left for one unseen type. Without training rows every token is
    unknown. An empty table gives no rows. Other columns are not read. A file
    of the model that is missing is an error.
    """
    tmp = Scratch(documents.sparkSession, "ngrams")
    return score(documents, train(documents.filter(~F.coalesce(held_out, F.lit(False))), tmp, order), held_out)
