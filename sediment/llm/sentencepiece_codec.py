"""SentencePiece BPE encoding and decoding in numpy, by vectorised merge rounds.

The model file is read here (pieces, scores, types, normaliser); the library is
not needed. A batch's distinct words are flat arrays of symbols. Each round
finds every word's best mergeable pair (highest score), merges its leftmost
occurrences in all words at once, and compacts the arrays, until no word has a
pair left. Words are cut where no piece of the vocabulary holds the two
characters side by side, so no merge can cross the cut.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._tokens import RAW_VALUE, lean, pieces, span_hashes, text_bytes
from ._wordcache import WordCache, ragged

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _varint(b: bytes, i: int) -> tuple[int, int]:
    x = shift = 0
    while True:
        c = b[i]
        i += 1
        x |= (c & 127) << shift
        if c < 128:
            return x, i
        shift += 7


def _fields(b: bytes):
    """(number, value) of each field of a protobuf message."""
    i = 0
    while i < len(b):
        tag, i = _varint(b, i)
        kind = tag & 7
        if kind == 0:
            v, i = _varint(b, i)
        elif kind == 2:
            n, i = _varint(b, i)
            v, i = b[i : i + n], i + n
        else:
            n = 4 if kind == 5 else 8
            v, i = b[i : i + n], i + n
        yield tag >> 3, v


class Model:
    """A BPE model with identity normalisation, a dummy prefix and byte fallback or an unknown piece."""

    def __init__(self, path: str):
        self.pieces, self.scores, self.types = [], [], []
        norm = {}
        trainer = {}
        with open(path, "rb") as f:
            for n, v in _fields(f.read()):
                if n == 1:
                    p = dict(_fields(v))
                    self.pieces.append(p.get(1, b"").decode())
                    self.scores.append(struct.unpack("<f", p.get(2, b"\0\0\0\0"))[0])
                    self.types.append(p.get(3, NORMAL))
                elif n == 2:
                    trainer = dict(_fields(v))
                elif n == 3:
                    norm = dict(_fields(v))
        if trainer.get(3, 1) != 2 or norm.get(2) or norm.get(4, 1) or not norm.get(3, 1) or not norm.get(5, 1) or {USER, UNUSED} & set(self.types):
            raise ValueError("only BPE models with identity normalisation, a dummy prefix, kept spaces and no user-defined or unused pieces")
        self.id = {p: i for i, p in enumerate(self.pieces) if self.types[i] == NORMAL}
        self.unk = self.types.index(UNKNOWN)
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if self.types[i] == BYTE}
        keys, merged = [], []
        pair = np.zeros((257, 257), dtype=bool)
        pair[256], pair[:, 256] = True, True
        for p, i in self.id.items():
            c = [min(ord(x), 256) for x in p.replace(SPACE, " ")]
            pair[c[:-1], c[1:]] = True
            for k in range(1, len(p)):
                a, b = self.id.get(p[:k]), self.id.get(p[k:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    merged.append(i)
        #: Which characters (256: any beyond Latin-1) stand side by side in a piece.
        self.pair = pair
        self.keys, self.merged = np.array(keys, dtype=np.int64), np.array(merged, dtype=np.int64)
        #: Position in order of merging: by falling score.
        place = {s: r for r, s in enumerate(sorted(set(self.scores), reverse=True))}
        rank = np.array([place[s] for s in self.scores], dtype=np.int64)
        self.rank = rank[self.merged]
        #: Pieces that can go on to a merge which comes before their own: these merge one at a time.
        early = np.zeros(len(self.pieces), dtype=bool)
        for side in (self.keys >> 32, self.keys & 0xFFFFFFFF):
            early[side[self.rank <= rank[side]]] = True
        self.early = early[self.merged]
        self._slots = 1 << max(4, (4 * len(keys)).bit_length())
        self._key, self._at = np.full(self._slots, -1, dtype=np.int64), np.zeros(self._slots, dtype=np.int64)
        for i, h in enumerate(self._home(self.keys).tolist()):
            while self._key[h] >= 0:
                h = (h + 1) % self._slots
            self._key[h], self._at[h] = keys[i], i
        self.first = np.full(0x110000, -1, dtype=np.int32)
        for p, i in self.id.items():
            if len(p) == 1:
                self.first[ord(p)] = i
        self.first[32] = self.first[ord(SPACE)]
        self.out = [bytes([int(p[3:5], 16)]) if t == BYTE else b"" if t == CONTROL else " \u2047 ".encode() if t == UNKNOWN else p.replace(SPACE, " ").encode() for p, t in zip(self.pieces, self.types)]

    def _home(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)).astype(np.int64) & (self._slots - 1)

    def _find(self, key: np.ndarray) -> np.ndarray:
        """The merge of each pair of symbols, -1 where there is none."""
        out = np.full(len(key), -1, dtype=np.int64)
        at, todo = self._home(key), np.flatnonzero(key >= 0)
        at = at[todo]
        while len(todo):
            k = self._key[at]
            hit = k == key[todo]
            out[todo[hit]] = self._at[at[hit]]
            go = ~hit & (k >= 0)
            todo, at = todo[go], (at[go] + 1) & (self._slots - 1)
        return out

    def encode_words(self, points: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, one after the other, and how many each has; points: their code points, spaces escaped or not."""
        sym = self.first[points].astype(np.int64)
        sym = np.where(sym < 0, -1 - points.astype(np.int64), sym)
        word = np.repeat(np.arange(len(size)), size)
        done_sym, done_word = [], []
        while len(sym) > 1:
            key = np.where((sym[:-1] >= 0) & (sym[1:] >= 0) & (word[:-1] == word[1:]), sym[:-1] << 32 | sym[1:] & 0xFFFFFFFF, -1)
            at = self._find(key)
            pos = np.flatnonzero(at >= 0)
            if not len(pos):
                break
            w, r = word[pos], self.rank[at[pos]]
            first = np.flatnonzero(np.r_[True, w[1:] != w[:-1]])
            low = r == np.repeat(np.minimum.reduceat(r, first), np.diff(np.r_[first, len(w)]))
            pos, w = pos[low], w[low]
            # one pair a word: others of the same score wait for the next round
            start = np.r_[True, w[1:] != w[:-1]]
            lead = np.maximum.accumulate(np.where(start, np.arange(len(pos)), 0))
            same = (key[pos] == key[pos[lead]]) & (start | ~self.early[at[pos]])
            pos, w = pos[same], w[same]
            # of touching occurrences (a a a) every second one, from the left
            start = np.r_[True, (pos[1:] != pos[:-1] + 1) | (w[1:] != w[:-1])]
            lead = np.maximum.accumulate(np.where(start, np.arange(len(pos)), 0))
            pos = pos[(np.arange(len(pos)) - lead) % 2 == 0]
            live = np.zeros(len(size), dtype=bool)
            live[word[pos]] = True
            sym[pos] = self.merged[at[pos]]
            keep = np.ones(len(sym), dtype=bool)
            keep[pos + 1] = False
            sym, word = sym[keep], word[keep]
            stay = live[word]  # finished words leave the arrays
            done_sym.append(sym[~stay])
            done_word.append(word[~stay])
            sym, word = sym[stay], word[stay]
        sym, word = np.concatenate([*done_sym, sym]), np.concatenate([*done_word, word])
        order = np.argsort(word, kind="stable")
        sym, word = sym[order], word[order]
        odd = sym < 0
        if odd.any():
            sym, word = self._fallback(sym, word, odd)
        return sym, np.bincount(word, minlength=len(size))

    def _fallback(self, sym, word, odd):
        parts, owner = [], []
        for s, w, o in zip(sym.tolist(), word.tolist(), odd.tolist()):
            ids = [s] if not o else [self.bytes[c] for c in chr(-1 - s).encode()] if self.bytes else [self.unk]
            if o and not self.bytes and parts and parts[-1] == self.unk and owner[-1] == w:
                continue
            parts += ids
            owner += [w] * len(ids)
        return np.array(parts, dtype=np.int64), np.array(owner, dtype=np.int64)

    def decode(self, ids) -> bytes:
        """Text of ids: pieces joined, escaped spaces restored, the dummy prefix dropped."""
        out = b"".join([self.out[i] for i in ids])
        return out[1:] if out[:1] == b" " else out


class Codec:
    """Encodes batches of texts; remembers a bounded number of distinct words."""

    def __init__(self, path: str):
        self.model, self.cache = Model(path), WordCache()

    def batch(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a string column, and each row's offset among them."""
        data, off = _escaped(*text_bytes(texts))
        at = np.flatnonzero((data & 0xC0) != 0x80)
        points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), dtype=np.uint32)
        kind = np.minimum(points, 256)
        cut = np.zeros(len(points), dtype=bool)
        cut[1:] = ~self.model.pair[kind[:-1], kind[1:]]
        cut[np.searchsorted(at, off[:-1][off[:-1] < len(data)])] = True
        first = np.flatnonzero(cut)
        starts = at[first]
        row = np.searchsorted(starts, off)
        h, one, inverse = np.unique(span_hashes(data, starts, np.r_[starts[1:], len(data)][: len(starts)], RAW_VALUE), return_index=True, return_inverse=True)
        if len(self.cache.off) > self.cache.most:
            self.cache.clear()
        slot = self.cache.find(h)
        new = np.flatnonzero(slot < 0)
        if len(new):
            size = (np.r_[first[1:], len(points)] - first)[one[new]]
            flat, n = self.model.encode_words(points[ragged(first[one[new]], size)], size)
            slot[new] = self.cache.add(h[new], flat, n)
        ids, size = self.cache.ids(slot[inverse])
        return ids, np.r_[0, np.cumsum(size)][row]

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        ids, row = self.batch(pa.array(texts, pa.string()))
        return [ids[a:b].tolist() for a, b in zip(row[:-1], row[1:])]

    def decode(self, ids) -> str:
        return self.model.decode(ids).decode(errors="replace")


def _escaped(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """U+2581 as a space, and a space before each text that isn't empty."""
    mark = np.flatnonzero((data[:-2] == 0xE2) & (data[1:-1] == 0x96) & (data[2:] == 0x81)) if len(data) > 2 else np.empty(0, np.int64)
    if len(mark):
        data = data.copy()
        data[mark] = 0x20
        gone = np.concatenate([mark + 1, mark + 2])
        off = off - np.searchsorted(np.sort(gone), off)
        data = np.delete(data, gone)
    full = np.flatnonzero(np.diff(off) > 0)
    return np.insert(data, off[full], 0x20), off + np.searchsorted(full, np.arange(len(off)))


_codecs: dict[str, Codec] = {}


def codec_of(path: str) -> Codec:
    """The worker's own, kept from task to task."""
    if path not in _codecs:
        _codecs.clear()
        _codecs[path] = Codec(path)
    return _codecs[path]


def _digests(path: str, keep: bool):
    @lean
    def digests(batches):
        codec = codec_of(path)
        number = [str(i).encode() for i in range(len(codec.model.pieces))]
        for batch in batches:
            for part in pieces(batch, "text", 1 << 19):
                ids, row = codec.batch(part.column("text"))
                sha, back = [], []
                for a, b in zip(row[:-1].tolist(), row[1:].tolist()):
                    own = ids[a:b].tolist()
                    sha.append(hashlib.sha256(b",".join([number[i] for i in own])).hexdigest())
                    back.append(hashlib.sha256(codec.decode(own).encode()).hexdigest())
                out = [part.column("doc_id"), pa.array(np.diff(row)), pa.array(sha, pa.string()), pa.array(back, pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if keep:
                    out.append(pa.ListArray.from_arrays(pa.array(row, pa.int32()), pa.array(ids, pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(out, names=names)

    return digests


def encode_documents(documents: DataFrame, model_path: str, ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids of each row of documents(doc_id, text, ...).

    No begin or end ids, no sampling. Null text counts as empty and has no ids.
    Very long texts are encoded whole. Repeated rows and null doc_ids are kept
    as they are; an empty table gives no rows. Other columns are not read. Each
    worker remembers a bounded number of distinct words by 64-bit hash.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_digests(model_path, ids), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids)
