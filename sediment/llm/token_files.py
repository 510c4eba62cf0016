"""Token-id files: fixed-width bit packing with block offsets.

A file holds the documents of one range of doc_id, in ascending order:

    magic "SDBITS1\\n"; little-endian uint64: bits per id, ids, documents,
    ids per block, blocks; doc_id int64 and first id uint64 of each document;
    byte offset uint64 of each block (and of the end); the blocks.

Each block packs its ids in the least bits that hold the vocabulary, low bit
first, and starts on a byte, so any block is unpacked by itself with numpy and
any document is found by its first id.
"""

from __future__ import annotations

import gc
import json
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ._scratch import Scratch, open_file, put_file
from ._tokens import LOWER, NONSPACE, RAW_VALUE, lean, pieces, span_hashes, text_bytes
from ._wordcache import WordCache

MAGIC, BLOCK, FILE_BYTES = b"SDBITS1\n", 1 << 16, 16 << 20


def bits_for(vocabulary: int) -> int:
    """Least bits that hold the ids 0 .. vocabulary - 1."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    wide = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    return np.packbits(np.unpackbits(wide, axis=1, bitorder="little")[:, :bits].reshape(-1), bitorder="little").tobytes()


def unpack(data: bytes, n: int, bits: int) -> np.ndarray:
    """The first n ids as uint32."""
    if bits in (8, 16, 32):
        return np.frombuffer(data, dtype=f"<u{bits // 8}", count=n).astype("<u4")
    flat = np.unpackbits(np.frombuffer(data, dtype=np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    wide = np.zeros((n, 32), dtype=np.uint8)
    wide[:, :bits] = flat
    return np.packbits(wide, axis=1, bitorder="little").view("<u4").reshape(-1)


def write_ids(uri: str, doc_ids: np.ndarray, sizes: np.ndarray, blocks: list[bytes], bits: int) -> None:
    n = int(sizes.sum())
    head = np.array([bits, n, len(doc_ids), BLOCK, len(blocks)], dtype="<u8")
    first = np.cumsum(sizes) - sizes
    start = len(MAGIC) + head.nbytes + 16 * len(doc_ids) + 8 * (len(blocks) + 1)
    at = start + np.cumsum([0, *map(len, blocks)])
    put_file(uri, [MAGIC, head.tobytes(), doc_ids.astype("<i8").tobytes(), first.astype("<u8").tobytes(), at.astype("<u8").tobytes(), *blocks])


class TokenFile:
    """Random access to a written file; only the wanted blocks are read."""

    def __init__(self, uri: str):
        self.file = open_file(uri)
        head = self.file.read(len(MAGIC) + 40)
        if head[: len(MAGIC)] != MAGIC:
            raise ValueError(f"{uri} is not a token file")
        self.bits, self.n, docs, self.block, blocks = np.frombuffer(head[len(MAGIC) :], dtype="<u8").astype(int).tolist()
        self.doc_ids = np.frombuffer(self.file.read(8 * docs), dtype="<i8")
        self.first = np.append(np.frombuffer(self.file.read(8 * docs), dtype="<u8").astype(np.int64), self.n)
        self.at = np.frombuffer(self.file.read(8 * (blocks + 1)), dtype="<u8").astype(np.int64)

    def read_block(self, i: int) -> np.ndarray:
        self.file.seek(int(self.at[i]))
        return unpack(self.file.read(int(self.at[i + 1] - self.at[i])), min(self.block, self.n - i * self.block), self.bits)

    def ids(self, lo: int, hi: int) -> np.ndarray:
        """Ids lo .. hi - 1 of the file."""
        if hi <= lo:
            return np.empty(0, dtype="<u4")
        a, b = lo // self.block, (hi - 1) // self.block
        return np.concatenate([self.read_block(i) for i in range(a, b + 1)])[lo - a * self.block : hi - a * self.block]

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.first[i]), int(self.first[i + 1]))

    def documents(self):
        """The ids of each document in turn, each block read once."""
        held, base, i = np.empty(0, dtype="<u4"), 0, 0
        for a, b in zip(self.first[:-1].tolist(), self.first[1:].tolist()):
            parts = [held[a - base :]]
            while i * self.block < b:
                held, base = self.read_block(i), i * self.block
                parts.append(held)
                i += 1
            ids = np.concatenate(parts)[: b - a] if len(parts) > 1 else parts[0][: b - a]
            yield ids


#: Byte classes: 0 space, 1 letter (ASCII or two-byte Latin-1), 2 digit, 3 other ASCII, 4 anything else.
_KIND = np.full(256, 4, dtype=np.uint8)
_KIND[:128] = 3
_KIND[~NONSPACE] = 0
_KIND[[*range(65, 91), *range(97, 123)]] = 1
_KIND[48:58] = 2
_KIND[[39, 60]] = 4


def _folded(data: np.ndarray) -> np.ndarray:
    """ASCII letters in lower case, but for words with '<', which may hold a special token."""
    low = LOWER[data]
    at = np.flatnonzero(data == 60)
    if len(at):
        gap = np.flatnonzero(~NONSPACE[data])
        k = np.searchsorted(gap, at)
        for a, b in set(zip(np.r_[-1, gap][k].tolist(), np.r_[gap, len(data)][k].tolist())):
            low[a + 1 : b] = data[a + 1 : b]
    return low


# What a tokenizer must do for its words to be independent.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_PRE_TOKENIZER = {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": _SPLIT}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}


def by_words(path: str) -> bool:
    """Whether a tokenizer's words are independent of each other, so that WordEncoder may cut texts into words."""
    with open(path, encoding="utf-8") as f:
        t = json.load(f)
    m = t["model"]
    plain = m.get("type") == "BPE" and not any(m.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges"))
    marked = all("<" in x["content"] and not any(c.isspace() for c in x["content"]) and not (x["lstrip"] or x["rstrip"] or x["normalized"] or x["single_word"]) for x in t.get("added_tokens") or [])
    return plain and marked and t.get("normalizer") == _NORMALIZER and t.get("pre_tokenizer") == _PRE_TOKENIZER and not t.get("truncation")


class WordEncoder:
    """Encodes texts by their distinct words with the tokenizers library.

    Where a tokenizer's words are independent (white space separates, NFC and
    lower case come first, letters, single digits and other runs are split),
    ASCII letters are put in lower case first, as the tokenizer would; words
    with apostrophes, '<' or characters beyond Latin-1 go to the library whole;
    others are cut into the runs that it would cut them into. Texts for any
    other tokenizer go to the library whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.cache, self.by_words = Tokenizer.from_file(path), WordCache(), by_words(path)
        self.bpe = self.tokenizer.model
        self.size = self.tokenizer.get_vocab_size()

    def _units(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        n = len(data)
        kind = _KIND[data]
        # xC3 with a letter's second byte is a letter
        lead = np.flatnonzero(data[:-1] == 0xC3) if n else np.empty(0, np.int64)
        lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]
        kind[lead] = kind[lead + 1] = 1
        ns = kind != 0
        edge = np.zeros(n, dtype=bool)
        edge[off[:-1][off[:-1] < n]] = True
        st = ns.copy()
        if n:
            st[1:] &= ~ns[:-1] | edge[1:]
        starts = np.flatnonzero(st)
        word = np.cumsum(st) - 1
        hard = np.zeros(len(starts), dtype=bool)
        hard[word[kind == 4]] = True
        cut = st
        if n:
            inner = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
            cut[1:] |= inner & ns[1:] & ns[:-1] & ~hard[word[1:]]
        first = np.flatnonzero(cut)
        stop = np.r_[first[1:], n][: len(first)]
        gap = np.flatnonzero(~ns)  # a unit ends at the next space
        nxt = np.r_[gap, n][np.searchsorted(gap, first)]
        return first, np.minimum(stop, nxt), kind[first] * (~hard[word[first]]), np.searchsorted(first, off)

    def _encode(self, words: list[str], simple: list[bool]) -> list[list[int]]:
        out: list = [None] * len(words)
        rest = []
        for i, (w, plain) in enumerate(zip(words, simple)):
            if plain and w.isascii():
                out[i] = [t.id for t in self.bpe.tokenize(w.lower())]
            else:
                rest.append(i)
        for k in range(0, len(rest), 4096):
            part = rest[k : k + 4096]
            for i, e in zip(part, self.tokenizer.encode_batch([words[i] for i in part], add_special_tokens=False)):
                out[i] = e.ids
        return out

    def batch(self, texts, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a string column, `end` after each, and each row's offset among them."""
        if not self.by_words:
            return self._whole(texts, end)
        data, off = text_bytes(texts)
        data = _folded(data)
        a, b, kind, row = self._units(data, off)
        h, one, inverse = np.unique(span_hashes(data, a, b, RAW_VALUE), return_index=True, return_inverse=True)
        if len(self.cache.off) > self.cache.most:
            self.cache.clear()
        slot = self.cache.find(h)
        new = np.flatnonzero(slot < 0)
        if len(new):
            raw = data.tobytes()
            words = [raw[x:y].decode() for x, y in zip(a[one[new]].tolist(), b[one[new]].tolist())]
            gc.disable()  # millions of short-lived token objects, none in cycles
            ids = self._encode(words, (kind[one[new]] == 1).tolist())
            gc.enable()
            slot[new] = self.cache.add(h[new], np.array([x for w in ids for x in w], dtype=np.int32), np.array([len(w) for w in ids], dtype=np.int64))
        ids, size = self.cache.ids(slot[inverse])
        off = np.r_[0, np.cumsum(size)][row]
        if end is not None:
            ids, off = np.insert(ids, off[1:], end), off + np.arange(len(off))
        return ids, off


    def _whole(self, texts, end: int | None) -> tuple[np.ndarray, np.ndarray]:
        tail = [] if end is None else [end]
        ids = [e.ids + tail for e in self.tokenizer.encode_batch([t or "" for t in texts.to_pylist()], add_special_tokens=False)]
        return np.array([x for row in ids for x in row], dtype=np.int64), np.r_[0, np.cumsum([len(x) for x in ids], dtype=np.int64)]


_encoders: dict[str, WordEncoder] = {}


def encoder_of(path: str) -> WordEncoder:
    """The worker's own, kept from task to task."""
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def _writer(path: str, end: int, root: str):
    @lean
    def write(batches):
        enc, bits = encoder_of(path), None
        docs, sizes, blocks, held = [], [], [], np.empty(0, np.int64)
        bits = bits_for(max(enc.size, end + 1))
        for batch in batches:
            for part in pieces(batch, "text", 3 << 20):
                ids, off = enc.batch(part.column("text"), end)
                docs.append(part.column("doc_id").to_numpy())
                sizes.append(np.diff(off))
                held = np.concatenate([held, ids])
                full = len(held) // BLOCK * BLOCK
                blocks += [pack(held[i : i + BLOCK], bits) for i in range(0, full, BLOCK)]
                held = held[full:]
        if not docs:
            return
        if len(held):
            blocks.append(pack(held, bits))
        part, doc_ids, sizes = TaskContext.get().partitionId(), np.concatenate(docs), np.concatenate(sizes)
        write_ids(f"{root}/part-{part:06d}.bits", doc_ids, sizes, blocks, bits)
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "n_docs": pa.array([len(doc_ids)], pa.int64()), "n_ids": pa.array([int(sizes.sum())], pa.int64())})

    return write


def _reader(root: str):
    def read(batches):
        for batch in batches:
            for part, base in zip(batch.column("part").to_pylist(), batch.column("base").to_pylist()):
                f = TokenFile(f"{root}/part-{part:06d}.bits")
                crc = np.empty(len(f.doc_ids), dtype=np.int64)
                for i, ids in enumerate(f.documents()):
                    crc[i] = zlib.crc32(np.ascontiguousarray(ids, dtype="<u4"))
                yield pa.RecordBatch.from_arrays([pa.array(f.doc_ids.astype(np.int64)), pa.array(f.first[:-1] + base), pa.array(np.diff(f.first)), pa.array(crc)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return read


def write_token_files(documents: DataFrame, tokenizer: str, end: int, root: str, files: int) -> DataFrame:
    """Encode documents(doc_id, text, ...) into about `files` files under root; part, n_docs, n_ids of each.

    Documents are dealt by ranges of doc_id and sorted within; equal doc_ids
    come in order of their text's hash, so that many of them fill several
    files. Null text is empty and has the end id only. Rows without doc_id are
    left out, repeated rows are written as often as they occur. The rows of one
    range are streamed; a task holds the packed ids of its file. A text of any
    length stands in one file. An empty table gives no files.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("hash")).filter("doc_id is not null")
    dealt = docs.repartitionByRange(files, "doc_id", "hash").sortWithinPartitions("doc_id", "hash").select("doc_id", "text")
    return dealt.mapInArrow(_writer(tokenizer, end, root), "part int, n_docs long, n_ids long")


def read_token_files(parts: DataFrame, root: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files.

    One number per file passes through one task's window; there is a file for
    about 16 MB of text, eight at least.
    """
    from pyspark.sql import Window

    base = F.coalesce(F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spark = parts.sparkSession
    listed = parts.select("part", base.cast("long").alias("base")).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    return listed.mapInArrow(_reader(root), "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(documents: DataFrame, tokenizer: str, end: int = 2) -> DataFrame:
    """Write documents' ids and read them back: doc_id, start, n_tokens, ids_crc32 per row. Empty tables give no rows."""
    spark = documents.sparkSession
    tmp = Scratch(spark, "tokens")
    size = documents.agg(F.coalesce(F.sum(F.octet_length(F.col("text").cast("string"))), F.lit(0))).first()[0]
    files = max(8, math.ceil(size / FILE_BYTES))
    root = tmp.path("files")
    parts = tmp.save(write_token_files(documents, tokenizer, end, root, files), "parts")
    return read_token_files(parts, root)
