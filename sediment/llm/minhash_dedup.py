"""MinHash near-duplicate detection by a multi-index Hamming join.

A document's signature is 64 min-hashes of its five-word shingles, 16 bits
each. A signature is split into 16 chunks of 4 positions. Two signatures that
differ in at most 31 positions have, by pigeonhole, a chunk that differs in at
most one, so indexing each chunk under its four one-position deletions finds
every such pair. At a Jaccard similarity of 0.75 the number of differing
positions has mean 16 and standard deviation 3.5; 31 is 4.3 deviations away.
Pairs within that distance are confirmed on the full shingle sets.

Before that a sketch, the 256 smallest shingle hashes, estimates a pair's
similarity: exactly for documents of up to 256 shingles, else within six
standard deviations; pairs below the threshold by more than that are left.

Documents with equal sets form a class first. Only the links that decide
connectivity are confirmed: in each bucket first every class with the best
connected one, then, between different components only, all pairs left within
the signature distance. No link between components is lost, and copies are not
expanded into pairs.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._components import connected_components
from ._scratch import Scratch
from ._tokens import lean, pieces, row_sets, row_words, runs, text_bytes

POSITIONS, CHUNK, DISTANCE, WIDTH = 64, 4, 31, 5
_RNG = np.random.default_rng(77)
_A = _RNG.integers(1, 1 << 62, POSITIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 1 << 63, POSITIONS, dtype=np.uint64)
_ROWS_IN_BLOCK, SKETCH, FEW, _PAIRS_OF_A_SALT, SLACK = 1024, 256, 100_000, 256, 6.0


def signature(s: np.ndarray) -> np.ndarray:
    """64 values of 16 bits; s: distinct shingle hashes, one at least."""
    low = None
    for i in range(0, len(s), 2048):
        m = (s[i : i + 2048, None] * _A + _B).min(axis=0)
        low = m if low is None else np.minimum(low, m)
    low ^= low >> np.uint64(33)
    low *= np.uint64(0xFF51AFD7ED558CCD)
    return (low >> np.uint64(48)).astype(np.uint16)


@lean
def _fingerprints(batches):
    for batch in batches:
        for part in pieces(batch, "text", 1 << 20):
            data, off = text_bytes(part.column("text"))
            _, _, h, at = row_words(data, off)
            sets = row_sets(h, at, WIDTH)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([_digest(s) for s in sets], pa.binary()),
                    pa.array([signature(s).tobytes() if len(s) else None for s in sets], pa.binary()),
                    pa.array([(s[:SKETCH] >> np.uint64(32)).astype(np.uint32).tobytes() for s in sets], pa.binary()),
                ],
                names=["doc_id", "n_shingles", "digest", "sig", "sketch"],
            )


def _digest(s: np.ndarray) -> bytes | None:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None


@lean
def _sets(batches):
    """The set of each row whose text is of the class it was joined with; other texts of that doc_id are left."""
    for batch in batches:
        for part in pieces(batch, "text", 1 << 20):
            data, off = text_bytes(part.column("text"))
            _, _, h, at = row_words(data, off)
            sets, want = row_sets(h, at, WIDTH), part.column("digest").to_pylist()
            mine = [i for i, s in enumerate(sets) if _digest(s) == want[i]]
            yield pa.RecordBatch.from_arrays([part.column("rep").take(pa.array(mine, pa.int64())), pa.array([sets[i].tobytes() for i in mine], pa.binary())], names=["rep", "shingles"])


def _keys(batches):
    chunks = POSITIONS // CHUNK
    head = (np.arange(chunks, dtype=np.int64) << np.int64(50))[None, :]
    for batch in batches:
        for i in range(0, batch.num_rows, 2000):
            b = batch.slice(i, 2000)
            sig = np.frombuffer(b"".join(b.column("sig").to_pylist()), dtype=np.uint16).astype(np.int64).reshape(-1, chunks, CHUNK)
            out = np.empty((len(sig), CHUNK, chunks), dtype=np.int64)
            for gone in range(CHUNK):
                x, y, z = (sig[:, :, k] for k in range(CHUNK) if k != gone)
                out[:, gone] = head | (gone << 48) | (x << 32) | (y << 16) | z
            ids = np.repeat(b.column("rep").to_numpy(), POSITIONS)
            yield pa.RecordBatch.from_arrays([pa.array(out.reshape(-1)), pa.array(ids)], names=["key", "rep"])


def _likely(x: np.ndarray, y: np.ndarray, similarity: int) -> bool:
    """Whether two sketches allow the similarity."""
    both = np.sort(np.concatenate([x, y]))
    # beyond the end of a full sketch nothing is known
    end = min(x[-1] if len(x) == SKETCH else 0xFFFFFFFF, y[-1] if len(y) == SKETCH else 0xFFFFFFFF)
    both = both[: np.searchsorted(both, end, "right")]
    twice = int((both[1:] == both[:-1]).sum())
    n = len(both) - twice
    slack = 0.02 if len(x) < SKETCH and len(y) < SKETCH else SLACK * (similarity / 100 * (1 - similarity / 100) / n) ** 0.5
    return twice >= (similarity / 100 - slack) * n


def _near(similarity: int):
    """Keeps pairs within the signature distance that the sketches allow."""

    @lean
    def near(batches):
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint16).reshape(-1, POSITIONS) for c in ("sig_a", "sig_b"))
                batch = batch.filter(pa.array((x != y).sum(axis=1) <= DISTANCE))
                ok = [_likely(*(np.frombuffer(v.as_buffer(), dtype=np.uint32) for v in pair), similarity) for pair in zip(batch.column("sketch_a"), batch.column("sketch_b"))]
                yield batch.select(["hub", "other", "salts"]).filter(pa.array(ok, pa.bool_()))

    return near


def _confirm(similarity: int):
    @lean
    def confirm(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("set_a"), batch.column("set_b")):
                x, y = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (x, y))
                both = len(x) + len(y) - len(np.union1d(x, y))
                keep.append(100 * both >= similarity * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("hub"), batch.column("other")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return confirm


def _across(similarity: int):
    """Pairs of different components that signatures and sketches allow, of one block of a bucket at a time.

    A pair comes from the first of its common buckets only.
    """

    @lean
    def across(batches):
        for t in runs(batches, ["key", "i", "j"]):
            c, own, rep = (t[k].to_numpy() for k in ("component", "block", "rep"))
            sig = np.frombuffer(b"".join(t["sig"].to_pylist()), dtype=np.uint16).reshape(-1, POSITIONS)
            sketch = [np.frombuffer(v, dtype=np.uint32) for v in t["sketch"].to_pylist()]
            i, j, key = t["i"][0].as_py(), t["j"][0].as_py(), t["key"][0].as_py()
            chunk, gone = key >> 50, key >> 48 & 3
            left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
            a, b = [], []
            for x in left.tolist():
                y = right[c[right] != c[x]]
                if i == j:
                    y = y[y > x]
                if not len(y):
                    continue
                same = sig[y] == sig[x]
                near = same.sum(axis=1) >= POSITIONS - DISTANCE
                y, same = y[near], same[near].reshape(-1, POSITIONS // CHUNK, CHUNK)
                full = same.sum(axis=2)
                first = (full >= CHUNK - 1).argmax(axis=1)
                at = np.arange(len(y))
                drop = np.where(full[at, first] == CHUNK, 0, same[at, first].argmin(axis=1))
                for z in y[(first == chunk) & (drop == gone)].tolist():
                    if _likely(sketch[x], sketch[z], similarity):
                        a.append(min(rep[x], rep[z]))
                        b.append(max(rep[x], rep[z]))
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return across


def _salts(members) -> F.Column:
    return F.ceil(members / F.lit(_PAIRS_OF_A_SALT))


def _oriented(pairs: DataFrame) -> DataFrame:
    """hub, other, salts of pairs(a, b): the hub is the end with more pairs, dealt over that many salts."""
    n = pairs.select(F.explode(F.array("a", "b")).alias("e")).groupBy("e").agg(F.count("*").alias("n"))
    p = pairs.join(n.select(F.col("e").alias("a"), F.col("n").alias("n_a")), "a").join(n.select(F.col("e").alias("b"), F.col("n").alias("n_b")), "b")
    left = F.col("n_a") >= F.col("n_b")
    return p.select(F.when(left, F.col("a")).otherwise(F.col("b")).alias("hub"), F.when(left, F.col("b")).otherwise(F.col("a")).alias("other"), _salts(F.greatest("n_a", "n_b")).alias("salts"))


def _with_both(pairs: DataFrame, of: DataFrame, names: list[str]) -> DataFrame:
    """pairs(hub, other, salts) with columns of(rep, names) of both ends, as name_a of the hub and name_b of the other.

    A hub's row is sent once for each of its salts, so that its pairs meet it in as many places.
    """
    hubs = pairs.select(F.col("hub").alias("rep"), "salts").distinct().join(of, "rep")
    hubs = hubs.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)))
    p = pairs.withColumn("salt", F.pmod(F.xxhash64("other"), F.col("salts")))
    p = p.join(of.select(F.col("rep").alias("other"), *[F.col(c).alias(f"{c}_b") for c in names]), "other")
    return p.join(hubs.select(F.col("rep").alias("hub"), "salt", *[F.col(c).alias(f"{c}_a") for c in names]), ["hub", "salt"])


def near_duplicates(documents: DataFrame, similarity: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of documents(doc_id, text, ...).

    similarity: percent of the union two sets must share, 75 at least.

    Pairs at exactly the least similarity are within the signature distance
    with a probability of about 0.99999, more similar ones nearly always.
    Null and empty texts and texts without words have no shingles, are linked
    with nothing and kept. Fewer than five words count as one shingle. Rows
    without doc_id are left out: nothing could name them. A repeated row is
    returned as often as it occurs. A doc_id with several texts is one
    document: it links all that its texts are linked with. An empty table
    gives no rows. Columns other than doc_id and text are not read, whatever
    their names. Texts are read whole; a task holds a few MB of them at a time,
    or one text.
    """
    if similarity < 75:
        raise ValueError("the signature distance is chosen for a similarity of 75 percent or more")
    spark = documents.sparkSession
    tmp = Scratch(spark, "minhash")
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null")
    fp = tmp.save(docs.mapInArrow(_fingerprints, "doc_id long, n_shingles long, digest binary, sig binary, sketch binary"), "fp")
    some = fp.filter("n_shingles > 0")
    # A class is known by a number of its own: one doc_id may have texts of several classes
    cls = some.groupBy("digest").agg(F.min("doc_id").alias("doc"), F.min("sig").alias("sig"), F.min("sketch").alias("sketch"), F.min("n_shingles").alias("n"))
    cls = tmp.save(cls.withColumn("rep", F.monotonically_increasing_id()), "classes")
    sigs = cls.select("rep", "sig", "sketch", "n")
    several = some.groupBy("doc_id").agg(F.min("digest").alias("low"), F.max("digest").alias("high")).filter("low <> high").select("doc_id", "low")
    same = some.join(several, "doc_id").filter("digest <> low").select("low", "digest").distinct()
    same = same.join(cls.select("digest", F.col("rep").alias("a")), "digest").join(cls.select(F.col("digest").alias("low"), F.col("rep").alias("b")), "low").select("a", "b")
    same = tmp.save(same, "same")
    keys = cls.select("rep", "sig").mapInArrow(_keys, "key long, rep long")
    many = keys.groupBy("key").agg(F.count("*").alias("members")).filter("members > 1")
    shared = tmp.save(keys.join(many, "key"), "shared")
    degree = shared.groupBy("rep").agg(F.sum("members").alias("degree"), F.max("members").alias("most"))
    hub = shared.join(degree, "rep").groupBy("key").agg(F.max(F.struct("degree", (-F.col("rep")).alias("back"), "most")).alias("top"))
    hub = hub.select("key", (-F.col("top.back")).alias("hub"), F.col("top.degree").alias("degree"), _salts(F.col("top.most")).alias("salts"))
    pairs = shared.join(hub, "key").filter("rep <> hub").groupBy(F.least("rep", "hub").alias("a"), F.greatest("rep", "hub").alias("b")).agg(F.max(F.struct("degree", "hub", "salts")).alias("t"))
    pairs = pairs.select("t.hub", F.when(F.col("t.hub") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("other"), "t.salts")
    size_ok = F.expr(f"100 * least(n_a, n_b) >= {similarity} * greatest(n_a, n_b)")
    oriented = "hub long, other long, salts long"

    def confirmed(p: DataFrame, name: str) -> DataFrame:
        want = p.select(F.explode(F.array("hub", "other")).alias("rep")).distinct().join(cls.select("rep", F.col("doc").alias("doc_id"), "digest"), "rep")
        want = tmp.save(want, f"want-{name}")
        if want.count() <= FEW:  # at most 4 MB
            want = F.broadcast(want)
        sets = tmp.save(docs.join(want, "doc_id").mapInArrow(_sets, "rep long, shingles binary").dropDuplicates(["rep"]), f"sets-{name}")
        both = _with_both(p, sets, ["shingles"]).select("hub", "other", F.col("shingles_a").alias("set_a"), F.col("shingles_b").alias("set_b"))
        out = tmp.save(both.mapInArrow(_confirm(similarity), "a long, b long"), f"links-{name}")
        tmp.drop(f"sets-{name}", f"want-{name}")
        return out

    near = _with_both(pairs, sigs, ["sig", "sketch", "n"]).filter(size_ok).select("hub", "other", "salts", "sig_a", "sig_b", "sketch_a", "sketch_b")
    first = tmp.save(near.mapInArrow(_near(similarity), oriented), "pairs-hub")
    links = confirmed(first, "hub").unionByName(same)
    comp = tmp.save(connected_components(links, tmp, "cc-hub"), "comp-hub")
    mine = shared.join(comp.select(F.col("id").alias("rep"), "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    mixed = mine.groupBy("key").agg(F.min("component").alias("c0"), F.max("component").alias("c1")).filter("c0 <> c1").select("key")
    blocks = F.ceil(F.col("members") / _ROWS_IN_BLOCK)
    rows = mine.join(mixed, "key").join(sigs.select("rep", "sig", "sketch"), "rep").withColumn("block", F.pmod(F.xxhash64("rep"), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    rows = rows.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "rep", "component", "sig", "sketch")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rest = rows.repartition(n, "key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(_across(similarity), "a long, b long")
    rest = tmp.save(rest.join(first.select(F.least("hub", "other").alias("a"), F.greatest("hub", "other").alias("b")), ["a", "b"], "left_anti"), "pairs-rest")
    if not rest.isEmpty():
        links = links.unionByName(confirmed(tmp.save(_oriented(rest), "oriented"), "rest"))
        comp = tmp.save(connected_components(links, tmp, "cc"), "comp")
    tmp.drop("shared", "same", "pairs-hub", "pairs-rest", "oriented", "links-hub", "links-rest")
    linked = comp.join(cls.select(F.col("rep").alias("id"), "doc"), "id")
    linked = linked.join(linked.groupBy("component").agg(F.min("doc").alias("c")), "component").select(F.col("id").alias("rep"), "c")
    of_class = cls.select("digest", "rep", "doc").join(linked, "rep", "left").select("digest", F.coalesce("c", "doc").alias("c"))
    out = fp.select("doc_id", "n_shingles", "digest").join(of_class, "digest", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("c", "doc_id").alias("component_id"), (F.coalesce("c", "doc_id") == F.col("doc_id")).alias("kept"))
