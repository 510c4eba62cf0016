"""Embedding near-duplicates by a subspace pigeonhole join.

Unit vectors with cosine c lie at squared distance 2 - 2c. A fixed random
rotation spreads that distance over the dimensions; the rotated vector is split
into blocks of eight. Of two vectors within the distance, some block holds at
most its share (in proportion to its dimensions) of the squared distance. So
each block is range-joined by itself: a tree of axis splits, fitted on a
bounded sample, cuts the block's space into cells; a vector owns its cell and
visits every later cell whose box is within the block's radius, so two vectors
meet in one place. Cells are compared in numpy, in squares of bounded size, and
every candidate is verified exactly, in double precision, on the whole vectors.
These travel as they were given, in single precision where that holds them, and
are normalised again where they are compared. A pair counts in the first block that
holds its share only, so nothing is counted twice and no pairs are emitted:
a comparison gives a count of links per vector and a star of edges.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._components import connected_components
from ._scratch import Scratch
from ._tokens import lean, runs

BLOCK, CELL, CHUNK, SAMPLE, MAX_DEPTH = 8, 512, 8192, 20_000, 14
SAMPLE_BYTES, FEW = 32 << 20, 50_000
_SLACK = 1e-9


def rotation(dim: int) -> np.ndarray:
    """A fixed random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(dim).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def blocks_of(dim: int) -> list[slice]:
    return [slice(i, min(i + BLOCK, dim)) for i in range(0, dim, BLOCK)]


def _trees(sample: np.ndarray, depth: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each block (axis, value) of each inner node, in heap order; medians of the widest axis."""
    out = []
    for b in blocks_of(sample.shape[1]):
        x = sample[:, b]
        axis, value = np.zeros(2**depth, np.int64), np.zeros(2**depth)
        cells = {1: np.arange(len(x))}
        for node in range(1, 2**depth):
            own = cells.pop(node, np.empty(0, np.int64))
            if len(own) > 1:
                k = int(np.argmax(x[own].std(axis=0)))
                axis[node], value[node] = k, np.median(x[own, k])
            right = x[own, axis[node]] >= value[node]
            cells[2 * node], cells[2 * node + 1] = own[~right], own[right]
        out.append((axis, value))
    return out


def _cells(x: np.ndarray, tree, depth: int, budget: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, cell, owned) of each vector's own cell and of the later cells within the budget."""
    axis, value = tree
    row, node, home = np.arange(len(x)), np.ones(len(x), np.int64), np.ones(len(x), dtype=bool)
    far = np.zeros((len(x), x.shape[1]))  # squared distance to the box on each axis
    for _ in range(depth):
        k = axis[node]
        d = x[row, k] - value[node]
        side = d >= 0
        other = far.copy()
        at = np.arange(len(row))
        other[at, k] = np.maximum(other[at, k], d * d)
        # from its own path a vector leaves to later cells only: of two cells the earlier one's vectors visit
        cross = (other.sum(axis=1) <= budget + _SLACK) & ~(home & side)
        row = np.r_[row, row[cross]]
        node = np.r_[2 * node + side, 2 * node[cross] + ~side[cross]]
        home = np.r_[home, np.zeros(int(cross.sum()), dtype=bool)]
        far = np.r_[far, other[cross]]
    return row, node, home


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows as unit vectors; none is zero."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True)) + 0.0


def _vectors(col, dim: int) -> np.ndarray:
    """Unit vectors of a column of raw ones, each of four or eight bytes a component."""
    raw = col.to_pylist()
    out = np.empty((len(raw), dim))
    size = np.array([len(r) for r in raw], dtype=np.int64)
    for width, kind in ((4, np.float32), (8, np.float64)):
        at = np.flatnonzero(size == width * dim)
        out[at] = np.frombuffer(b"".join(raw[i] for i in at.tolist()), dtype=kind).reshape(-1, dim)
    return _unit(out) if len(out) else out


def _normalised(batches):
    """Valid vectors, raw and as unit vectors in double precision; the others are left out."""
    for batch in batches:
        ids, labels, vec = batch.column("vec_id").to_pylist(), batch.column("label").to_pylist(), batch.column("embedding").to_pylist()
        keep, dims, unit, raw = [], [], [], []
        for i, v in enumerate(vec):
            if v is None or labels[i] is None or any(c is None for c in v):
                continue
            x = np.array(v, dtype=np.float64)
            top = np.abs(x).max() if len(x) else 0.0
            if not np.isfinite(top) or top == 0:
                continue
            with np.errstate(over="ignore"):
                short = x.astype(np.float32)
            keep.append(i)
            dims.append(len(x))
            raw.append((short if (short == x).all() else x).tobytes())
            unit.append(_unit(x[None])[0].tobytes())
        yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in keep], pa.int64()), pa.array([labels[i] for i in keep], pa.string()), pa.array(dims, pa.int32()), pa.array(unit, pa.binary()), pa.array(raw, pa.binary())], names=["vec_id", "label", "dim", "unit", "raw"])


def _dealt(shared, depth: int, dim: int, distance: float):
    @lean
    def dealt(batches):
        turn, trees = shared.value
        for batch in batches:
            for i in range(0, batch.num_rows, 4000):
                part = batch.slice(i, 4000)
                x = _vectors(part.column("raw"), dim) @ turn
                for b, cut in enumerate(blocks_of(dim)):
                    row, node, home = _cells(x[:, cut], trees[b], depth, distance * (cut.stop - cut.start) / dim)
                    took = part.select(["label", "rep", "n", "raw"]).take(pa.array(row))
                    yield pa.RecordBatch.from_arrays([took.column("label"), pa.array(np.full(len(row), b, np.int32)), pa.array(node), pa.array(home), *took.columns[1:]], names=["label", "block", "cell", "home", "rep", "n", "raw"])

    return dealt


def _compare(shared, dim: int, cosine: float):
    distance = 2 - 2 * cosine

    @lean
    def compare(batches):
        turn, _ = shared.value
        cuts = blocks_of(dim)
        for t in runs(batches, ["label", "block", "cell", "i", "j"]):
            home, rep, n = (t[k].to_numpy(zero_copy_only=False) for k in ("home", "rep", "n"))
            own, other = (t[k].to_numpy(zero_copy_only=False).astype(bool) for k in ("owner_side", "visitor_side"))
            b = t["block"][0].as_py()
            home = home.astype(bool)
            unit = _vectors(t["raw"], dim)
            x = unit @ turn
            left, right = np.flatnonzero(home & own), np.flatnonzero(other)
            links = np.zeros(len(rep), np.int64)
            parent = np.arange(len(rep))
            sides = [(x[:, c], (x[:, c] ** 2).sum(axis=1), distance * (c.stop - c.start) / dim) for c in cuts[: b + 1]]

            def near(side, i, j):
                v, sq, share = side
                return sq[i][:, None] + sq[j][None, :] - 2 * v[i] @ v[j].T <= share + _SLACK

            for s in range(0, len(left), 256):
                i = left[s : s + 256]
                p, q = np.nonzero(near(sides[b], i, right))
                for lo in range(0, len(p), 200_000):
                    u, v = i[p[lo : lo + 200_000]], right[q[lo : lo + 200_000]]
                    ok = (rep[u] != rep[v]) & (np.einsum("ij,ij->i", unit[u], unit[v]) >= cosine)
                    u, v = u[ok], v[ok]
                    first = np.ones(len(u), dtype=bool)
                    for vec, _, share in sides[:b]:
                        first &= ((vec[u] - vec[v]) ** 2).sum(axis=1) > share + _SLACK
                    np.add.at(links, u[first], n[v[first]])
                    # two owners meet twice, once from each side; an owner meets a visitor here only
                    guest = first & ~home[v]
                    np.add.at(links, v[guest], n[u[guest]])
                    _union(parent, u, v)
            root = _roots(parent)
            low = np.full(len(rep), np.iinfo(np.int64).max)
            np.minimum.at(low, root, rep)
            out = (links > 0) | (low[root] != rep)
            yield pa.RecordBatch.from_arrays([pa.array(rep[out]), pa.array(links[out]), pa.array(low[root][out])], names=["rep", "links", "root"])

    return compare


def _roots(parent: np.ndarray) -> np.ndarray:
    while True:
        up = parent[parent]
        if (up == parent).all():
            return parent
        parent = up


def _union(parent: np.ndarray, u: np.ndarray, v: np.ndarray) -> None:
    """Merge the classes of u[k] and v[k], in place."""
    while len(u):
        root = _roots(parent)
        parent[:] = root
        a, b = root[u], root[v]
        lo, hi = np.minimum(a, b), np.maximum(a, b)
        ok = lo != hi
        if not ok.any():
            return
        np.minimum.at(parent, hi[ok], lo[ok])
        u, v = u[ok], v[ok]


def near_vectors(embeddings: DataFrame, cosine: float = 0.98) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of embeddings(vec_id, embedding, label, ...).

    Vectors are compared where labels are equal and not null and lengths are
    equal. Vectors that are null, empty or zero, or hold null or non-finite
    components, link with nothing and are kept. Equal unit vectors are one
    class and are counted, not compared. Rows without vec_id are left out; a
    repeated vec_id is one vector that its repetition doesn't link; with several
    vectors it links what each of them does. Empty tables give no rows. Other
    columns are not read.
    """
    spark = embeddings.sparkSession
    tmp = Scratch(spark, "vectors")
    distance = 2 - 2 * cosine
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), "embedding").filter("vec_id is not null")
    unit = rows.mapInArrow(_normalised, "vec_id long, label string, dim int, unit binary, raw binary")
    unit = tmp.save(unit.groupBy("label", "dim", "unit", "vec_id").agg(F.min("raw").alias("raw")), "unit")
    classes = tmp.save(unit.groupBy("label", "dim", "unit").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.min("raw").alias("raw")), "classes")
    found = None
    dims = [r[0] for r in classes.select("dim").distinct().orderBy("dim").collect()]
    parts = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    for dim in dims:
        cls = classes.filter(F.col("dim") == dim)
        total, most = cls.groupBy("label").agg(F.count("*").alias("c")).agg(F.sum("c"), F.max("c")).first()
        depth = int(min(MAX_DEPTH, max(0, np.ceil(np.log2(most / CELL)))))
        turn = rotation(dim)
        most_rows = max(256, min(SAMPLE, SAMPLE_BYTES // (8 * dim)))
        rate = min(1.0, most_rows / total)
        some = [r.unit for r in cls.filter(F.pmod(F.xxhash64("unit"), F.lit(1 << 20)) < rate * (1 << 20)).select("unit").limit(2 * most_rows).collect()]
        trees = _trees(np.frombuffer(b"".join(some), dtype=np.float64).reshape(-1, dim) @ turn, depth)
        shared = spark.sparkContext.broadcast((turn, trees))
        dealt = cls.select("label", "rep", "n", "raw").mapInArrow(_dealt(shared, depth, dim, distance), "label string, block int, cell long, home boolean, rep long, n long, raw binary")
        sizes = dealt.groupBy("label", "block", "cell").agg(F.sum(F.col("home").cast("long")).alias("owners"), F.count("*").alias("visitors"))
        crowded = tmp.save(sizes.filter(F.col("visitors") > CHUNK), f"crowded-{dim}")
        if crowded.limit(FEW + 1).count() <= FEW:  # some 50 bytes each
            crowded = F.broadcast(crowded)
        dealt = dealt.join(crowded, ["label", "block", "cell"], "left")
        # A crowded cell is compared in squares: owners of chunk i with visitors of chunk j
        a, b = (F.greatest(F.lit(1).cast("long"), F.ceil(F.coalesce(F.col(c), F.lit(0)) / CHUNK)) for c in ("owners", "visitors"))
        at_a, at_b = F.pmod(F.xxhash64("rep"), a), F.pmod(F.xxhash64("rep"), b)
        line = F.transform(F.sequence(F.lit(0).cast("long"), b - 1), lambda j: F.struct(at_a.alias("i"), j.alias("j")))
        column = F.transform(F.sequence(F.lit(0).cast("long"), a - 1), lambda i: F.struct(i.alias("i"), at_b.alias("j")))
        where = F.explode(F.array_distinct(F.when(F.col("home"), F.concat(line, column)).otherwise(column)))
        dealt = dealt.withColumn("at", where).select("label", "block", "cell", F.col("at.i").alias("i"), F.col("at.j").alias("j"), "home", (F.col("at.i") == at_a).alias("owner_side"), (F.col("at.j") == at_b).alias("visitor_side"), "rep", "n", "raw")
        got = dealt.repartition(parts, "label", "block", "cell", "i", "j").sortWithinPartitions("label", "block", "cell", "i", "j").mapInArrow(_compare(shared, dim, cosine), "rep long, links long, root long")
        got = tmp.save(got, f"found-{dim}")
        found = got if found is None else found.unionByName(got)
    out = rows.select("vec_id")
    if found is None:
        return out.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    comp = connected_components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")), tmp)
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    of = classes.join(links, "rep", "left").join(comp, F.col("rep") == F.col("id"), "left")
    of = of.select("label", "dim", "unit", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    mine = unit.join(of, ["label", "dim", "unit"]).groupBy("vec_id").agg(F.sum("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    out = out.join(mine, "vec_id", "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"), (F.coalesce("component_id", "vec_id") == F.col("vec_id")).alias("kept"))
