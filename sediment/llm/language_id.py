"""Language identification: averaged hashed subword embeddings, a linear softmax, calibrated rejection.

A text's features are all byte n-grams (3 to 5) of its words, lower-cased,
with everything but letters read as one word boundary; each is hashed to a
bucket that has an embedding, and the text is the mean of its embeddings.
Every n-gram of every labelled row is an example of its language: executors
count them by language and bucket over the whole texts (integers, so that
sums don't depend on how rows lie), and embeddings and the softmax layer are
trained together on all counts by gradient descent in numpy on the driver,
languages weighted alike. The driver holds a few numbers for each language and
bucket, no rows.

Temperature and rejection threshold are taken from all labelled rows too. Rows
are dealt into two halves by a hash of their text, and each is scored by a
model that learnt from the other half, so that none is judged by what it
taught. The threshold is the score that all but exactly `reject_share` of
these rows reach, 0.5 at most. Rows of a language that the other half hasn't
got can't be judged and are left out of this.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from ._scratch import Scratch
from ._tokens import LOWER, lean, pieces, text_bytes

ORDERS, UNDETERMINED = (3, 4, 5), "und"
_FOLD = np.full(256, 32, dtype=np.uint8)
for _b in range(256):
    if _b >= 128 or 65 <= _b <= 90 or 97 <= _b <= 122:
        _FOLD[_b] = LOWER[_b]
_MULT = np.uint32(0x01000193)
_TEMPERATURES = np.geomspace(1 / 128, 8, 81)
#: Buckets in a row of counts, and counted languages that a worker holds at once
_BLOCK, _HELD = 1 << 11, 64


def features(data: np.ndarray, buckets: int) -> list[np.ndarray]:
    """For each order the bucket of the n-gram that ends at each byte; -1 where it would span a boundary inside."""
    b = _FOLD[data]
    out = []
    x = b.astype(np.uint32) + np.uint32(1)
    space = b == 32
    h = x.copy()
    grams = {1: h}
    for n in range(2, max(ORDERS) + 1):
        h = h.copy()
        h[n - 1 :] = (grams[n - 1][n - 1 :] * _MULT) ^ (x[: max(0, len(x) - n + 1)] * np.uint32(0x9E3779B1))
        grams[n] = h
    inner = np.cumsum(space)
    for n in ORDERS:
        h = grams[n]
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B)
        h ^= h >> np.uint32(13)
        idx = (h & np.uint32(buckets - 1)).astype(np.int32)
        bad = np.ones(len(b), dtype=bool)
        if len(b) >= n:
            # spaces strictly inside the gram: between its first and last byte
            bad[n - 1 :] = (inner[n - 2 : len(b) - 1] - inner[: len(b) - n + 1]) > 0
        idx[bad] = -1
        out.append(idx)
    return out


def _grams(data: np.ndarray, off: np.ndarray, buckets: int):
    """features of texts side by side: n-grams don't reach into the text before."""
    for n, idx in zip(ORDERS, features(data, buckets)):
        for k in range(n - 1):
            at = off[:-1] + k
            idx[at[at < np.minimum(off[1:], len(data))]] = -1
        yield idx


def _mean_rows(table: np.ndarray, data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Mean of table rows over the features of each text; zero where it has none."""
    buckets = len(table) - 1
    total = np.zeros((len(off) - 1, table.shape[1]))
    count = np.zeros(len(off) - 1)
    for idx in _grams(data, off, buckets):
        c = np.r_[0, np.cumsum(idx >= 0)]
        count += c[off[1:]] - c[off[:-1]]
        for j in range(table.shape[1]):
            s = np.r_[0, np.cumsum(table[idx, j], dtype=np.float64)]
            total[:, j] += s[off[1:]] - s[off[:-1]]
    return total / np.maximum(count, 1)[:, None]


@dataclass
class LanguageModel:
    labels: list[str]
    table: np.ndarray  # logits of each bucket, averaged like embeddings; the last row, all zero, is for no feature
    bias: np.ndarray
    temperature: float
    threshold: float

    def logits(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        return _mean_rows(self.table, data, off) + self.bias

    def probabilities(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        return _softmax(self.logits(data, off) / self.temperature)


def _softmax(z: np.ndarray, axis: int = -1) -> np.ndarray:
    z = np.exp(z - z.max(axis=axis, keepdims=True))
    return z / z.sum(axis=axis, keepdims=True)


def _sample(labelled: DataFrame, per_language: int, sample_chars: int) -> list:
    counts = labelled.groupBy("lang").agg(F.count("*").alias("n"))
    most = per_language + 8 * per_language**0.5 + 40  # so that a language with enough rows gives per_language of them
    share = counts.select("lang", (F.lit(most) / F.col("n")).alias("share"))
    h = F.xxhash64("text")
    start = F.pmod(h, F.greatest(F.length("text") - sample_chars + 1, F.lit(1))) + 1
    unit = F.pmod(F.xxhash64("text", "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    rows = labelled.join(F.broadcast(share), "lang").filter(unit < F.col("share"))
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(unit, "text"))).filter(F.col("place") <= per_language)
    rows = rows.select("lang", F.substring("text", start.cast("int"), F.lit(sample_chars)).alias("text"))
    return sorted((r.lang, r.text) for r in rows.collect())


def _count(buckets: int):
    @lean
    def count(batches):
        held: dict[tuple[str, int], np.ndarray] = {}

        def out():
            for (lang, half), n in held.items():
                blocks = n.reshape(-1, min(_BLOCK, buckets))
                some = np.flatnonzero(blocks.any(axis=1))
                # a language without a gram is a language all the same
                some = some if len(some) else np.zeros(1, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array([half] * len(some), pa.int32()), pa.array(some.astype(np.int32)), pa.array([blocks[i].tobytes() for i in some], pa.binary())], names=["lang", "half", "block", "counts"])
            held.clear()

        for batch in batches:
            for part in pieces(batch, "text", 1 << 19):
                data, off = text_bytes(part.column("text"))
                lang = part.column("lang").dictionary_encode()
                keys, of = np.unique(lang.indices.to_numpy(zero_copy_only=False).astype(np.int64) * 2 + part.column("half").to_numpy(zero_copy_only=False), return_inverse=True)
                at = np.repeat(of.reshape(-1), np.diff(off))
                grams = list(_grams(data, off, buckets))
                for lo in range(0, len(keys), 16):
                    some = keys[lo : lo + 16]
                    n = np.zeros(len(some) * buckets, np.int64)
                    for idx in grams:
                        good = idx >= 0
                        if len(keys) > 16:
                            good &= (at >= lo) & (at < lo + 16)
                        n += np.bincount((at[good] - lo) * buckets + idx[good], minlength=len(n))
                    for key, more in zip(some.tolist(), n.reshape(len(some), buckets)):
                        key = lang.dictionary[key // 2].as_py(), key % 2
                        if key in held:
                            held[key] += more
                        else:
                            if len(held) == _HELD:
                                yield from out()
                            held[key] = more.copy()
        yield from out()

    return count


def _total(table: pa.Table) -> pa.Table:
    n = sum(np.frombuffer(b.as_py(), np.int64) for b in table.column("counts"))
    return table.slice(0, 1).set_column(3, "counts", pa.array([n.tobytes()], pa.binary()))


def _counts(rows: DataFrame, buckets: int) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Labels of rows(text, lang, half), how often each bucket occurs in all texts of each half and label, and which labels each half has."""
    schema = "lang string, half int, block int, counts binary"
    sums = rows.select("text", "lang", "half").mapInArrow(_count(buckets), schema).groupBy("lang", "half", "block").applyInArrow(_total, schema)
    found = [(r.lang, r.half, r.block, np.frombuffer(r.counts, np.int64).astype(np.float32)) for r in sums.toLocalIterator()]
    labels = sorted({f[0] for f in found})
    place = {lang: i for i, lang in enumerate(labels)}
    n, has = np.zeros((2, len(labels), buckets), np.float32), np.zeros((2, len(labels)), bool)
    for lang, half, block, counts in found:
        n[half, place[lang], block * len(counts) : (block + 1) * len(counts)] = counts
        has[half, place[lang]] = True
    return labels, n, has


def _fit(labels: list[str], n: np.ndarray, size: int, epochs: int, seed: int) -> LanguageModel:
    """Embeddings and softmax layer that tell a language from one gram, for grams as often as n[label, bucket] has them."""
    buckets = n.shape[1]
    rate = n / np.maximum(1, n.sum(axis=1, keepdims=True))
    pool = rate.mean(axis=0)
    # Shrunk to what languages have in common, by as many grams as there are buckets: few grams tell little
    rate = (n + buckets * pool) / (n.sum(axis=1, keepdims=True) + buckets)
    # Stacks of small matrices, as BLAS starts threads for large ones and waits for them
    def stack(x: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(x.reshape(len(x), -1, min(512, buckets)).transpose(1, 0, 2).astype(np.float32))

    goal, weight = stack(rate + (pool == 0)), stack(pool[None] / max(pool.sum(), 1e-9))
    goal /= goal.sum(axis=1, keepdims=True)
    rng = np.random.default_rng(seed)
    params = [stack(rng.normal(0, 0.1, (size, buckets))), rng.normal(0, 1, (len(labels), size)).astype(np.float32)]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for epoch in range(epochs if pool.any() else 0):
        e, w = params
        error = _softmax(w @ e, 1) - goal
        # A bucket's own step is the same however rare it is
        for p, g, m, v in zip(params, [w.T @ error, (error * weight @ e.transpose(0, 2, 1)).sum(axis=0)], first, second):
            m += np.float32(0.1) * (g - m)
            v += np.float32(0.01) * (g * g - v)
            p -= np.float32(0.1 * (1 - epoch / epochs) / (1 - 0.9 ** (epoch + 1))) * m / (np.sqrt(v / np.float32(1 - 0.99 ** (epoch + 1))) + np.float32(1e-6))
    e, w = params
    table = np.zeros((buckets + 1, len(labels)), np.float32)
    table[:-1] = (w @ e).transpose(0, 2, 1).reshape(buckets, -1) * (pool > 0)[:, None]
    # Languages count alike, so the layer has no bias: grams that were never learnt say nothing
    return LanguageModel(labels, table, np.zeros(len(labels)), 1.0, 0.5)


def train(labelled: DataFrame, per_language: int | None = None, sample_chars: int = 4000, buckets: int = 1 << 16, size: int = 8, epochs: int = 100, reject_share: float = 0.0005, seed: int = 5) -> LanguageModel:
    """Fit on all of labelled(doc_id, text, lang): rows with null text or lang are left out. Without any row there are no labels and every text is undetermined.

    With per_language, embeddings and softmax learn from at most that many rows
    of each language and sample_chars characters of each, from a place that the
    text's hash chooses; temperature and threshold still come from all rows.
    """
    spark = labelled.sparkSession
    half = F.pmod(F.xxhash64("text"), F.lit(2)).cast("int").alias("half")
    labelled = labelled.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), *([F.col("doc_id")] if per_language is not None else [])).filter("lang is not null and text is not null")
    rows = labelled if per_language is None else spark.createDataFrame(_sample(labelled, per_language, sample_chars), "lang string, text string")
    labels, n, has = _counts(rows.select("text", "lang", half), buckets)
    if not labels:
        return LanguageModel([], np.zeros((buckets + 1, 1), np.float32), np.zeros(1), 1.0, 1.0)
    model = _fit(labels, n.sum(axis=0), size, epochs, seed)
    halves = [_fit(labels, n[i], size, epochs, seed) for i in (0, 1)]
    tmp = Scratch(spark, "languages")
    judged = tmp.save(_judged(labelled.select("text", "lang", half), halves, has), "logits")
    rows = judged.count()
    if rows:
        model.temperature = _temperature(judged, len(labels), rows)
        model.threshold = min(0.5, _confidence(judged, model, int(reject_share * rows)))
    tmp.drop("logits")
    return model


def _judged(rows: DataFrame, halves: list[LanguageModel], has: np.ndarray) -> DataFrame:
    """The label's place and the logits of each row with letters, by the model of the other half, if that has the label."""
    shared = rows.sparkSession.sparkContext.broadcast((halves, has))

    @lean
    def judge(batches):
        halves, has = shared.value
        labels = pa.array(halves[0].labels, pa.string())
        for batch in batches:
            for part in pieces(batch, "text", 1 << 19):
                place = pc.fill_null(pc.index_in(part.column("lang"), labels), -1).to_numpy(zero_copy_only=False)
                half = part.column("half").to_numpy(zero_copy_only=False)
                for i in (0, 1):
                    mine = np.flatnonzero((half == i) & (place >= 0) & has[1 - i][place])
                    if len(mine):
                        z = halves[1 - i].logits(*text_bytes(part.column("text").take(pa.array(mine))))
                        z = pa.ListArray.from_arrays(pa.array(np.arange(len(mine) + 1) * z.shape[1], pa.int32()), pa.array(z.reshape(-1)))
                        yield pa.RecordBatch.from_arrays([pa.array(place[mine], pa.int32()), z], names=["label", "z"])

    return rows.filter(F.col("text").rlike(r"\p{L}")).mapInArrow(judge, "label int, z array<double>")


def _logits(batch: pa.RecordBatch, labels: int) -> np.ndarray:
    return batch.column("z").flatten().to_numpy(zero_copy_only=False).reshape(-1, labels)


def _temperature(judged: DataFrame, labels: int, n: int) -> float:
    """That under which the labels of all n rows are likeliest, had one row more been wrong: without a wrong one any would do that is low enough."""
    doubt = 1 / (n + 2)

    def losses(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                part = batch.slice(i, 1000)
                z, y = _logits(part, labels), part.column("label").to_numpy()
                z = z - z.max(axis=1, keepdims=True)
                goal = (1 - doubt) * z[np.arange(len(y)), y] + doubt * z.mean(axis=1)
                rows = [np.log(np.exp(z / t).sum(axis=1)) - goal / t for t in _TEMPERATURES]
                # In millionths: sums of integers are the same in any order
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(rows), dtype=np.int32)), pa.array([int(np.rint(r * 1e6).sum()) for r in rows], pa.int64())], names=["t", "loss"])

    found = judged.mapInArrow(losses, "t int, loss long").groupBy("t").agg(F.sum("loss").alias("loss")).collect()
    return float(_TEMPERATURES[min(found, key=lambda r: (r.loss, r.t)).t])


def _confidence(judged: DataFrame, model: LanguageModel, rank: int) -> float:
    """The score that all judged rows but `rank` reach; only counts of scores come to the driver."""
    labels, temperature = len(model.labels), model.temperature

    def scores(batches):
        for batch in batches:
            if batch.num_rows:
                p = _softmax(_logits(batch, labels) / temperature).max(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(p)], names=["score"])

    return _at_rank(judged.mapInArrow(scores, "score double"), rank)


def _at_rank(scores: DataFrame, rank: int) -> float:
    """The score (0 to 1) that `rank` rows precede in order, exactly; the largest if there are no more. Rows are counted by the score's bits, 16 at a time."""

    def bits(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(batch.column(0).to_numpy().view(np.int64))], names=["bits"])

    keys, low = scores.mapInArrow(bits, "bits long"), 0
    for shift in (48, 32, 16, 0):
        inside = keys if shift == 48 else keys.filter(F.shiftright("bits", shift + 16) == low)
        found = sorted((r.k, r.n) for r in inside.groupBy(F.shiftright("bits", shift).alias("k")).agg(F.count("*").alias("n")).collect())
        for low, n in found:
            if rank < n:
                break
            rank -= n
        else:
            rank = found[-1][1] - 1
    return float(np.array([low], np.int64).view(np.float64)[0])


def _predict(shared, keep: int, names: list[str]):
    @lean
    def predict(batches):
        model = shared.value
        labels = np.array([*model.labels, UNDETERMINED], dtype=object)
        for batch in batches:
            for part in pieces(batch, "text", 1 << 19):
                data, off = text_bytes(part.column("text"))
                p = model.probabilities(data, off)
                known = part.column(part.num_columns - 1).to_numpy(zero_copy_only=False).astype(bool) & bool(model.labels)
                best = p.argmax(axis=1)
                score = np.where(known, p[np.arange(len(p)), best], 0.0)
                out = [part.column(i) for i in range(keep)]
                out += [pa.array(labels[np.where(known, best, len(model.labels))], pa.string()), pa.array(np.clip(score, 0, 1)), pa.array(known & (score >= model.threshold))]
                yield pa.RecordBatch.from_arrays(out, names=names)

    return predict


def kept_name(column: str) -> str:
    return f"in {column}" if column.lower() in ("lang_pred", "score", "accepted") else column


def accepted_documents(documents: DataFrame, model: LanguageModel) -> DataFrame:
    """The rows of documents that predict accepts, with all their columns, whatever their names."""
    out = predict(documents, model, documents.columns).filter("accepted")
    return out.select(*[F.col(f"`{kept_name(c)}`").alias(c) for c in documents.columns])


def predict(documents: DataFrame, model: LanguageModel, keep: list[str]) -> DataFrame:
    """The columns keep, then lang_pred, score (0 to 1) and accepted, for each row of documents.

    Reads the whole text and nothing else. Null text, and text without a
    letter, is undetermined with score 0 and not accepted. Ties go to the label
    that sorts first. An empty table gives no rows. A column in keep that has
    the name of one of the three is returned as "in <name>". The model, of a
    fixed number of buckets and labels, is broadcast (about 1 MB).
    """
    spark = documents.sparkSession
    documents, keep = documents.withColumnsRenamed({c: kept_name(c) for c in keep}), [kept_name(c) for c in keep]
    text = F.col("text").cast("string")
    df = documents.select(*[F.col(f"`{c}`") for c in keep], *([] if "text" in keep else [text.alias("text")]), F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("has letters"))
    fields = [*df.schema.fields[: len(keep)]]
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in fields) + "lang_pred string, score double, accepted boolean"
    shared = spark.sparkContext.broadcast(model)
    return df.mapInArrow(_predict(shared, len(keep), [*keep, "lang_pred", "score", "accepted"]), schema)
