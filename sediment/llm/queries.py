"""The thin queries op1 .. op10: operators with production parameters on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ._scratch import Scratch
from .chat_format import format_windows, read_windows
from .decontamination import contaminated
from .embedding_dedup import near_vectors
from .language_id import predict, train
from .minhash_dedup import near_duplicates
from .ngram_lm import score_documents
from .secret_scan import BASE, MORE, joined, scan_into
from .sentencepiece_codec import encode_documents
from .token_files import token_files
from .warc import archive_pages


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _fold() -> F.Column:
    return F.crc32(F.col("doc_id").cast("string")) % 5


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(_table(spark, sf_dir, "embeddings"))


def op2_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of logarithms are given to six places."""
    out = score_documents(_table(spark, sf_dir, "documents"), _fold() == 1, order=3)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 6).alias("base_score"), F.round("score", 6).alias("score"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(_table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"), end=2)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = train(docs.filter(_fold() != 0))
    out = predict(docs.select("doc_id", "text"), model, ["doc_id"])
    return out.select("doc_id", (_fold() == 0).alias("held_out"), "lang_pred", "score", "accepted")


def op5_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(_table(spark, sf_dir, "pages"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(_table(spark, sf_dir, "documents"), _tokenizer("piece_bpe_32k.model"))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation -1 is the query's own; rows that a table has under that id are more turns of it."""
    said = "<|im_end|><|im_start|>assistant ok"
    own = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    tmp = Scratch(spark, "chat")
    c = read_windows(tmp.save(format_windows(rows), "windows"))
    return c.select("conv_id", "n_turns", F.sha2("turns", 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two scans through one ledger: the base rules first; then all, which evaluates only what the ledger lacks."""
    docs = _table(spark, sf_dir, "documents")
    versions, tmp = docs.select(F.col("doc_id").alias("path"), F.col("text").alias("content")), Scratch(spark, "secrets")
    scan_into(versions, tmp, tmp.path("ledger"), BASE)
    found, _ = scan_into(versions, tmp, tmp.path("ledger"), BASE + MORE)
    base = F.filter("spans", lambda x: x["kind"].isin(*[r.kind for r in BASE]))

    def count(kind: str) -> F.Column:
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(r.kind) for r in BASE]
    return found.select(F.col("path").alias("doc_id"), *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


_ALL = (op1_embedding_dedup, op2_ngram_lm, op3_token_files, op4_language_id, op5_minhash_dedup, op6_warc, op7_sentencepiece, op8_chat_format, op9_decontamination, op10_secret_scan)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}


def _ngram_sql() -> str:
    """Trigrams, bigrams and words counted and interpolated by joins. DuckDB has no crc32: it is spelt out bit by bit."""
    byte = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, _: xor(x >> 1, 3988292384 * (x & 1)))"
    crc = f"xor(4294967295, list_reduce([4294967295::BIGINT] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda s: ascii(s)::BIGINT), lambda c, b: {byte}))"

    def less(n: str, d: str) -> str:
        return f"({n} - CASE WHEN {n} = 0 THEN 0 WHEN {n} = 1 THEN {d}.d1 WHEN {n} = 2 THEN {d}.d2 ELSE {d}.d3 END)"

    def discounts(table: str) -> str:
        y = "(n1 / (n1 + 2.0 * n2))"
        return f"""(SELECT CASE WHEN n1 > 0 THEN least(greatest(1 - 2 * {y} * n2 / n1, 0.05), 1) ELSE 0.5 END::DOUBLE AS d1, CASE WHEN n2 > 0 THEN least(greatest(2 - 3 * coalesce({y}, 0.5) * n3 / n2, 0.05), 2) ELSE 1.0 END::DOUBLE AS d2, CASE WHEN n3 > 0 THEN least(greatest(3 - 4 * coalesce({y}, 0.5) * n4 / n3, 0.05), 3) ELSE 1.5 END::DOUBLE AS d3
FROM (SELECT count(*) FILTER (n = 1) AS n1, count(*) FILTER (n = 2) AS n2, count(*) FILTER (n = 3) AS n3, count(*) FILTER (n = 4) AS n4 FROM {table}))"""

    return f"""WITH d AS (SELECT doc_id, coalesce({crc} % 5 = 1, false) AS held_out, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') || [' end'] AS ws FROM documents),
t AS (SELECT doc_id, held_out, ws[i] AS w, CASE WHEN i > 1 THEN ws[i - 1] ELSE ' start' END AS v, CASE WHEN i > 2 THEN ws[i - 2] WHEN i = 2 THEN ' start' END AS u FROM (SELECT doc_id, held_out, ws, unnest(range(1, len(ws) + 1)) AS i FROM d)),
tr AS (SELECT * FROM t WHERE NOT held_out), c AS (SELECT w, count(*) AS n FROM tr GROUP BY w), raw AS (SELECT v, w, count(*) AS n FROM tr GROUP BY v, w), tri AS (SELECT u, v, w, count(*) AS n FROM tr WHERE u IS NOT NULL GROUP BY u, v, w),
bi AS (SELECT v, w, n FROM raw WHERE v = ' start' UNION ALL SELECT v, w, count(*) FROM tri GROUP BY v, w), cont AS (SELECT w, count(*) AS n FROM raw GROUP BY w),
x1 AS {discounts("cont")}, x2 AS {discounts("bi")}, x3 AS {discounts("tri")},
a AS (SELECT (SELECT sum(n) FROM c) AS n_all, (SELECT count(*) FROM c) AS v_all, (SELECT sum(n) FROM cont) AS c_all, (SELECT sum(n - {less("n", "x1")}) / sum(n) FROM cont, x1) AS g0),
c2 AS (SELECT v, sum(n) AS total, sum(n - {less("n", "x2")}) / sum(n) AS g FROM bi, x2 GROUP BY v), c3 AS (SELECT u, v, sum(n) AS total, sum(n - {less("n", "x3")}) / sum(n) AS g FROM tri, x3 GROUP BY u, v),
p AS (SELECT t.doc_id, t.held_out, c.n AS seen, n_all, log10((coalesce(c.n, 0) + 0.5) / (n_all + 0.5 * (v_all + 1))) AS base, {less("coalesce(cont.n, 0)", "x1")} / c_all + g0 / (v_all + 1) AS p1,
coalesce({less("coalesce(bi.n, 0)", "x2")} / c2.total, 0) AS f2, coalesce(c2.g, 1) AS g2, coalesce({less("coalesce(tri.n, 0)", "x3")} / c3.total, 0) AS f3, coalesce(c3.g, 1) AS g3
FROM t CROSS JOIN a CROSS JOIN x1 CROSS JOIN x2 CROSS JOIN x3 LEFT JOIN c ON c.w = t.w LEFT JOIN cont ON cont.w = t.w LEFT JOIN bi ON bi.v = t.v AND bi.w = t.w LEFT JOIN c2 ON c2.v = t.v
LEFT JOIN tri ON tri.u = t.u AND tri.v = t.v AND tri.w = t.w LEFT JOIN c3 ON c3.u = t.u AND c3.v = t.v)
SELECT doc_id, held_out, count(*) AS n_tokens, count(seen) AS n_known, CAST(any_value(n_all) AS BIGINT) AS train_tokens, round(sum(base), 6) AS base_score, round(sum(log10(f3 + g3 * (f2 + g2 * p1))), 6) AS score FROM p GROUP BY doc_id, held_out"""


def _token_sql() -> str:
    """Byte-pair merges of each distinct word, the lowest rank first and of equal ones the leftmost, by recursion; crc32 by a table."""
    return f"""WITH RECURSIVE j AS (SELECT content::JSON AS j FROM read_text('{_tokenizer('word_bpe_49k.json')}')),
merges AS (SELECT m[1] AS a, m[2] AS b, row_number() OVER () AS rank FROM (SELECT unnest(ms) AS m FROM (SELECT CASE WHEN json_type(j, '$.model.merges[0]') = 'ARRAY' THEN CAST(j->'$.model.merges' AS VARCHAR[][]) ELSE list_transform(CAST(j->'$.model.merges' AS VARCHAR[]), lambda x: string_split(x, ' ')) END AS ms FROM j))),
vocab AS (SELECT e.key AS piece, e.value AS id FROM (SELECT unnest(map_entries(CAST(j->'$.model.vocab' AS MAP(VARCHAR, INTEGER)))) AS e FROM j)),
d AS (SELECT doc_id, regexp_extract_all(lower(regexp_replace(nfc_normalize(coalesce(text, '')), '[\\x09-\\x0d\\x20\\x{{85}}\\p{{Z}}\\x1c-\\x1f]+', ' ', 'g')), '<\\|startoftext\\|>|<\\|endoftext\\|>|''s|''t|''re|''ve|''m|''ll|''d|\\p{{L}}+|\\p{{N}}|[^\\x20\\p{{L}}\\p{{N}}]+') AS ws FROM documents),
t AS (SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM d),
u AS (SELECT DISTINCT w FROM t),
h AS (SELECT w, list_transform(regexp_extract_all(hex(encode(w)), '..'), lambda x: CAST('0x' || x AS INTEGER)) AS bytes FROM u),
s0 AS (SELECT w, list_transform(bytes, lambda x, i: chr(CASE WHEN x BETWEEN 33 AND 126 OR x BETWEEN 161 AND 172 OR x >= 174 THEN x WHEN x < 33 THEN 256 + x WHEN x < 161 THEN 256 + x - 94 ELSE 323 END) || if(i = len(bytes), '</w>', '')) AS s FROM h),
r(w, s, n) AS (SELECT w, s, 0 FROM s0 WHERE w NOT IN ('<|startoftext|>', '<|endoftext|>')
UNION ALL SELECT w, s[:i - 1] || [s[i] || s[i + 1]] || s[i + 2:], n + 1 FROM (SELECT any_value(r.s) AS s, r.w, any_value(r.n) AS n, arg_min(k.i, k.rank * 1000000 + k.i) AS i FROM r JOIN LATERAL (SELECT i, rank FROM (SELECT unnest(range(1, len(r.s))) AS i) x JOIN merges ON a = r.s[x.i] AND b = r.s[x.i + 1]) k ON true GROUP BY r.w)),
f AS (SELECT w, arg_max(s, n) AS s FROM r GROUP BY w UNION ALL SELECT w, [w] FROM u WHERE w IN ('<|startoftext|>', '<|endoftext|>')),
wi AS (SELECT w, list(id ORDER BY k) AS ids FROM (SELECT w, unnest(s) AS piece, unnest(range(len(s))) AS k FROM f) x JOIN vocab USING (piece) GROUP BY w),
x AS (SELECT d.doc_id, coalesce(ids, []) || [2] AS ids FROM d LEFT JOIN (SELECT doc_id, flatten(list(ids ORDER BY i)) AS ids FROM t JOIN wi USING (w) GROUP BY doc_id) g ON g.doc_id = d.doc_id),
c AS (SELECT list(list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, _: xor(x >> 1, 3988292384 * (x & 1))) ORDER BY n) AS of FROM range(256) AS r(n)),
y AS (SELECT doc_id, len(ids) AS n, xor(4294967295, list_reduce([4294967295::BIGINT] || flatten(list_transform(ids, lambda v: [(v & 255)::BIGINT, ((v >> 8) & 255)::BIGINT, ((v >> 16) & 255)::BIGINT, (v >> 24)::BIGINT])), lambda p, b: xor(p >> 8, of[(xor(p, b) & 255) + 1]))) AS crc FROM x, c)
SELECT doc_id, CAST(sum(n) OVER (ORDER BY doc_id) - n AS BIGINT) AS start, n AS n_tokens, crc AS ids_crc32 FROM y"""


def _piece_sql() -> str:
    """Merges of each distinct run between spaces, the best score first and of equal ones the leftmost; pieces and scores come from the model's file."""
    from .sentencepiece_codec import Model

    m, U = Model(_tokenizer("piece_bpe_32k.model")), "\u2581"
    quoted = lambda p: "'" + p.replace("'", "''") + "'"
    vals = ",".join(f"({quoted(p)},{i},{m.scores[i]!r})" for p, i in m.id.items())
    byt = ",".join(f"({b},{i})" for b, i in m.bytes.items())
    return f"""WITH RECURSIVE pieces(piece, id, score) AS (VALUES {vals}), bytes(b, id) AS (VALUES {byt}),
d AS (SELECT doc_id, coalesce(text, '') AS text, CASE WHEN coalesce(text, '') = '' THEN [] ELSE regexp_extract_all('{U}' || replace(text, ' ', '{U}'), '(?s){U}*[^{U}]+|{U}+$') END AS ws FROM documents),
t AS (SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM d), u AS (SELECT DISTINCT w FROM t),
r(w, s, n) AS (SELECT w, string_split(w, ''), 0 FROM u
UNION ALL SELECT w, s[:i - 1] || [s[i] || s[i + 1]] || s[i + 2:], n + 1 FROM (SELECT r.w, any_value(r.s) AS s, any_value(r.n) AS n, arg_min(k.i, (-k.score, k.i)) AS i FROM r JOIN LATERAL (SELECT i, score FROM (SELECT unnest(range(1, len(r.s))) AS i) x JOIN pieces ON piece = r.s[x.i] || r.s[x.i + 1]) k ON true GROUP BY r.w)),
f AS (SELECT w, arg_max(s, n) AS s FROM r GROUP BY w),
p AS (SELECT w, k, x.piece, pieces.id FROM (SELECT w, unnest(s) AS piece, unnest(range(len(s))) AS k FROM f) x LEFT JOIN pieces USING (piece)),
b AS (SELECT w, k, 0 AS o, id FROM p WHERE id IS NOT NULL UNION ALL SELECT w, k, o, bytes.id FROM (SELECT w, k, unnest(regexp_extract_all(hex(encode(piece)), '..')) AS h, unnest(range(octet_length(encode(piece)))) AS o FROM p WHERE id IS NULL) JOIN bytes ON b = CAST('0x' || h AS INTEGER)),
wi AS (SELECT w, list(id ORDER BY k, o) AS ids FROM b GROUP BY w),
g AS (SELECT doc_id, flatten(list(ids ORDER BY i)) AS ids FROM t JOIN wi USING (w) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(coalesce(ids, [])) AS BIGINT) AS n_tokens, sha256(array_to_string(coalesce(ids, []), ',')) AS ids_sha256, sha256(replace(text, '{U}', ' ')) AS decoded_sha256 FROM d LEFT JOIN g ON g.doc_id = d.doc_id"""


def _tiling_sql() -> str:
    """The longest free common run of every candidate pair, marked round by round."""
    return """WITH RECURSIVE dw AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9\\x{80}-\\x{10FFFF}]+') AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
iw AS (SELECT item_id, w, len(w) AS n, least(5, len(w)) AS least FROM (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9\\x{80}-\\x{10FFFF}]+') AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL) WHERE len(w) > 0),
si AS (SELECT DISTINCT item_id, least, array_to_string(w[i:i + least - 1], ' ') AS s FROM (SELECT *, unnest(range(1, n - least + 2)) AS i FROM iw)),
sd AS (SELECT DISTINCT doc_id, least, array_to_string(w[i:i + least - 1], ' ') AS s FROM (SELECT doc_id, w, least, unnest(range(1, len(w) - least + 2)) AS i FROM dw, (SELECT DISTINCT least FROM iw))),
c AS (SELECT DISTINCT doc_id, item_id, least FROM sd JOIN si USING (least, s)),
x AS (SELECT item_id, unnest(w) AS word, unnest(range(n)) AS i FROM iw), y AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS j FROM dw WHERE doc_id IN (SELECT doc_id FROM c)),
m AS (SELECT doc_id, item_id, least, i, j, i - row_number() OVER (PARTITION BY doc_id, item_id, i - j ORDER BY i) AS run FROM c JOIN x USING (item_id) JOIN y USING (doc_id, word)),
r(doc_id, item_id, least, i, j, covered, tiles) AS (SELECT doc_id, item_id, least, -1, NULL, 0, 0 FROM c UNION ALL SELECT doc_id, item_id, least, i, j, 0, 0 FROM m QUALIFY count(*) OVER (PARTITION BY doc_id, item_id, i - j, run) >= least
UNION ALL SELECT doc_id, item_id, least, i, j, covered - best[1], tiles + 1 FROM (
SELECT *, min([-size, i0, j0]) OVER (PARTITION BY doc_id, item_id) AS best FROM (
SELECT *, CASE WHEN i < 0 THEN 0 ELSE count(*) OVER k END AS size, min(i) OVER k AS i0, min(j) OVER k AS j0 FROM (
SELECT *, i - row_number() OVER (PARTITION BY doc_id, item_id, i - j ORDER BY i) AS run FROM r) WINDOW k AS (PARTITION BY doc_id, item_id, i - j, run)))
WHERE -best[1] >= least AND (i < 0 OR NOT (i BETWEEN best[2] AND best[2] - best[1] - 1 OR j BETWEEN best[3] AND best[3] - best[1] - 1))),
t AS (SELECT doc_id, item_id, max(covered) AS covered, max(tiles) AS tiles FROM r WHERE i < 0 GROUP BY doc_id, item_id)
SELECT doc_id, item_id, CAST(n AS BIGINT) AS item_words, CAST(covered AS BIGINT) AS covered_words, CAST(tiles AS BIGINT) AS tiles, covered / n AS coverage FROM t JOIN iw USING (item_id) WHERE covered >= 0.75 * n"""


def _secret_sql() -> str:
    """Spans from the lengths of matches and of the gaps between them, a rule at a time."""

    def rule(place: int, r) -> str:
        # RE2 folds more letters than A-Z under (?i): spell out both cases
        head, _, tail = r.pattern.removeprefix("(?i)").partition(")")
        both = "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in head)
        p = (both + ")" + tail if r.pattern.startswith("(?i)") else r.pattern).replace("'", "''")
        size = "lambda x: length(x)"
        return f"""SELECT doc_id, {place} AS place, '{r.kind}' AS kind, {r.least} AS least, list_transform(string_split_regex(t, '{p}'), {size}) AS gaps, list_transform(regexp_extract_all(t, '{p}', 0), {size}) AS lens, list_transform(regexp_extract_all(t, '{p}', {r.of}), {size}) AS own FROM d"""

    rules = " UNION ALL ".join(rule(i, r) for i, r in enumerate(BASE + MORE))
    counts = ", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in BASE)
    text = "string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, place, e)"
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), m AS ({rules}),
i AS (SELECT *, unnest(range(1, len(lens) + 1)) AS i FROM m),
x AS (SELECT doc_id, place, kind, list_sum(gaps[1:i]) + coalesce(list_sum(lens[1:i - 1]), 0) AS s, s + lens[i] AS e FROM i WHERE own[i] >= least),
g AS (SELECT doc_id, {counts}, {text} FILTER (place < {len(BASE)}) AS base, {text} AS spans FROM x GROUP BY doc_id)
SELECT d.doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g ON g.doc_id = d.doc_id"""


#: Brute force: every pair of vectors, every pair of documents that share a shingle, every merge of every word. Language identification alone isn't SQL.
ORACLE: dict[str, str] = {
    "op1_embedding_dedup": """WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
r(id, c) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.id),
n AS (SELECT a, count(*) AS k FROM l GROUP BY a), c AS (SELECT id, min(c) AS c FROM r GROUP BY id)
SELECT vec_id, coalesce(k, 0) AS n_links, c AS component_id, c = vec_id AS kept FROM embeddings JOIN c ON id = vec_id LEFT JOIN n ON a = vec_id""",
    "op2_ngram_lm": _ngram_sql(),
    "op3_token_files": _token_sql(),
    "op5_minhash_dedup": """WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
d AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
u AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM d),
l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM u a JOIN u b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
r(id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.id),
c AS (SELECT id, min(c) AS c FROM r GROUP BY id)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, c AS component_id, c = doc_id AS kept FROM d JOIN c ON id = doc_id""",
    "op6_warc": """WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY d) ELSE page_id END AS f FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest, CASE WHEN f = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN f <> page_id THEN f END AS refers_to FROM f""",
    "op8_chat_format": """WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
UNION ALL SELECT -1, i, if(i = 0, 'user', 'assistant'), '<|im_end|><|im_start|>assistant ok' FROM range(2) AS t(i)),
a AS (SELECT *, len(regexp_extract_all(role, '\\p{L}{1,6}|\\p{N}|[^\\x20\\x09-\\x0D\\p{L}\\p{N}]')) + len(regexp_extract_all(text, '\\p{L}{1,6}|\\p{N}|[^\\x20\\x09-\\x0D\\p{L}\\p{N}]')) + 4 AS tokens, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM r),
h AS (SELECT *, pos = 1 AND role = 'system' AS head, if(head, 0, tokens) AS cost, 512 - max(if(head, tokens, 0)) OVER (PARTITION BY conv_id) AS rest FROM a),
b AS (SELECT *, if(rest - 64 >= 128, 64, 0) AS hist, greatest(2, rest - hist) // 2 AS stride, sum(cost) OVER (PARTITION BY conv_id ORDER BY pos) AS e FROM h),
k AS (SELECT *, 2 * sum((cost > stride)::INT) OVER (PARTITION BY conv_id ORDER BY pos) - (cost > stride)::INT AS k1, if(e = 0, -1, (e - 1) // stride) AS k2 FROM b),
n AS (SELECT *, if(head OR lag(k1) OVER o IS NOT DISTINCT FROM k1 AND lag(k2) OVER o IS NOT DISTINCT FROM k2, 0, 1) AS new FROM k WINDOW o AS (PARTITION BY conv_id ORDER BY pos)),
w AS (SELECT *, greatest(sum(new) OVER (PARTITION BY conv_id ORDER BY pos) - 1, 0) AS w FROM n),
z AS (SELECT *, max(e) OVER (PARTITION BY conv_id, w) - e + cost AS tail, max(w) OVER (PARTITION BY conv_id) AS last FROM w),
p AS (SELECT *, 24 + length(replace(replace(replace(role, '%', '%25'), '<|', '<%7C'), chr(10), '%0A')) + length(replace(replace(text, '%', '%25'), '<|', '<%7C')) AS size, 1 + if(head, last, 0) + if(tail <= hist AND w < last AND NOT head, 1, 0) AS times FROM z)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256, CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '')) AS loss_sha256, CAST(sum(size * times) AS BIGINT) AS formatted_chars FROM p GROUP BY conv_id""",
    "op7_sentencepiece": _piece_sql(),
    "op9_decontamination": _tiling_sql(),
    "op10_secret_scan": _secret_sql(),
}
