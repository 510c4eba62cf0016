"""Shapes of lines in any script, held against a brute-force version, and the SQL on the lines it reads."""

import re
from collections import Counter

import duckdb

from sediment.functions.scalars import FUNCTION_WORDS
from sediment.plans.catalogue import ORACLE, QUERIES

MASKS = [r"\[I:[^\]]*\](?::\d+)?", r"\[(\d{1,3}\.){3}\d{1,3}\](?::\d+)?", r"\[(?:[A-Z]{3,12}|[\d.]+)\]", r"\bQ:[0-9A-Za-z]+:", r"<[^<>\s]{1,40}>", r"\b[\w.+-]+@[\w.-]+\.\w+\b", r"\b(\d{1,3}\.){3}\d{1,3}\b", r"\b[0-9a-fA-F]{8,}\b", r"\b\d+(?:[.:,]\d+)*\b", r"\s+"]
LINES = ["état prêt", "\tqueue active", "queue active\t7", "é12 ready", "12é ready", "x y", " connect from　", "deadbeefé up", "édeadbeef up", "jörg@exämple.örg sent", "<é b> gone", "<éb> gone", "٣٤ left", "٣.5 left", "a²3 b", "ñ 12̃", "das Haus an der Straße", "the état of it", " ", "\x1fa", "a\x0bb", "中文 字 😀", "plain ascii 12", "", "é" * 480 + " a", "é" * 479 + " a", "é" * 478 + " a", "a\r", "l1 l2", "€5,00 off", "Q:4Xé: bye", "éQ:4X: bye"]


def brute(text):
    s = text.strip()
    if not s or len(s) > 480:
        return None
    for m in MASKS:
        s = re.sub(m, " ", s)
    w = re.sub(r"\s+", " ", re.sub(r"[^A-Za-z0-9 ]+", " ", s)).strip()
    t = w.split()
    return w[:120] if t and len(t) <= 14 and sum(x.lower() in FUNCTION_WORDS for x in t) < 2 else None


def held_against_brute(spark, sf_dir, texts):
    lines = [x for t in texts if t is not None for x in t.split("\n")]
    shapes = Counter(brute(x) for x in lines if x)
    assert {r["shape"]: r["n"] for r in QUERIES["shape_counts"](spark, sf_dir).collect()} == shapes
    got = QUERIES["untemplatable_share"](spark, sf_dir).first()
    assert got.asDict() == {"lines": len(lines), "untemplatable": shapes[None], "empty": lines.count(""), "shapes": len(set(shapes) - {None})}


def test_every_line_of_any_script(spark, tmp_path):
    texts = ["\n".join(LINES), None, "", "état prêt", "état prêt\n"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    held_against_brute(spark, str(tmp_path), texts)


def test_every_line_of_the_table(spark):
    sf = "/root/testdata/sf0.001"
    held_against_brute(spark, sf, [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()])


def test_sql_on_ascii_lines(spark, tmp_path):
    lines = [x for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect() if r.text is not None for x in r.text.split("\n") if re.fullmatch("[ -~]*", x)]
    spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    for name in ("shape_counts", "untemplatable_share"):
        df, cur = QUERIES[name](spark, str(tmp_path)), con.execute(ORACLE[name])
        names = [d[0] for d in cur.description]
        assert sorted(map(str, (tuple(r) for r in df.select(names).collect()))) == sorted(map(str, cur.fetchall()))
