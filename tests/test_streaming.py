"""A stream is classified as the corpus at rest is, and unseen shapes have no class."""

from sediment.operators.shapes import matches, owners, shape_counts, templates
from sediment.streaming.classify import classify_stream

CLASSES = [{"name": "connect", "template": "connect from <HOST>"}, {"name": "queue", "template": "queue active size <N>"}]


def test_classify_stream(spark, tmp_path):
    rest = spark.createDataFrame([("connect from <HOST>",), ("queue active size 12",)], "tok string")
    own = owners(matches(shape_counts(rest, "tok"), templates(spark, CLASSES)))
    rows = [("connect from <HOST>",), ("queue active size 99",), ("never seen before",), ("",), (None,)]
    spark.createDataFrame(rows, "tok string").write.parquet(f"{tmp_path}/in")
    live = classify_stream(spark.readStream.schema("tok string").parquet(f"{tmp_path}/in"), "tok", own, "blank")
    q = live.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    assert q.awaitTermination(60)
    got = {r.tok: r["class"] for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {"connect from <HOST>": "connect", "queue active size 99": "queue", "never seen before": None, "": "blank", None: "blank"}
