"""The normaliser on archives that others wrote, and on broken ones."""

import gzip
import io
import json

import pytest

from sediment.llm import warc

RECORDS = [warc.record(i, "http://x", b"p" * (i * 50_000), "d", None, "1970-01-01T00:00:00Z") for i in range(30)]


def test_given_paths(spark, tmp_path):
    """One archive of one stream, one of many members, one with other record types."""
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 4\r\n\r\nabcd\r\n\r\n"
    for name, data in {"one": gzip.compress(b"".join(RECORDS)), "many": b"".join(map(gzip.compress, RECORDS)), "info": gzip.compress(info + RECORDS[3]), "none": gzip.compress(b"")}.items():
        (tmp_path / f"{name}.gz").write_bytes(data)
    rows = [(f"file://{tmp_path}/{n}.gz", f"file://{tmp_path}/out/{n}") for n in ("one", "many", "info", "none")]
    got = {r.target.rpartition("/")[2]: r.records for r in warc.normalise_archives(spark.createDataFrame(rows, "source string, target string")).collect()}
    assert got == {"one": 30, "many": 30, "info": 2, "none": 0}
    for n in ("one", "many"):
        index = [json.loads(x) for x in (tmp_path / f"out/{n}.idx").read_text().splitlines()]
        data = (tmp_path / f"out/{n}.warc.gz").read_bytes()
        assert [gzip.decompress(data[x["offset"] : x["offset"] + x["length"]]) for x in index] == RECORDS
    assert json.loads((tmp_path / "out/info.idx").read_text().splitlines()[0])["type"] == "warcinfo"


@pytest.mark.parametrize("size", [7, 100, 1 << 20])
def test_cut_streams(size):
    whole = gzip.compress(b"".join(RECORDS))
    assert b"".join(warc.inflate(io.BytesIO(whole), size)) == b"".join(RECORDS)
    at_record = gzip.compress(b"".join(RECORDS[:2]))
    for cut in (at_record[:-8], at_record[:-1], whole[: len(whole) // 2]):
        with pytest.raises(ValueError, match="archive ends"):
            list(warc.records(warc.inflate(io.BytesIO(cut), size)))


def test_no_length():
    with pytest.raises(ValueError, match="Content-Length"):
        list(warc.records([b"WARC/1.0\r\nWARC-Type: response\r\n\r\nabc\r\n\r\n"]))


def test_repeated_pages_by_join(spark, monkeypatch):
    monkeypatch.setattr(warc, "FEW", 1)
    rows = [(i, "u", "x" * 150 if i % 3 else f"{i}" * 200) for i in range(1, 60)]
    got = {r.page_id: (r.record_type, r.refers_to) for r in warc.archive_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: ("revisit", 1) if i % 3 and i > 1 else ("response", None) for i, _, _ in rows}
