"""Token files for tokenizers of every kind, by size, and with many rows of one id."""

import glob
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from sediment.llm import token_files

TEXTS = ["It's the  end\nof a LINE", None, "", "don't <|endoftext|> stop 123", "é中文😀 x", "the " * 500]


@pytest.mark.parametrize("path", sorted(glob.glob(public_tokenizers.path("word_bpe_49k.json").rpartition("/")[0] + "/*.json")))
def test_equal_to_the_library(path):
    try:
        t = Tokenizer.from_file(path)
    except Exception:  # a file of another kind
        pytest.skip("no tokenizer")
    ids, off = token_files.WordEncoder(path).batch(pa.array(TEXTS, pa.string()), 2)
    for x, a, b in zip(TEXTS, off[:-1], off[1:]):
        assert ids[a:b].tolist() == [*t.encode(x or "", add_special_tokens=False).ids, 2], x


def test_which_are_cut_into_words(tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    assert token_files.by_words(path)
    other = tmp_path / "t.json"
    t = Tokenizer.from_file(path)
    t.normalizer = None
    t.save(str(other))
    assert not token_files.by_words(str(other))
    ids, off = token_files.WordEncoder(str(other)).batch(pa.array(TEXTS, pa.string()))
    for x, a, b in zip(TEXTS, off[:-1], off[1:]):
        assert ids[a:b].tolist() == t.encode(x or "", add_special_tokens=False).ids, x


def test_files_by_size_and_one_id(spark, monkeypatch):
    monkeypatch.setattr(token_files, "FILE_BYTES", 5000)
    rows = [(7, f"text number {i} " * 20) for i in range(300)] + [(i, f"other {i}") for i in range(300)]
    path = public_tokenizers.path("word_bpe_49k.json")
    got = token_files.token_files(spark.createDataFrame(rows, "doc_id long, text string"), path).collect()
    t = Tokenizer.from_file(path)
    crc = lambda x: zlib.crc32(np.array([*t.encode(x, add_special_tokens=False).ids, 2], "<u4"))
    assert sorted((r.doc_id, r.ids_crc32) for r in got) == sorted((i, crc(x)) for i, x in rows)
    by_start = sorted(got, key=lambda r: r.start)
    assert [r.start for r in by_start] == np.r_[0, np.cumsum([r.n_tokens for r in by_start])][:-1].tolist()
    assert [r.doc_id for r in by_start] == sorted(i for i, _ in rows)
