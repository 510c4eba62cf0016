"""The sample that language identification learns from."""

from collections import Counter

from sediment.llm import language_id


def test_rare_languages_keep_their_rows_beside_common_ones(spark):
    rows = [(i, f"common {i}", f"c{i % 70:02}") for i in range(70 * 300)]
    rows += [(100_000 + i, f"rare {i}", f"r{i % 150:03}") for i in range(150 * 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    n = Counter(lang for lang, _ in language_id._sample(df, 5, 100))
    assert len([x for x in n if x[0] == "r"]) == 150 and all(n[f"r{i:03}"] == 5 for i in range(150))
    assert all(n[f"c{i:02}"] == 5 for i in range(70))
