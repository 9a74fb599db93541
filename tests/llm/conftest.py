import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows, extra=False):
    """Documents from (doc_id, text[, lang[, source]]); extra adds columns whose names operators might use."""
    full = [(r[0], r[1], *(list(r[2:]) + ["en", "a"][len(r) - 2 :]), None if r[1] is None else len(r[1])) for r in rows]
    df = spark.createDataFrame(full, SCHEMA)
    if extra:
        df = df.selectExpr("*", "'x' as h", "'y' as node", "1 as size", "2 as kept", "3 as score", "4 as lang_pred", "5 as bucket", "6 as n_removed", "7 as taken", "8 as label", "9 as cls", "10 as word", "11 as length", "12 as start")
    return df


@pytest.fixture
def odd():
    """Rows with nulls, empty, blank and very long texts, ties and repeats."""
    long_ = " ".join(f"wörd{i % 977} the of" for i in range(30_000))
    text = "the quick brown fox jumps over the lazy dog and runs away\nsecond line here\nthird line there\nfourth"
    return [(1, None), (2, ""), (3, " \n\t"), (4, text), (5, text), (5, text), (None, text), (None, None, None, None), (6, long_), (7, "x" * 50_000), (8, "one", None, "b"), (9, "1234 5678 !!", "de", None), (10, "日本語 のテキスト é́ ﬁ", "ja", "c"), (11, text + " more", "fr", "b"), (12, "a\nb\nc\na\nb\nc")]
