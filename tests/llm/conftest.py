import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
from texts import sentences  # noqa: E402


def odd_rows(n: int = 60):
    """Texts in four languages, with nulls, empty and repeated rows, a long text and a long word."""
    rows = [(i, sentences(lang, 20 + i, i), lang, f"s{i % 3}") for i, lang in enumerate(["en", "de", "fr", "es"] * (n // 4))]
    rows += [(1000, None, "en", "s0"), (1001, "", "de", None), (None, "a null id here", "en", "s1"), (1002, " \n\t ", None, "s2"), (1003, "1234 !!! ...", "en", "s0")]
    rows += [(1004, sentences("en", 12000), "en", "s0"), (1005, "x" * 20000, "en", "s0"), rows[0], rows[0], (1006, "日本語 テキスト", "en", "s9")]
    return rows


@pytest.fixture(scope="session")
def docs(spark):
    """Odd rows, with extra columns whose names clash with those the operators make."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(odd_rows(), "doc_id long, text string, lang string, source string")
    return df.withColumns({"score": F.lit("kept"), "fp": F.lit(1), "key": F.lit(2), "sequence_id": F.lit(3), "n_chars": F.length("text").cast("long")})


@pytest.fixture(scope="session")
def none(docs):
    return docs.where("false")
