import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, h long, class_id long, n_words string, fail_mask int, label int, bucket string, key string, queue int, row_id long, label_extra string"


def row(doc_id, text, source="s0"):
    return (doc_id, text, "en", source, len(text or ""), 0.5, 1, 2, "x", 3, 1, "b", "k", 1, 2, "y")


@pytest.fixture(scope="session")
def hard(spark):
    """Nulls, empty, white, very long and repeated texts, repeated rows, ties, and columns whose names the operators use themselves."""
    base = " ".join(f"word{i % 97}" for i in range(300))
    rows = [
        row(1, None), row(2, ""), row(3, " \t\n "), row(4, "one"), row(5, "One  TWO"), row(6, base), row(7, base), row(8, base + " tail", None), row(8, base + " tail", None),
        row(9, "a\nb\na\n" * 20), row(None, "no id " * 30), row(10, "длинный текст é ñ ß 日本 😀 " * 40, "ß"), row(11, "x" * 50_000), row(12, " ".join(f"w{i}" for i in range(30_000))), row(13, "<|endoftext|> ### $$$ " * 30, ""),
    ]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCS)
