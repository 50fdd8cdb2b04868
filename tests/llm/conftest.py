import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

DOCS = "doc_id long, text string, lang string, source string, n_chars long, part int, row long, n int"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty, long and repeated texts, ties, and columns whose names clash with what operators add."""
    base = "The quick brown fox jumps over the lazy dog and runs far away from the big bad wolf today. "
    rows = [
        (1, base * 3, "en", "s", 1, 7, 7, 7), (2, base * 3, "en", "s", 1, 7, 7, 7), (3, base * 3 + "extra", "en", "s", 1, 7, 7, 7), (4, None, None, None, None, None, None, None), (5, "", "en", "s", 0, 1, 1, 1),
        (6, "one two", "en", "s", 7, 1, 1, 1), (6, "one two", "en", "s", 7, 1, 1, 1), (None, "no id here at all, none", "en", "s", 7, 1, 1, 1), (8, "word " * 30_000, "en", "s", 7, 1, 1, 1),
        (9, "  double  spaces\n\n and <|endoftext|> ümläut İ ΣΑΣ 日本\t\x00x", "de", "s", 7, 1, 1, 1), (10, "!!! ...", "en", "s", 7, 1, 1, 1),
    ]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCS)
