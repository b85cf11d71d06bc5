import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

#: Names that the operators use inside; a table may have columns of these names too.
CLASHES = ("size", "node", "n", "digest", "key", "pos", "a", "b", "component", "doc", "copy", "again", "word", "_told", "verdict", "rank")


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Documents with every awkward case; build(rows, more columns)."""

    def build(rows, extra=True, schema="doc_id bigint, text string, lang string, source string, n_chars bigint"):
        from pyspark.sql import functions as F

        df = spark.createDataFrame([(*r, *[None] * (5 - len(r))) for r in rows], schema)
        return df.withColumns({c: F.lit("x") for c in CLASHES}) if extra else df

    return build


LONG = " ".join(f"w{i % 997}x{i % 31}" for i in range(30000))
ODD = [
    (1, None, "en", "s"), (2, "", "en", "s"), (3, " \t\n", None, None), (4, "one", "en", None),
    (5, "the same words here again and again for all of us", "en", "s"),
    (6, "The SAME words here again and again for all of us", "en", "s"),
    (6, "The SAME words here again and again for all of us", "en", "s"),
    (None, "the same words here again and again for all of us", "en", "t"), (None, None, None, None),
    (7, LONG, "en", "t"), (8, LONG + " tail", "en", "t"), (9, "é\u0000ü 漢字 😀 ​", "de", "😀" if False else "😀"),
    (-3, "12345 !!! ...", "de", ""),
]
