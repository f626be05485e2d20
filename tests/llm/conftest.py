import zlib

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def crc(i, m):
    return zlib.crc32(str(i).encode() if i is not None else b"") % m


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text[, source[, lang]]) with extra columns whose names clash with those that operators make."""

    def build(rows, extra=True):
        rows = [(*r, None, None)[:4] for r in rows]
        df = spark.createDataFrame([(i, t, lang, s, len(t or "")) for i, t, s, lang in rows], DOCS)
        if extra:
            for name in ("size", "key", "fp", "score", "shard", "target", "slot", "n", "copies", "chance", "rid", "cell", "component_id"):
                df = df.selectExpr("*", f"'x' AS {name}")
        return df

    return build
