import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """(doc_id, text[, source]) rows as a documents table with columns that clash with operators' own."""

    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or ""), -1.0, "x", 7, True, 3) for r in rows]
        return spark.createDataFrame(full, DOCS + ", score double, fingerprint string, size long, held_out boolean, component_id long")

    return make
