"""Small tables for the text operators."""

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def make_docs(spark):
    """Documents out of {id: text} or (id, text) pairs; other columns get fixed values.

    With ``clash`` the table also has columns named like results of the operators.
    """
    def make(rows, clash=False):
        pairs = list(rows.items()) if isinstance(rows, dict) else list(rows)
        out = [(i, t, "en", "src0", None if t is None else len(t)) for i, t in pairs]
        schema = DOCS
        if clash:
            extra = ("score", "kept", "n_words", "bands", "ids", "spans", "component_id", "words",
                     "start", "comp", "node", "first", "y", "_rank", "failed")
            out = [(*r, *("x",) * len(extra)) for r in out]
            schema += "".join(f", {c} string" for c in extra)
        return spark.createDataFrame(out, schema)
    return make


@pytest.fixture
def make_labels(spark):
    def make(rows):
        return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")
    return make
