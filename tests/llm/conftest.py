import pytest

from wavetrail.llm.common import reach_workers

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    """Documents from texts or (id, text) pairs, with columns whose names operators use themselves."""
    reach_workers(spark)

    def make(texts, sources=None):
        pairs = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
        rows = [(i, t, "en", (sources or {}).get(i, "s"), 0, 1, "x", 0.5, True) for i, t in pairs]
        return spark.createDataFrame(rows, DOCS + ", kept long, digest string, score double, maybe boolean")

    return make
