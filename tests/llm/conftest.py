import public_tokenizers
import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def byte_bpe():
    return public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table of texts, or of (id, text) pairs; further columns have names that operators use themselves."""

    def make(texts, **columns):
        pairs = [t if isinstance(t, tuple) else (k, t) for k, t in enumerate(texts)]
        extra = {"score": "x", "row": 1, "node": 2.5, "key": None, **columns}
        spec = DOCS + ", score string, row int, node double, key string"
        return spark.createDataFrame([(i, t, columns.get("lang", {}).get(i), "s", len(t or ""), extra["score"], extra["row"], extra["node"], extra["key"]) for i, t in pairs], spec)

    return make


@pytest.fixture(scope="session")
def sample(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
