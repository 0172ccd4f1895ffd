import numpy as np
import pytest

from morpholake.llm.blocks import Block


@pytest.fixture
def block():
    def make(texts):
        data = [t.encode() for t in texts]
        return Block(None, b"".join(data), np.concatenate(([0], np.cumsum([len(x) for x in data]))).astype(np.int64))

    return make


@pytest.fixture
def docs(spark):
    """Documents with a null, an empty and a long text, ties, repeated rows, and columns whose names clash with results."""
    names = ["score", "component_id", "n_tokens", "fingerprint", "sequence_id", "spans", "part", "bucket"]
    base = [(1, "The cat sat on the mat.\nIt was 44.161.181.40, wasn't it?  Yes"), (2, None), (3, ""), (4, "éa 日本 語 word "), (5, "word " * 3000), (6, "The cat sat on the mat.\nIt was 44.161.181.40, wasn't it?  Yes"), (7, "x"), (7, "x"), (None, "no id"), (8, " \n\t ")]
    return spark.createDataFrame([(i, t, "en", "s", 1, *["z"] * len(names)) for i, t in base], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names))


@pytest.fixture
def no_docs(docs):
    return docs.limit(0)
