import os

import pytest

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table of the given texts, with columns that have other uses inside the operators."""

    def build(texts, ids=None):
        rows = [(i if ids is None else ids[i], t, "en", f"src{i % 3}", None if t is None else len(t), "x", i) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, ids string, start bigint")

    return build
