from __future__ import annotations

import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from (id, text) pairs, with a further column."""

    def make(rows):
        return spark.createDataFrame(
            [(i, t, "s") for i, t in rows], "doc_id bigint, text string, source string"
        )

    return make
