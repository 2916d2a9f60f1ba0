from __future__ import annotations

import pytest


@pytest.fixture(scope="session", autouse=True)
def shared_folder(spark, tmp_path_factory):
    """A folder for written tables; the session names none in tests."""
    spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))


DOC_COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture
def documents(spark):
    """Builds a documents table from (doc_id, text[, source]) with extra columns of clashing names."""

    def make(rows):
        full = [
            (r[0], r[1], None, r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1]), "x", -1, None)
            for r in rows
        ]
        return spark.createDataFrame(
            full, DOC_COLUMNS + ", digest string, n bigint, label string"
        ).repartition(3)

    return make
