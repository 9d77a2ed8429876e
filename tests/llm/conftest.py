import os

import pytest

DATA = os.environ.get("TARN_TEST_DATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def data():
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    return DATA


@pytest.fixture(scope="session")
def documents(data):
    import duckdb

    return duckdb.sql(f"SELECT doc_id, text, lang, source FROM '{data}/documents.parquet' ORDER BY doc_id").fetchall()
