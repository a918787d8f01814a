import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

from pageloom.session import local_session, tune  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = tune(local_session("4", 4))
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture
def pages(spark):
    """pages(html, ...) -> a page table with ids 1, 2, ..."""
    def build(*html, url="https://h.example.org/a/b"):
        return spark.createDataFrame([(i + 1, url, h) for i, h in enumerate(html)], "page_id long, url string, html string")

    return build
