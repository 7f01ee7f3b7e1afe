import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pagewarden.session import local_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "tests", shuffle_partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def crawl(spark):
    """Builds a crawl DataFrame from (url, html[, status[, cookies]]) tuples."""
    from pagewarden import schemas

    def build(*pages):
        rows = []
        for i, page in enumerate(pages):
            url, html, status, cookies = (*page, *(200, [])[len(page) - 2:])
            rows.append((i, url, url, status, html, None, cookies, None))
        return spark.createDataFrame(rows, schemas.CRAWL)

    return build
