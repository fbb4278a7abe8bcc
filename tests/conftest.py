from __future__ import annotations

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]

from corpuscope.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", cores="8")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def files(spark):
    """Builds a code_files table from (path, content) pairs."""

    def build(*pairs):
        rows = [(i, p, p.rsplit(".", 1)[-1].lower(), c) for i, (p, c) in enumerate(pairs)]
        return spark.createDataFrame(rows, "seq long, path string, ext string, content string")

    return build
