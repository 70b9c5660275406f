"""Fixtures of these tests; a conftest here would hide that of the folder above."""

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")


@pytest.fixture(autouse=True)
def prepared(spark):
    from authlytics.llm.common import prepare
    prepare(spark)


@pytest.fixture(scope="session")
def vocab():
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")
