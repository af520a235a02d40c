from __future__ import annotations

import os

import pytest


@pytest.fixture(scope="session")
def tokenizers():
    d = os.environ.get("GLEANWORK_TOKENIZERS", "/opt/tokenizers")
    if not os.path.exists(f"{d}/byte_bpe_50k.tiktoken"):
        pytest.skip("no public vocabularies here")
    return d
