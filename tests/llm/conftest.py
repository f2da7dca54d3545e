import pytest

from tests.conftest import spark  # noqa: F401


@pytest.fixture(scope="session")
def tokenizer():
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")
