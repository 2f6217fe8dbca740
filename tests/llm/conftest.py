import pytest

from chronolith.llm.tokenize import VOCABULARY


@pytest.fixture(scope="session")
def vocabulary():
    from pathlib import Path

    if not Path(VOCABULARY).exists():
        pytest.skip("no vocabulary here")
    return VOCABULARY
