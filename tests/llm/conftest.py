import pytest
from odd import TEXTS, written


@pytest.fixture(scope="session")
def edge(spark, tmp_path_factory):
    """Tables of odd rows, with labels for some that exist and some that do not."""
    labels = [(3, 1, 0), (7, 0, 1), (7, 0, 1), (999, 1, 1), (None, 1, 1), (4, None, None)]
    return written(spark, tmp_path_factory.mktemp("edge"), TEXTS, labels)


@pytest.fixture(scope="session")
def empty(spark, tmp_path_factory):
    return written(spark, tmp_path_factory.mktemp("empty"), [])
