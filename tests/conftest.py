import pytest

from logweir.session import local_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    root = tmp_path_factory.mktemp("checkpoint")
    session = local_session(
        8,
        "tests",
        **{
            "spark.checkpoint.dir": str(root),
            "spark.sql.shuffle.partitions": 4,
            "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
        },
    )
    yield session
    session.stop()
