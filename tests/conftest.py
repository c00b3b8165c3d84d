import pytest

from rosterline.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "local[4]", "rosterline-tests",
        **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false",
           "spark.driver.memory": "4g", "spark.sql.ansi.enabled": "true"},
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
