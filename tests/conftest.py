import pytest

from recurva.session import build_session, clear_scratch


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = tmp_path_factory.mktemp("shared").as_uri()
    session = build_session("recurva-tests", "local[8]", **{
        "spark.sql.shuffle.partitions": "3", "spark.driver.memory": "4g", "spark.checkpoint.dir": shared})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    clear_scratch(session)
    session.stop()
