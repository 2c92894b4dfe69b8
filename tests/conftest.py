import os
import sys

import pytest


sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark():
    from pyspark import cloudpickle

    import kit
    from tidemark.session import build_session

    cloudpickle.register_pickle_by_value(kit)
    session = build_session("tests", 4)
    # fixtures are a handful of rows: compiling plans would cost more than running them
    for key, value in {
        "spark.sql.shuffle.partitions": "2",
        "spark.sql.codegen.wholeStage": "false",
        "spark.sql.codegen.factoryMode": "NO_CODEGEN",
        "spark.sql.adaptive.enabled": "false",
    }.items():
        session.conf.set(key, value)
    yield session
    session.stop()
