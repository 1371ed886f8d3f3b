import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark():
    from pyspark import cloudpickle

    import cytomosaic
    from cytomosaic.session import local_session

    cloudpickle.register_pickle_by_value(cytomosaic)
    session = local_session(4, "tests", 4)
    yield session
    session.stop()
