import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from pothi.session import get_spark

    session = get_spark("tests", cpus=4, **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "3g", "spark.default.parallelism": "4"})
    yield session
    session.stop()
