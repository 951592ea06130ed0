import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from assaykit import get_spark
    s = get_spark("local[4]", shuffle_partitions=8, extra={"spark.driver.memory": "4g"})
    yield s
    s.stop()


@pytest.fixture
def payloads(spark):
    """Build a payloads DataFrame from (provider, raw) pairs."""
    import datetime as dt

    def make(*items):
        rows = [(f"p{i}", prov, raw, dt.datetime(2024, 10, 15, 12, 0, 0)) for i, (prov, raw) in enumerate(items)]
        return spark.createDataFrame(rows, "payload_id string, provider string, raw string, received_at timestamp")
    return make
