import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from custlens.session import checkpoint_dir, get_spark

    s = get_spark("custlens-tests", cpus="4", shuffle_partitions=4)
    checkpoint_dir(s)
    yield s


@pytest.fixture(scope="session")
def tables(spark):
    def load(name):
        return spark.read.parquet(f"{SF}/{name}.parquet")

    return load
