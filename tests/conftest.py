import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from fathom import get_spark
    s = get_spark("local[*]", shuffle_partitions=8,
                  conf={"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
                        "spark.driver.memory": "4g"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
