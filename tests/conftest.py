import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pitwall.session import get_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = get_session("local[4]", app="pitwall-tests", shuffle_partitions=4)
    yield s
    s.stop()


@pytest.fixture
def tmp_dir(tmp_path):
    return str(tmp_path)


# teams of one, two and three drivers; ids with gaps, teams in no order of name
ROSTER_ROWS = [
    (12, "Jo Lark", "Deneb", "#667788"),
    (15, "Cy Rowe", "Lyra", "#334455"),
    (16, "Kim Oda", "Vega", "#223344"),
    (21, "Ada Quill", "Orion", "#112233"),
    (30, "Lou Fenn", "Lyra", "#334455"),
    (31, "Ben Marsh", "Orion", "#112233"),
    (44, "Mo Tell", "Lyra", "#334455"),
]


@pytest.fixture
def roster(spark):
    return spark.createDataFrame(ROSTER_ROWS, "id int, name string, team string, team_color string")
