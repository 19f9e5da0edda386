import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, os.environ.get("PYTHONPATH", "")) if x)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from claimframe.plans.session import local

    s = local(4, "4g")
    s.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoint")))
    yield s


@pytest.fixture(scope="session")
def rows(spark):
    """Rows of a DataFrame as a sorted list of tuples."""

    def f(df, *cols):
        d = df.select(*cols) if cols else df
        return sorted((tuple(r) for r in d.collect()), key=repr)

    return f
