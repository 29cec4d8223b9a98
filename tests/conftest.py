import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from lintlake.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = build_session("tests", "local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "6g"})
    s.sparkContext.setLogLevel("ERROR")
    s.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoint")))
    yield s
    s.stop()


@pytest.fixture(scope="session")
def audit(spark):
    """audit({path: content}) -> sorted list of findings as dicts."""
    from lintlake.plans.audit import findings

    def run(files, profile="extended", groups=None, context=False, select=False):
        df = spark.createDataFrame([("r", p, c) for p, c in files.items()], "repo string, path string, content string")
        rows = findings(df, profile, groups, context=context, select=select).collect()
        return [r.asDict(recursive=True) for r in sorted(rows, key=lambda r: (r.file, r.ord, r.seq))]

    return run
