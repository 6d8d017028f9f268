import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from depweave.session import local_session  # noqa: E402

# Hundreds of tiny plans: compiling each one costs more than running it.
FAST = {
    "spark.sql.adaptive.enabled": "false",
    "spark.sql.shuffle.partitions": "2",
    "spark.sql.codegen.wholeStage": "false",
    "spark.sql.codegen.factoryMode": "NO_CODEGEN",
}


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "depweave-tests")
    session.sparkContext.setLogLevel("ERROR")
    for key, value in FAST.items():
        session.conf.set(key, value)
    yield session
    session.stop()
