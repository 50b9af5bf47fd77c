import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from bastionlog.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests", "local[4]", spark__sql__shuffle__partitions="4", spark__driver__memory="6g",
        spark__checkpoint__dir=str(tmp_path_factory.mktemp("checkpoints")),
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make_lines(spark):
    """Lines from texts: (text) or (text, stream, second)."""
    from datetime import datetime, timedelta

    def make(texts):
        start = datetime(2024, 5, 1)
        rows = []
        for i, t in enumerate(texts):
            text, stream, second = t if isinstance(t, tuple) else (t, 0, i)
            rows.append((i, stream, start + timedelta(seconds=second), text))
        return spark.createDataFrame(rows, "line_index bigint, stream_id bigint, ts timestamp_ntz, raw_message string")

    return make
