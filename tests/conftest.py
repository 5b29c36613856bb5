import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from logtide import get_spark

    session = get_spark(
        "logtide-tests",
        "local[8]",
        spark__sql__shuffle__partitions="8",
        spark__ui__enabled="false",
        spark__driver__memory="8g",
        spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared")),
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def folder():
    return SF


@pytest.fixture(scope="session")
def telecom(spark):
    """240 sessions of four telecom-style events; a quarter of the sessions are abnormal."""
    rows, row_id = [], 0
    calm = ["registration accepted for supi-{0}", "session ses-{0} established on cell-{1}", "handover to gnb-{1} completed",
            "policy pol-{1} applied latency {0} ms"]
    bad = ["registration rejected for supi-{0} timeout", "session ses-{0} dropped overload on cell-{1}", "handover to gnb-{1} failed",
           "authentication sec-{1} failure burst {0}"]
    for session in range(240):
        label = 1 if session % 4 == 0 else 0
        part = ("train", "train", "train", "validation", "test")[(session // 4) % 5]
        for step in range(4):
            row_id += 1
            texts = bad if label and step % 2 else calm
            text = f"2026-01-{1 + session % 28:02d} {step:02d}:{session % 60:02d}:00.000 " + texts[(session + step) % 4].format(session, step)
            rows.append((row_id, text, label, f"scn-{session}", f"s{session}", f"T{label if step % 2 else 0}-{(session + step) % 4}",
                         part, f"2026-01-{1 + session % 28:02d}T{step:02d}:{session % 60:02d}:00Z", "burst" if label else "none"))
    return spark.createDataFrame(
        rows,
        "row_id bigint, log_text string, target int, scenario_id string, session_id string, template_id string, split string, timestamp string, anomaly_type string",
    )


@pytest.fixture(scope="session")
def prepared(telecom):
    from logtide.operators.prepare import prepare_logs
    from logtide.runtime import stored

    return stored(prepare_logs(telecom, row_id="row_id"), "prepared")
