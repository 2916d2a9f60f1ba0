from __future__ import annotations

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from capturelens.session import build_session  # noqa: E402
from capturelens.streaming.telemetry import ROCKSDB  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[8]", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "8g",
        "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
    })
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture
def split(spark):
    """Cut every ordered frame into blocks, however small it is."""
    spark.conf.set("spark.capturelens.block.rows", "150")
    yield spark
    spark.conf.unset("spark.capturelens.block.rows")
