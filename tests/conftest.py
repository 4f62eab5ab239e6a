import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tools")]
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "4")
         .config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
         .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared"))).getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture()
def small_chunks(monkeypatch):
    """Chunks far shorter than the tracks, so every halo and carry is used."""
    from trackspark.operators import chunk

    monkeypatch.setattr(chunk, "CHUNK_FRAMES", 16)


def series(spark, values, track=1, name="signal"):
    """One track from a list (None is null)."""
    rows = [(track, i, None if v is None else float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, f"track_id long, frame long, {name} double")


def column(df, name, order=("track_id", "frame")):
    return [r[name] for r in df.orderBy(*order).collect()]
