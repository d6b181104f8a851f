import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
# Python workers find the package wherever the tests are started.
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [str(ROOT), os.environ.get("PYTHONPATH", "")]))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").appName("tilewright-tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g").config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture
def pixels_of(spark):
    """pixels(image_id, h, w, y, x, v) of a 2-D array."""

    def make(v, image_id="a"):
        h, w = v.shape
        return spark.createDataFrame([(image_id, h, w, y, x, float(v[y, x])) for y in range(h) for x in range(w)], "image_id string, h int, w int, y int, x int, v double").repartition(3)

    return make


@pytest.fixture
def array_of():
    """The 2-D array of a pixels table's column."""
    import numpy as np

    def make(df, column="m"):
        rows = df.select("h", "w", "y", "x", column).collect()
        out = np.full((rows[0].h, rows[0].w), np.nan)
        for r in rows:
            out[r.y, r.x] = r[column]
        assert len(rows) == out.size and not np.isnan(out).any()
        return out

    return make
