"""Arrow maps whose functions find this package on every executor."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame

_PACKAGE = Path(__file__).resolve().parents[1]
_shipped: set[str] = set()


#: Rows of an Arrow batch where the session doesn't say: Spark's default of 10,000 is made
#: for narrow rows, and texts of that many documents fill a worker's memory.
BATCH_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship(spark) -> None:
    """Give the executors a copy of this package's sources, once per application, and set the
    session's Arrow batch to BATCH_ROWS if it is unset."""
    if spark.conf.get(_BATCH, "0") == "0":
        spark.conf.set(_BATCH, str(BATCH_ROWS))
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    # Spark copies the archive from the driver; nobody else reads this folder
    path = Path(tempfile.mkdtemp()) / f"{_PACKAGE.name}.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(_PACKAGE.rglob("*.py")):
            z.write(f, Path(_PACKAGE.name) / f.relative_to(_PACKAGE))
    spark.sparkContext.addPyFile(str(path))
    _shipped.add(app)


def arrow_map(df: DataFrame, function, schema: str) -> DataFrame:
    ship(df.sparkSession)
    return df.mapInArrow(function, schema)
