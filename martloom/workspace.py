"""Written intermediate tables.

Every frame that is used more than once, or whose rows must not move any more, is
written to a table below the session's shared checkpoint folder and read back. A
lost executor then costs a re-read, never a different answer, and the readers see a
relation of known size.
"""

from __future__ import annotations

import re
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Written tables with more rows are not gathered on the driver for a join, however few bytes their files have.
BROADCAST_ROWS = 100_000

_PACKAGE_ROOT = str(Path(__file__).resolve().parent.parent)


def shared_folder(spark: SparkSession) -> str:
    """The folder named by `spark.checkpoint.dir`; a local session may go without it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    folder = spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    folder = tempfile.mkdtemp(prefix="martloom-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


@dataclass(frozen=True)
class Saved:
    """A frame that reads the same rows every time, and how many they are."""

    df: DataFrame
    rows: int
    path: str | None = None

    def for_join(self) -> DataFrame:
        """The frame as what others look up: beyond BROADCAST_ROWS both sides of the join are shuffled."""
        return self.df if self.rows <= BROADCAST_ROWS else self.df.hint("shuffle_hash")


@dataclass(frozen=True)
class Proven:
    """A frame whose declared key is unique by the way it was made, if it has exactly `rows` rows.

    `how` says what the rows are; a join that doubled one of them would make more.
    """

    df: DataFrame
    rows: int
    how: str


class Workspace:
    """Tables of one run. What is saved inside `scratch()` goes when that block ends, unless it was kept."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark = spark
        self.root = root or f"{shared_folder(spark)}/martloom-{uuid.uuid4().hex}"
        self._blocks = threading.local()

    @property
    def cores(self) -> int:
        return self.spark.sparkContext.defaultParallelism

    def path(self, name: str) -> str:
        return f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"

    def ship_package(self) -> None:
        """Lets Python workers on this machine find the package where it lies; a cluster gets it with --py-files."""
        self.spark.sparkContext.environment.setdefault("PYTHONPATH", _PACKAGE_ROOT)

    def save(self, df: DataFrame, name: str) -> Saved:
        """Write once, count during the write, read back."""
        saved = save_parquet(df, self.path(name))
        if blocks := getattr(self._blocks, "open", None):
            blocks[-1].append(saved.path)
        return saved

    @contextmanager
    def scratch(self) -> Iterator[None]:
        """Tables that this thread saves inside the block are removed at its end, whether it ends well or not.

        So the block must write what it makes of them. Blocks nest; each removes its own tables.
        """
        blocks = self._blocks.open = getattr(self._blocks, "open", None) or []
        blocks.append([])
        try:
            yield
        finally:
            for path in blocks.pop():
                remove(self.spark, path)

    def keep(self, saved: Saved) -> Saved:
        """Leaves a table of the innermost block to whoever asked for it."""
        if blocks := getattr(self._blocks, "open", None):
            blocks[-1].remove(saved.path)
        return saved


def exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def remove(spark: SparkSession, path: str) -> None:
    """Removes a written table from whatever file system it lies in."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def save_parquet(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> Saved:
    seen = Observation()
    counted = df.observe(seen, F.count(F.lit(1)).alias("rows"))
    counted.write.mode("overwrite").partitionBy(*partition_by).parquet(path, compression="zstd")
    written = df.sparkSession.read.schema(df.schema).parquet(path)
    return Saved(written.select(*df.columns), seen.get["rows"], path)
