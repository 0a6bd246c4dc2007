"""Tables written to the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where that is unset and all tasks run on this machine, as in tests, a temporary folder is set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lodestone-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a written table, so that what follows doesn't compute it again, or call a provider again."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_part(path: str, part: str, columns: list[str]) -> pa.Table | None:
    """Columns of one part of a written table, inside a task; None where there is no such part. The part's size is the writer's to bound."""
    import pyarrow.dataset as ds
    import pyarrow.fs as pafs

    fs, base = pafs.FileSystem.from_uri(path if ":" in path else f"file://{path}")
    folder = f"{base}/{part}"
    if fs.get_file_info(folder).type == pafs.FileType.NotFound:
        return None
    return ds.dataset(folder, filesystem=fs, format="parquet").to_table(columns=columns)
