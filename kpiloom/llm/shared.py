"""Files in the folder that the cluster shares (spark.checkpoint.dir)."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator
from typing import IO

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kpiloom.session import ensure_checkpoint_dir

#: Words of a text: what ASCII white space separates, which is also what bytes.split() does.
WORD_SPACE = " \t\n\x0b\x0c\r"


def run_folder(spark: SparkSession, name: str) -> str:
    """URI of a new folder for one run; files in it stay until its owner removes them."""
    base = ensure_checkpoint_dir(spark)
    if "://" not in base and not base.startswith("file:"):
        base = "file://" + base
    return f"{base.rstrip('/')}/kpiloom-{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, uri: str) -> DataFrame:
    """Write once and read back: cuts lineage, and every reader sees the same rows."""
    df.write.parquet(uri)
    return df.sparkSession.read.schema(df.schema).parquet(uri)


def row_digest(docs: DataFrame) -> Column:
    """Rows with the same digest are equal in every column (a null differs from an empty value)."""
    columns = [F.sha2("text", 256).alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns]
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def _split(uri: str):
    from pyarrow import fs

    if uri.startswith("file:/") and not uri.startswith("file:///"):
        uri = "file:///" + uri[len("file:/"):].lstrip("/")
    return fs.FileSystem.from_uri(uri)


@contextlib.contextmanager
def open_output(uri: str) -> Iterator[IO[bytes]]:
    """Write one file under a name of this attempt and move it into place when it is whole, so
    that a lost or repeated task never leaves a half-written file under the final name."""
    files, path = _split(uri)
    files.create_dir(path.rsplit("/", 1)[0], recursive=True)
    attempt = f"{path}.{uuid.uuid4().hex}.part"
    with files.open_output_stream(attempt) as out:
        yield out
    files.move(attempt, path)


def open_input(uri: str):
    """A random-access pyarrow file."""
    files, path = _split(uri)
    return files.open_input_file(path)
