"""Written stages between jobs, and joins whose broadcast is checked by size."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A written stage may be broadcast up to this many bytes of rows times width; larger ones are joined by shuffle.
BROADCAST_BYTES = 32 << 20
_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it; one of our own only in local mode, where none need be named."""
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="spark-")
        _at_exit(spark, _OWN[app])
    return _OWN[app]


def _at_exit(spark: SparkSession, path: str) -> None:
    """Have the file system delete a path when the application ends."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)


def keep(df: DataFrame) -> DataFrame:
    """Write a stage to the shared folder and read it back: it is computed once, outlives executors, has no lineage and goes when the application ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stage-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _at_exit(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out.kept_at, out._light = path, (0, False)
    return out


def kept_bytes(kept: DataFrame) -> int:
    """Bytes of a kept stage as rows times width: 16 for each column, and what strings and arrays hold."""
    width: list = []
    for f in kept.schema.fields:
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            width.append(F.octet_length(F.col(f.name)))
        elif isinstance(f.dataType, (T.ArrayType, T.MapType)):
            width.append(16 * F.greatest(F.size(F.col(f.name)), F.lit(0)))
    each = sum((F.coalesce(w, F.lit(0)).cast("long") for w in width), F.lit(16 * len(kept.schema.fields)).cast("long"))
    return kept.agg(F.sum(each)).first()[0] or 0


def light(kept: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """A kept stage with a broadcast hint if its rows times width are few enough bytes, else as it is. Files so small that no compression could hide more are not measured."""
    if kept._light[0] != most:
        spark = kept.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(kept.kept_at)
        on_disk = path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
        kept._light = (most, on_disk * 32 <= most or (on_disk <= most and kept_bytes(kept) <= most))
    return F.broadcast(kept) if kept._light[1] else kept
