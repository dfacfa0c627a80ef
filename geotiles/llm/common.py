"""Helpers that the operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters that separate words: space and \t \n \v \f \r.
SPACES = " \t\n\x0b\f\r"
#: The same as a character class for Java's regular expressions.
SPACE_CLASS = "[\\x20\\x09-\\x0D]"


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; only where none is set, as in tests, one of our own."""
    found = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="geotiles-"))
        found = spark.sparkContext.getCheckpointDir()
    return found


#: Spark's setting to delete a query's shuffle files once the query has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, compression: str = "zstd") -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it again.

    This cuts the lineage and survives the loss of any executor.  The files
    belong to the checkpoint folder and go with it.  What was shuffled to make
    them is not needed any more and is deleted at once; by default Spark waits
    for the driver's garbage collection, and disks fill up before that.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/geotiles-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", compression).parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    written = spark.read.schema(df.schema).parquet(path)
    written._geotiles_path = path
    return written


def discard(*written: DataFrame) -> None:
    """Delete what ``materialize`` wrote; nothing that is still to run may read it."""
    for df in written:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df._geotiles_path)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def unused(names: list[str], *wanted: str) -> list[str]:
    """Column names like the wanted ones that ``names`` has not, in any case of letters."""
    taken = {x.lower() for x in names}
    out = []
    for name in wanted:
        k = 0
        while f"_{name}{k}" in taken:
            k += 1
        taken.add(f"_{name}{k}")
        out.append(f"_{name}{k}")
    return out


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and give it to ``body`` as a lambda variable."""
    return F.transform(F.array(value), body).getItem(0)


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
