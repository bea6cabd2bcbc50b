"""Stage documents: written whole or not at all, by one writer at a time in effect, and the price list that lies beside them.

A version of a stage is a folder of rows and an entry in the stage's log, numbered one after the other. An entry appears whole or not at
all and never replaces another: whoever names the next number first has it. A writer says which version it has read; if another one
came in between, its commit fails, and it reads again and retries, so no update is lost. A reader sees the newest entry's rows,
never a mixture, and a writer or executor that is lost half-way leaves the version before. The log needs a file system
whose rename fails if the target is there, as HDFS; local folders use a link, which does.
"""

from __future__ import annotations

import json
import random
import tempfile
import time
import uuid
from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LOG = "_log"


class StageConflict(RuntimeError):
    """Another writer has committed since the version that was read."""


def _fs(spark: SparkSession, path: str):  # noqa: ANN202
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder of the session; in local mode, without one, in a temporary folder."""
    sc = spark.sparkContext
    shared = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="stage")
    return f"{shared}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """The table written to the session's shared folder, its lineage cut."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(scratch(spark, "checkpoints"))
    return df.checkpoint()


# ---------------------------------------------------------------- the log


def current(spark: SparkSession, path: str) -> tuple[int, str | None]:
    """Number and folder of the version in force; 0 and none before the first."""
    fs, log = _fs(spark, f"{path}/{LOG}")
    if not fs.exists(log):
        return 0, None
    numbers = [int(name) for s in fs.listStatus(log) if (name := s.getPath().getName()).isdigit()]
    if not numbers:
        return 0, None
    entry = spark.read.text(f"{path}/{LOG}/{max(numbers):012d}").first()[0]
    return max(numbers), f"{path}/{json.loads(entry)['rows']}"


def _entered(spark: SparkSession, path: str, number: int, entry: dict) -> bool:
    """Puts an entry into the log, whole, unless its number is taken."""
    jvm = spark.sparkContext._jvm
    fs, fresh = _fs(spark, f"{path}/{LOG}/.{uuid.uuid4().hex}")
    _, target = _fs(spark, f"{path}/{LOG}/{number:012d}")
    out = fs.create(fresh, False)
    out.write(bytearray(json.dumps(entry).encode()))
    out.close()
    try:
        if fs.getScheme() == "file":
            file = lambda p: jvm.java.io.File(p.toUri().getPath()).toPath()
            jvm.java.nio.file.Files.createLink(file(target), file(fresh))
        else:
            none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(fresh, target, none)
        return True
    except Exception as e:
        if "FileAlreadyExistsException" in str(getattr(e, "java_exception", e)) or fs.exists(target):
            return False
        raise
    finally:
        if fs.exists(fresh):
            fs.delete(fresh, False)


def _write_rows(df: DataFrame, path: str) -> str:
    name = f"v-{uuid.uuid4().hex}"
    df.write.json(f"{path}/{name}", ignoreNullFields=False)
    return name


def commit_stage(df: DataFrame, path: str, read_version: int) -> int:
    """Writes the rows as the version behind the one that was read, and gives its number. StageConflict: somebody was first, nothing changed."""
    spark = df.sparkSession
    if current(spark, path)[0] != read_version:
        raise StageConflict(f"{path} is no longer at version {read_version}")
    if not _entered(spark, path, read_version + 1, {"rows": _write_rows(df, path)}):
        raise StageConflict(f"{path} got version {read_version + 1} from another writer")
    return read_version + 1


def write_stage(df: DataFrame, path: str, tries: int = 100) -> int:
    """A new version whatever the one before holds; gives its number. The rows are written once, only their number is tried again."""
    spark, entry = df.sparkSession, {"rows": _write_rows(df, path)}
    for _ in range(tries):
        number = current(spark, path)[0] + 1
        if _entered(spark, path, number, entry):
            return number
    raise StageConflict(f"{path} changed {tries} times meanwhile")


def update_stage(spark: SparkSession, path: str, like: T.StructType, change: Callable[[DataFrame], DataFrame], tries: int = 50) -> int:
    """Reads the version in force, changes it and commits; if another writer was first, all of it again on what that one left."""
    for n in range(tries):
        number, _ = current(spark, path)
        before = read_stage(spark, path, like) if number else spark.createDataFrame([], like)
        try:
            return commit_stage(change(before), path, number)
        except StageConflict:
            time.sleep(random.random() * min(1.0, 0.05 * 2**n))
    raise StageConflict(f"{path} changed {tries} times meanwhile")


def read_stage(spark: SparkSession, path: str, like: T.StructType, strict: bool = True) -> DataFrame:
    """The version in force."""
    number, rows = current(spark, path)
    if not number:
        raise PySparkException(f"{path} has no version yet")
    return spark.read.schema(like).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(rows)


def read_pricing(spark: SparkSession, path: str) -> DataFrame:
    """(model, p_in, p_out, p_read, p_write): dollars per million tokens; rates that a row lacks are 0."""
    rows = spark.read.schema("model string, input double, output double, cache_read double, cache_write double").json(path)
    rate = lambda c, name: F.coalesce(c, F.lit(0.0)).alias(name)
    return rows.select("model", rate("input", "p_in"), rate("output", "p_out"), rate("cache_read", "p_read"), rate("cache_write", "p_write"))
