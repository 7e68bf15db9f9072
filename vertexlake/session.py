"""Session settings, lineage cutting and shipping of this package to the executors."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of at most this many are broadcast by `broadcast_if_small`; a row is a key and a few numbers, so
#: this is below about 20 MB.
BROADCAST_ROWS = 200_000

_shipped: set[str] = set()


def local_session(cores: int | str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.memory", conf.pop("driver_memory", "6g"))
    )
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once for each application, so Python tasks can import it anywhere."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root, packed = Path(__file__).resolve().parent, io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"vertexlake/{p.relative_to(root)}")
    ensure_checkpoint_dir(spark)  # the folder that all executors share
    target = sc._jvm.org.apache.hadoop.fs.Path(sc._jsc.sc().getCheckpointDir().get(), "vertexlake_src.zip")
    out = target.getFileSystem(sc._jsc.hadoopConfiguration()).create(target, True)
    out.write(bytearray(packed.getvalue()))
    out.close()
    sc.addPyFile(target.toString())
    _shipped.add(sc.applicationId)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder that the cluster names in spark.checkpoint.dir.

    A folder of this machine is set only where that setting is absent and Spark runs in one process, as in tests.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        sc.setCheckpointDir(named)
    elif sc.master.startswith("local["):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix=f"vertexlake-ckpt-{os.getpid()}-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")


def cut(df: DataFrame) -> DataFrame:
    """`df` computed and written to the checkpoint folder, so neither recomputed nor lost with an executor.

    A checkpoint keeps the planner's estimate of its size; in a loop that joins a table with itself the estimate is squared every
    round, until the planner spends its time on numbers of millions of digits. So the result starts without an estimate.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    done = df.checkpoint(eager=True)._jdf
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(done.queryExecution().toRdd(), done.schema(), False), spark)


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_ROWS, cheap: bool = False) -> tuple[DataFrame, bool]:
    """(`df` marked for broadcast, True) if it has at most `limit` rows, else (`df`, False).

    To count the rows, `df` is computed and written once; with `cheap` it is computed again where it is used.
    """
    df = df if cheap else cut(df)
    small = df.limit(limit + 1).count() <= limit
    return (F.broadcast(df), True) if small else (df, False)


def salted(rows: DataFrame, state: DataFrame, salts: int, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """Both sides of a join with a column `salt_`: rows get one of `salts` values from a hash of `by`, state every value."""
    rows = rows.withColumn("salt_", F.pmod(F.xxhash64(*by), F.lit(salts)).cast("int"))
    state = state.withColumn("salt_", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows, state


def attach(rows: DataFrame, state: DataFrame, on: list[str], salt_by: list[str], how: str = "inner", salts: int = 16, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Join `state`, one or few rows for each key, to `rows`, in which one key may hold a large part.

    A state of at most `limit` rows is broadcast. A larger one is repeated `salts` times and joined on the key and
    a salt, so a hot key is spread over `salts` tasks.
    """
    state, small = broadcast_if_small(state, limit, cheap=True)
    if small:
        return rows.join(state, on, how)
    rows, state = salted(rows, state, salts, salt_by)
    return rows.join(state, [*on, "salt_"], how).drop("salt_")
