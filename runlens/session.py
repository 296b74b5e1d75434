"""Session settings used by tests, the benchmark and small jobs.

On a cluster the session is built by the submitter; nothing below overrides a value
that is already set there except ``spark.sql.session.timeZone``, which the timestamp
semantics depend on.
"""

from __future__ import annotations

import hashlib
import io
import os
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

LOCAL_CHECKPOINTS = "/tmp/checkpoints/runlens"
_SHIPPED: set[tuple[str, str]] = set()


def build_session(app_name: str = "runlens", cpus: str | int = "*") -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("RUNLENS_DRIVER_MEMORY", "8g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", os.environ.get("RUNLENS_SHUFFLE_PARTITIONS", "8"))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Without one, only a master that runs everything in this process may fall back to a local folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        master = spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(
                f"master {master!r} has executors on other machines: set spark.checkpoint.dir to a folder all of them share"
            )
        configured = LOCAL_CHECKPOINTS
        spark.conf.set("spark.checkpoint.dir", configured)
    return configured.rstrip("/")


def new_table_path(spark: SparkSession) -> str:
    """A fresh path in the shared folder, in a folder of this application that goes when the JVM ends."""
    root = f"{checkpoint_dir(spark)}/runlens-{spark.conf.get('spark.app.id', 'app')}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(root)
    hadoop.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(hadoop)
    return f"{root}/{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` once as a table in the shared checkpoint folder and read it back.

    Executor loss cannot change the result any more, the plan starts from a scan (columns are
    pruned again), and the rows are computed once (an RDD checkpoint would compute them twice).
    """
    path = new_table_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship_package(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, once for each application.

    The archive goes to the shared folder, from which Spark itself distributes it.
    """
    app = spark.conf.get("spark.app.id", "app")
    here = os.path.dirname(os.path.abspath(__file__))
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        for folder, _, names in sorted(os.walk(here)):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.writestr(zipfile.ZipInfo(os.path.relpath(path, os.path.dirname(here))), open(path, "rb").read())
    data = buffer.getvalue()
    digest = hashlib.sha256(data).hexdigest()[:16]
    if (app, digest) in _SHIPPED:
        return
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{new_table_path(spark)}/runlens-{digest}.zip")
    fs = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    out = fs.create(path, True)
    out.write(data)
    out.close()
    spark.sparkContext.addPyFile(fs.makeQualified(path).toString())
    _SHIPPED.add((app, digest))
