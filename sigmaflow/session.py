"""Spark session and shared scratch storage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def get_spark(master: str | None = None, shuffle_partitions: int = 8, app: str = "sigmaflow") -> SparkSession:
    """Session tuned for the library: AQE on, UTC, Arrow for pandas UDFs."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    spark = (
        builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # runtime broadcast only below a measured size; sort-merge join beyond it
        .config("spark.sql.adaptive.autoBroadcastJoinThreshold", "32MB")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def _context(spark: SparkSession):
    """The SparkContext, or None for a remote (Spark Connect) session."""
    try:
        return spark.sparkContext
    except Exception:  # noqa: BLE001 - Connect sessions have no context
        return None


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder; create one only when unset on a single machine (tests).

    On a cluster a machine-local folder would lose files, so an unset folder is an error there.
    """
    sc = _context(spark)
    path = (sc.getCheckpointDir() if sc else None) or spark.conf.get("spark.checkpoint.dir", None)  # fixed at start; the context keeps ours
    if not path:
        master = sc.master if sc else "remote"
        if master != "local" and not master.startswith("local["):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
        path = tempfile.mkdtemp(prefix="sigmaflow-ckpt-")
    if sc is not None and not sc.getCheckpointDir():
        sc.setCheckpointDir(path)
    return (sc.getCheckpointDir() if sc else None) or path


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``sigmaflow`` importable in Python workers (pandas UDF kernels).

    The package is zipped once per SparkContext into the shared checkpoint
    folder and registered with ``addPyFile``, so executors on other hosts get it.
    """
    sc = _context(spark)
    key = sc.applicationId if sc is not None else str(id(spark))
    if key in _SHIPPED:
        return
    import io
    import zipfile

    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as zf:
        for root, _dirs, names in os.walk(pkg_dir):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(root, n)
                    zf.write(full, os.path.relpath(full, os.path.dirname(pkg_dir)))
    target = scratch_path(spark, "sigmaflow-pkg") + ".zip"
    if sc is not None:
        _write_bytes(spark, target, buf.getvalue())
        sc.addPyFile(target)
    else:  # Spark Connect: upload as a Python artifact
        local = target.split(":", 1)[1] if target.startswith("file:") else target
        os.makedirs(os.path.dirname(local), exist_ok=True)
        with open(local, "wb") as fh:
            fh.write(buf.getvalue())
        spark.addArtifacts(local, pyfile=True)
    _SHIPPED.add(key)


def _write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """Write a small file through the Hadoop FileSystem API (works for any shared scheme)."""
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(hpath, False)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique folder under the shared checkpoint dir (never reused).

    Grouped per application (``sigmaflow/<application id>/``) so that a finished
    run's intermediates can be removed in one step.
    """
    base = ensure_checkpoint_dir(spark)
    sc = _context(spark)
    app = sc.applicationId if sc is not None else "remote"
    return os.path.join(base, "sigmaflow", app, f"{name}-{uuid.uuid4().hex}")


def remove_intermediates(spark: SparkSession) -> None:
    """Delete what this application has stored in the shared folder; results not yet read are gone too."""
    sc = _context(spark)
    path = os.path.join(ensure_checkpoint_dir(spark), "sigmaflow", sc.applicationId if sc else "remote")
    hpath = sc._jvm.org.apache.hadoop.fs.Path(path)
    hpath.getFileSystem(sc._jsc.hadoopConfiguration()).delete(hpath, True)


def materialize(df, name: str):
    """Write an intermediate table to the shared checkpoint folder and read it back.

    Cuts the lineage (an executor loss re-reads the table instead of recomputing
    the whole upstream) and lets every branch of a plan scan it once, with
    column pruning and pushed filters. Never a machine-local folder.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("errorifexists").parquet(path)
    return spark.read.parquet(path)
