"""Session helpers: a tuned local/cluster session and the shared work folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings a cluster deployment should keep: AQE re-plans shuffles at run time
# (coalescing small partitions, splitting skewed ones), broadcast joins are
# capped at a fixed size, and the UI server stays off.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def _default_driver_memory() -> str:
    """Local mode runs everything in the driver JVM: give it 60 % of the
    machine's memory, at most 16 GiB."""
    try:
        with open("/proc/meminfo") as fh:
            total_kb = next(int(ln.split()[1]) for ln in fh if ln.startswith("MemTotal:"))
        mb = min(16 * 1024, int(total_kb / 1024 * 0.6))
        return f"{max(mb, 1024)}m"
    except (OSError, StopIteration, ValueError):
        return "4g"


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "ragtally", extra: dict | None = None) -> SparkSession:
    """Create (or reuse) a session with the settings above."""
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    builder = SparkSession.builder.appName(app_name).master(master or f"local[{cpus}]")
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions or cpus)
    conf["spark.driver.memory"] = os.environ.get("RAGTALLY_DRIVER_MEMORY", _default_driver_memory())
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def work_dir(spark: SparkSession) -> str:
    """Shared folder for written tables and checkpoints.

    Uses ``spark.checkpoint.dir`` from the session (the cluster's shared
    folder).  Only a local-mode session without that setting (tests, the
    smoke check) gets a fresh temporary folder, which is then also set as the
    checkpoint folder.
    """
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not conf_dir:
        conf_dir = spark.sparkContext.getCheckpointDir()
    if not conf_dir:
        master = spark.sparkContext.master or ""
        if not master.startswith("local"):
            raise RuntimeError(
                "set spark.checkpoint.dir to a shared folder; a machine-local "
                "temporary folder is not visible to other executors")
        conf_dir = tempfile.mkdtemp(prefix="ragtally-")
        spark.conf.set("spark.checkpoint.dir", conf_dir)
        spark.sparkContext.setCheckpointDir(conf_dir)
    return conf_dir.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unique sub-folder of :func:`work_dir` for one job's output."""
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make `ragtally` importable in Python workers (as --py-files would):
    zip the package once per application and add it with addPyFile.  Needed
    by the operators that run NumPy code in Arrow batches."""
    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    import zipfile

    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    fd, zpath = tempfile.mkstemp(prefix="ragtally-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(zpath, "w", zipfile.ZIP_DEFLATED) as zf:
        for root, _dirs, files in os.walk(pkg_dir):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    zf.write(full, os.path.relpath(full, os.path.dirname(pkg_dir)))
    sc.addPyFile(zpath)
    _SHIPPED.add(app)


def table_exists(spark: SparkSession, path: str) -> bool:
    """True when a completely written table is at `path` (its _SUCCESS marker
    exists).  Listing only: no data is read."""
    from pyspark.errors import AnalysisException

    try:
        spark.read.format("binaryFile").load(path.rstrip("/") + "/_SUCCESS")
        return True
    except AnalysisException:
        return False
