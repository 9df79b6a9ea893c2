"""Session helpers.

The library never creates a global session: every public function takes
DataFrames (or a session) and returns DataFrames. These helpers exist for
tests, the bench and command-line use.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings that matter at any scale: adaptive execution re-plans joins from
# measured sizes (broadcast only when the measured side is small, sort-merge
# otherwise), splits skewed shuffle partitions and coalesces tiny ones.
SCALE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # one BLAS thread per Python worker: Spark already runs one worker per core
    "spark.executorEnv.OPENBLAS_NUM_THREADS": "1",
    "spark.executorEnv.OMP_NUM_THREADS": "1",
    "spark.executorEnv.MKL_NUM_THREADS": "1",
}


def local_session(cores: int | None = None, partitions: int | None = None,
                  app: str = "probelab") -> SparkSession:
    """Local session for tests and the bench (``local[cores]``)."""
    cores = cores or int(os.environ.get("BENCH_CPUS", "8"))
    b = (SparkSession.builder.master(f"local[{cores}]").appName(app)
         .config("spark.sql.shuffle.partitions", str(partitions or cores))
         .config("spark.default.parallelism", str(cores))
         .config("spark.driver.memory", "16g"))
    for k, v in SCALE_CONF.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint directory the cluster names.

    ``spark.checkpoint.dir`` is read from the session; where it is unset, a
    local session (tests) gets a fresh scratch folder, and a cluster, whose
    executors would not share it, an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="probelab-ckpt-", dir="/tmp")
    sc.setCheckpointDir(named)
    return sc.getCheckpointDir() or named


def cut_lineage(df):
    """Materialise ``df`` in the shared checkpoint folder (survives executor loss)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Tasks a core when rows are dealt for work that takes long for its bytes.
TASKS_PER_CORE = 2


def spread(df, *keys: str, least: int = 0):
    """Deal the rows by their keys over a fixed number of tasks a core, or
    ``least``. Adaptive execution joins partitions by their bytes, so a table
    of few bytes and much work a row would end in one task."""
    return df.repartition(max(least, TASKS_PER_CORE * df.sparkSession.sparkContext.defaultParallelism), *keys)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``probelab`` importable in Python workers (what ``--py-files``
    does at submit time). Idempotent per application."""
    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    import shutil
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    out = tempfile.mkdtemp(prefix="probelab-pyfiles-", dir="/tmp")
    archive = shutil.make_archive(os.path.join(out, "probelab"), "zip",
                                  root_dir=os.path.dirname(pkg_dir), base_dir="probelab")
    sc.addPyFile(archive)
    _SHIPPED.add(app)
