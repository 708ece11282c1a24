"""Session helpers shared by every operator: table paths, staged tables, checkpoints."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "voxelgraph", cpus: str = "8", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A single-machine session for tests and the benchmark; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )


#: Tables that are read from fewer bytes than this for each partition are written by fewer tasks.
PART_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver tables; the path goes to Spark's reader unchanged, so any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; a temporary one where it is unset on a single machine."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local"):
            raise RuntimeError("a cluster needs spark.checkpoint.dir, a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-voxelgraph-"))
    return sc.getCheckpointDir()


def _tasks(plan) -> int:
    """Tasks for a logical plan: by the bytes of the tables it reads, as the optimiser knows them (huge where it doesn't),
    and no fewer than rows were dealt to on purpose, as those that are few but become many are."""
    children = plan.children()
    if children.isEmpty():
        return min(int(plan.stats().sizeInBytes()) // PART_BYTES, 2**31 - 1)
    below = sum(_tasks(children.apply(k)) for k in range(children.size()))
    return max(below, plan.numPartitions()) if plan.nodeName() == "RepartitionByExpression" and plan.optNumPartitions().isDefined() else below


def staged(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts the lineage (a lost executor never replays it), freezes non-deterministic columns and
    gives later joins real sizes, so that Spark picks broadcast or sort-merge from facts.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/staged-{uuid.uuid4().hex}"
    # small tables get few files; the number of tasks grows with what is read, so large ones keep their partitions
    tasks = _tasks(df._jdf.queryExecution().optimizedPlan())
    df.coalesce(min(max(2 * spark.sparkContext.defaultParallelism, tasks), 2**31 - 1)).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: After each row Spark adds up all buffers of the batch that it sends to Python, to keep this bound.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
#: The rows of a batch, and at most how many of texts: Spark, the worker and what is made of the texts hold a batch each.
BATCH_ROWS, TEXTS = "spark.sql.execution.arrow.maxRecordsPerBatch", 500


def ship(spark: SparkSession, numbers: bool = False) -> SparkSession:
    """Send this package to the executors once a session, for the operators that run Python there.

    numbers: all columns that cross are numbers, so a batch is bounded by its rows and needs no bound in bytes, whose
    watching takes most of a crossing's time. Operators on texts and arrays get the session's own bound back, and
    batches of few rows.
    """
    sc = spark.sparkContext
    own = getattr(sc, "_voxelgraph_batch", None)
    if own is None:
        own = sc._voxelgraph_batch = {c: spark.conf.get(c) for c in (BATCH_BYTES, BATCH_ROWS)}
    rows = int(own[BATCH_ROWS])
    spark.conf.set(BATCH_BYTES, str(2**31 - 1) if numbers else own[BATCH_BYTES])
    spark.conf.set(BATCH_ROWS, str(rows if numbers or 0 < rows < TEXTS else TEXTS))
    if not getattr(sc, "_voxelgraph_shipped", False):
        root = Path(__file__).resolve().parent
        path = Path(tempfile.mkdtemp(prefix="spark-voxelgraph-")) / "voxelgraph.zip"
        with zipfile.ZipFile(path, "w") as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f.relative_to(root.parent))
        sc.addPyFile(str(path))
        sc._voxelgraph_shipped = True
    return spark
