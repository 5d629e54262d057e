"""Session-level helpers shared by all operators."""

from __future__ import annotations

import tempfile
import time
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Only where the setting is unset and the master is local, as in tests, a folder of this machine is chosen.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if root:
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            sc.setCheckpointDir(root)
        return root.rstrip("/")
    now = sc._jsc.sc().getCheckpointDir()
    if now.isEmpty():
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="silvaspark-"))
        now = sc._jsc.sc().getCheckpointDir()
    return now.get().rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    This cuts lineage and survives the loss of executors; what was written is computed once.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows that are sent to all tasks where they are counted first.
SENT = 200_000


def sent_if_few(df: DataFrame, most: int = SENT) -> DataFrame:
    """``df`` for a join that sends it to all tasks if it has ``most`` rows at most, which are counted."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def joins_by_true_size(spark: SparkSession) -> None:
    """Let the session choose what joins send through the driver by the sizes that rows have when they are there (adaptive
    execution), not by those of compressed files, which tables of near or repeated numbers exceed many times. Its own limit stays."""
    limit, of_files = "spark.sql.adaptive.autoBroadcastJoinThreshold", "spark.sql.autoBroadcastJoinThreshold"
    if spark.conf.get(of_files, None) != "-1":
        if spark.conf.get(limit, None) is None:
            spark.conf.set(limit, spark.conf.get(of_files, "10MB"))
        spark.conf.set(of_files, "-1")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


class StageLog:
    """Rows and times of the stages of a run, taken in the passes that run anyway.

    ``written`` writes a stage and times it; the rows of a stage that is not written are counted by ``seen`` while a later
    one is. No stage is computed or counted for the log alone.
    """

    def __init__(self):
        self.stages: list[tuple[str, int | None, float | None]] = []
        self._open: list[tuple[int, Observation]] = []

    def seen(self, df: DataFrame, stage: str, only=None) -> DataFrame:
        """``df``, whose rows (or those that ``only`` holds for) are counted whenever it is first computed."""
        o = Observation()
        self._open.append((len(self.stages), o))
        self.stages.append((stage, None, None))
        return df.observe(o, (F.count(F.lit(1)) if only is None else F.count_if(only)).alias("points"))

    def _settle(self) -> None:
        for k, o in self._open:
            self.stages[k] = (self.stages[k][0], int(o.get["points"]), self.stages[k][2])
        self._open = []

    def written(self, df: DataFrame, name: str, stage: str) -> DataFrame:
        began = time.time()
        out = written(self.seen(df, stage), name)
        self._settle()
        k = len(self.stages) - 1
        self.stages[k] = (stage, self.stages[k][1], (time.time() - began) * 1000)
        return out

    def timed(self, stage: str, points: int | None, began: float) -> None:
        """A stage whose rows are known otherwise, which began at ``began`` (time.time())."""
        self.stages.append((stage, points, (time.time() - began) * 1000))

    def lines(self) -> list[str]:
        """Markdown rows that ``read_stage_table`` reads; a stage that has no time of its own has none here."""
        show = lambda x: "" if x is None else f"{x:.2f}" if isinstance(x, float) else str(x)
        return ["| stage | points | ms |", "|---|---|---|", *[f"| {n} | {show(c)} | {show(ms)} |" for n, c, ms in self.stages]]

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.stages, "stage string, points long, ms double")


def peak_memory_mb(spark: SparkSession) -> float | None:
    """The most execution memory that a task's operators held in any stage so far, from the status store; None if it keeps nothing."""
    sc = spark.sparkContext
    store, gateway = sc._jsc.sc().statusStore(), sc._gateway
    stages = store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), None)
    most = [stages.apply(k).peakExecutionMemory() for k in range(stages.size())]
    return max(most) / 2**20 if most else None
