"""Cutting long lineages at a shared, durable place, and joins that depend on a measured size."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.functions.expressions import named


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    A temporary folder is used only where none is set and the session is local, as in tests: on a
    cluster other machines could not read it.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get(
        "spark.checkpoint.dir"
    )
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        folder = tempfile.mkdtemp(prefix="panelcast-")
    context.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Write the rows to the checkpoint folder and go on from there.

    For tables that several passes read: a panel before a fit, a training table, fitted models.
    A lost executor costs a read of the folder, not a recomputation.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """Write the rows as Parquet below the checkpoint folder and read them back.

    Like ``cut``, for wider tables: later reads prune columns and know the size.
    """
    folder = f"{ensure_checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def broadcast_limit(spark: SparkSession) -> int:
    """The session's broadcast threshold in bytes; 0 where broadcasting is switched off."""
    text = spark.conf.get("spark.sql.autoBroadcastJoinThreshold").strip().lower()
    units = {"k": 2**10, "m": 2**20, "g": 2**30, "t": 2**40}
    digits = text.rstrip("bkmgt")
    unit = text[len(digits) :].rstrip("b")
    return max(int(digits) * units.get(unit, 1), 0)


def attach_facts(
    df: DataFrame,
    facts: DataFrame,
    keys: Sequence[str],
    how: str = "left",
    stored: bool = False,
    salts: int | None = None,
) -> DataFrame:
    """Join a table of one or few rows per group to the data rows; they stay put if it is small.

    The optimizer cannot know how few groups an aggregation leaves, and would shuffle all data
    rows to meet them, a crowded group into one task. So the facts are written once and their size
    is measured. Within the session's broadcast threshold they are broadcast. Beyond it they are
    repeated per salt and the join is by key and salt: a group is spread over tasks, a later
    aggregation by key still reduces rows before its shuffle, and adaptive execution may split
    what is left of a crowded group. The number of salts follows
    ``spark.sql.shuffle.partitions`` unless given. ``stored`` says that the facts are written already.
    """
    if salts is None:
        parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        salts = max(8, parts // 8)
    if not stored:
        facts = cut(facts)
    size = facts.agg(F.sum(F.length(F.to_json(F.struct("*"))))).first()[0] or 0
    if size <= broadcast_limit(df.sparkSession):
        return df.join(F.broadcast(facts), list(keys), how)
    salt = F.pmod(F.xxhash64(*[named(c) for c in df.columns]), F.lit(salts)).cast("int")
    repeated = facts.withColumn("__salt", F.explode(F.array(*[F.lit(i) for i in range(salts)])))
    joined = df.withColumn("__salt", salt).join(repeated, [*keys, "__salt"], how)
    return joined.drop("__salt")
