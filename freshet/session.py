"""Session construction, reliable checkpoints and size-checked dictionary joins."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a dictionary is broadcast; beyond it the join is left to a shuffled plan with AQE skew handling.
BROADCAST_ROWS = 200_000
#: The same in bytes, for dictionaries of long texts.
BROADCAST_BYTES = 48_000_000


def build_session(app: str = "freshet", cores: int | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with UTC, AQE and Arrow on. ``cores`` only for local runs; a cluster sets its own master."""
    b = SparkSession.builder.appName(app)
    if cores:
        b = b.master(f"local[{cores}]").config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
    for k, v in {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # Written intermediate results go when the frames that read them are gone.
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        **conf,
    }.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return b.getOrCreate()


def reliable_checkpoint(df: DataFrame, keep_layout: bool = False) -> DataFrame:
    """``df`` written once to the shared checkpoint folder, lineage cut.

    With ``keep_layout`` the plan that reads it back still knows how the rows are partitioned, so that what groups by the same
    columns needs no further shuffle. An adaptive plan would forget it, so this one is planned without.
    The folder is the session's ``spark.checkpoint.dir``. Where that is unset a local master gets a folder of its own; on a
    cluster, where no machine's own folder would do, it is an error.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        where = spark.conf.get("spark.checkpoint.dir", None)
        if not where and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no shared folder for intermediate results")
        sc.setCheckpointDir(where or os.path.join(tempfile.gettempdir(), "freshet-checkpoints"))
    if not keep_layout:
        return df.checkpoint(eager=True)
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        return df.checkpoint(eager=True)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def join_dictionary(rows: DataFrame, dictionary: DataFrame, on: Column | list[str], how: str = "inner", max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Join ``rows`` with a computed dictionary whose size is known only at run time.

    The dictionary is materialised once (reliable checkpoint) and measured. Up to ``max_rows`` and ``max_bytes`` (texts
    at their length, other columns at 16 bytes) it is broadcast, so ``rows`` is not shuffled; above either a shuffled
    join runs, where AQE splits skewed keys.
    """
    dictionary = reliable_checkpoint(dictionary)
    texts = [f.name for f in dictionary.schema if f.dataType.typeName() == "string"]
    length = sum((F.coalesce(F.octet_length(c), F.lit(0)).cast("bigint") for c in texts), F.lit(16 * len(dictionary.columns)).cast("bigint"))
    n, size = dictionary.agg(F.count("*"), F.sum(length)).first()
    if n <= max_rows and (size or 0) <= max_bytes:
        dictionary = F.broadcast(dictionary)
    return rows.join(dictionary, on, how)
