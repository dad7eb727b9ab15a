"""From log files as they land to trips: new bytes are framed, decoded and built into the logbook, trigger by trigger.

Nothing is read twice: the ``ebl`` source keeps how far each boat's files are read, the state store the clock and
open messages, and the logbook the tail of every series. A stopped stream goes on where it was.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from fairlead.operators import decode as series
from fairlead.operators import frames as fr
from fairlead.plans.logbook import Logbook
from fairlead.sources import ebl_source
from fairlead.streaming.decode import stamped


def follow(spark: SparkSession, root: str, logbook: Logbook, **options: object) -> DataStreamWriter:
    """A writer (start it with a trigger) that keeps ``logbook`` up with the log files below ``root``. ``options``
    are those of the ``ebl`` source, such as boatBytesPerTrigger and progress."""
    ebl_source.register(spark)
    wanted = {"pgns": ",".join(map(str, fr.WANTED_PGNS))} | options
    messages = stamped(spark.readStream.format("ebl").options(**wanted).load(root))

    def write(batch: DataFrame, run: int) -> None:
        # Every series reads its own messages of the batch; two folders take turns.
        landing = f"{logbook.folder}/landing/{run % 2}"
        batch.withColumn("clock_epoch", F.lit(0)).write.mode("overwrite").partitionBy("pgn").parquet(landing)
        schema = batch.schema.fieldNames()
        rows = spark.read.schema(", ".join(f"{f.name} {f.dataType.simpleString()}" for f in batch.schema.fields) + ", clock_epoch int").parquet(landing)
        logbook.advance(run, series.decode_all(rows.select(*schema, "clock_epoch")))

    return messages.writeStream.foreachBatch(write).outputMode("append").option("checkpointLocation", f"{logbook.folder}/progress")
