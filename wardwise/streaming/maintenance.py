"""Table maintenance for files that keep arriving: each micro-batch is an upsert of a versioned table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardwise.operators.store import Store
from wardwise.operators.tables import Versions, upsert


def keep_upserted(stream: DataFrame, path: str, keys: Sequence[str], order: str, checkpoint: str):
    """A started query that upserts every batch; of a key's rows in a batch the last by ``order`` counts.

    A batch that is given again after a failure leaves the same rows.
    """

    def batch(df: DataFrame, _: int) -> None:
        table = Versions(df.sparkSession, path)
        last = df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))).where("_r = 1").drop("_r")
        table.write(last if table.current() is None else upsert(table.read(), last, keys))

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def keep_in_store(stream: DataFrame, store: Store, table: str, keys: Sequence[str], order: str, source: str, checkpoint: str):
    """A started query that upserts every batch into a table of a store; each batch is a run of the ledger and writes only
    the buckets of its keys.

    A batch that is given again after it has succeeded is left out, so a restart changes nothing.
    """

    def batch(df: DataFrame, number: int) -> None:
        name = f"{source}-{number}"
        if any(r["run"] == name for r in store.manifest()["runs"]) or df.isEmpty():
            return
        last = df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))).where("_r = 1").drop("_r")
        with store.run(source, str(number), name=name) as changes:
            changes.upsert(table, last, keys)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
