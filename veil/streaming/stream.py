"""Redacting documents as they arrive, and keeping the candidate table up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..functions.text import EMAIL, LINK, PHONE, masked
from ..operators.candidates import KEY, roll_up
from ..plans.redact import redact_all
from ..sources.lists import current, versions

#: Spark's state store that keeps keys on disk beside the executor, and in the checkpoint what has changed.
STATE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true"}


def mask_stream(spark: SparkSession, source: str, schema: StructType, sink: str, checkpoint: str, patterns: tuple[str, ...] = (EMAIL, PHONE, LINK)) -> StreamingQuery:
    """Mask what lies in a folder of Parquet files now and end; a further run takes up what has come since."""
    docs = spark.readStream.schema(schema).parquet(source)
    clean = docs.withColumn("text", masked(F.col("text"), patterns))
    return clean.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def redact_stream(docs: DataFrame, sink: str, checkpoint: str, names: str | None = None, exceptions: str | None = None, **options) -> StreamingQuery:
    """Redact a stream of documents by rules and lists into sink/batch=<number>.

    names, exceptions: folders of versioned lists (sources.lists.commit); each
    batch takes the versions that are whole when it begins, so a new one counts
    from the next batch. A batch that is run again writes its own folder anew.
    """

    def clean(batch: DataFrame, batch_id: int) -> None:
        listed = {k: current(batch.sparkSession, path, "value string") for k, path in (("names", names), ("exceptions", exceptions)) if path}
        redact_all(batch, **listed, **options).write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")

    return docs.writeStream.foreachBatch(clean).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def candidate_stream(finds: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Roll a stream of finds up by key. A batch writes the rows that it has changed to path/<batch>, and nothing else.

    The counts so far are in Spark's state store by key, so a batch's work goes
    with the batch, not with the table; a batch that is run again starts from the
    same state and writes the same rows. `candidates_now` is the table.
    """

    def changed(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/{batch_id}")

    conf = finds.sparkSession.conf
    before = {k: conf.get(k, None) for k in STATE}
    for k, v in STATE.items():
        conf.set(k, v)
    try:
        return roll_up(finds, None).writeStream.outputMode("update").foreachBatch(changed).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        for k, v in before.items():
            conf.unset(k) if v is None else conf.set(k, v)


def _newest(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Of each key the row of the batch that comes last; a folder's name is its batch."""
    rows = spark.read.parquet(*paths)
    number = F.element_at(F.split(F.input_file_name(), "/"), -2).cast("long")
    newest = rows.select(*KEY, F.struct(number.alias("_b"), *rows.columns).alias("_r")).groupBy(*KEY).agg(F.max_by("_r", F.col("_r._b")).alias("_r"))
    return newest.select(*[f"_r.{c}" for c in rows.columns])


def _folders(spark: SparkSession, path: str) -> list[str]:
    """The newest whole base and the batches behind it."""
    base = [n for n, whole in versions(spark, f"{path}/base") if whole][-1:]
    batches = [n for n, whole in versions(spark, path) if whole and (not base or n > base[0])]
    return [*[f"{path}/base/{n}" for n in base], *[f"{path}/{n}" for n in batches]]


def candidates_now(spark: SparkSession, path: str) -> DataFrame:
    """The candidate table: of each key the row of the last batch that changed it."""
    return _newest(spark, _folders(spark, path))


def compact(spark: SparkSession, path: str) -> None:
    """Put the rows of all batches so far into a new base, so that readers have fewer folders; it counts when it is whole, and nothing is taken away."""
    folders = _folders(spark, path)
    if len(folders) > 1:
        last = folders[-1].rsplit("/", 1)[1]
        _newest(spark, folders).write.mode("overwrite").parquet(f"{path}/base/{last}")
