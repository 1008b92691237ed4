"""Best-so-far model selection: as a batch query over a log and as a stream."""

from __future__ import annotations

import gc
import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stackpool import schemas
from stackpool.operators.metrics import curve_metrics
from stackpool.operators.order import curve_of_counts, running_before, score_counts
from stackpool.session import remove, small_files_session
from stackpool.sources.tables import exists

# Fixed value: a score must beat the best one before it by this factor.
MARGIN = 1.001


def improvements(log: DataFrame, model: str = "model", seq: str = "seq", score: str = "score") -> DataFrame:
    """Flag entries that beat every earlier entry of their model by the margin.

    ``best_before`` is 0 for the first entry; an entry without score repeats
    the best and so never improves.
    """
    out = running_before(log, [model], [seq], {"_best": F.max(score)}, {"_best": "max"})
    best = F.coalesce("_best", F.lit(0.0))
    return (out.withColumn("best_before", best)
            .withColumn("improved", F.coalesce(F.col(score), best) > best * MARGIN).drop("_best"))


def best_score(log: DataFrame, model: str = "model", score: str = "score") -> DataFrame:
    return log.groupBy(model).agg(F.max(score).alias("best"))


def latest(files: DataFrame, keys: list[str], path: str, time: str) -> DataFrame:
    """Newest entry per key; the greater path wins when times are equal."""
    return files.groupBy(*keys).agg(F.max_by(F.col(path), F.struct(time, path)).alias(path))


def score_stream(spark: SparkSession, folder: str, max_files: int | None = None, fmt: str = "parquet") -> DataFrame:
    """Score log entries as they arrive; new files are found by the file source."""
    reader = spark.readStream.schema(schemas.SCORE_LOG).format(fmt)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(folder)


#: Paths of checkpoint index files, and the names that can be among them.
INDEX, INDEX_GLOB = r".*\.ckpt-[0-9]*\.index$", "*.ckpt-*.index"


def checkpoint_stream(spark: SparkSession, folder: str, pattern: str = INDEX, max_files: int | None = None) -> DataFrame:
    """Checkpoint index files as they appear, with name and modification time; contents are not kept."""
    reader = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    if pattern == INDEX:
        # other files are listed, but neither remembered nor looked at
        reader = reader.option("pathGlobFilter", INDEX_GLOB)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return (reader.load(folder).filter(F.col("path").rlike(pattern))
            .select(F.substring_index("path", "/", -1).alias("name"), "modificationTime", "length"))


def run_checkpoints(spark: SparkSession, folders: list[str], seen: str, state: str, max_files: int = 1 << 15, together: int = 4) -> None:
    """Append the checkpoint index files that are new in ``folders`` to ``seen``: name, modificationTime, length.

    The file source keeps the listing of its folder and the names it has handed out
    with the driver.  So each folder (a model's own, say) is a stream with a state of
    its own, and the driver holds the ``together`` folders that are followed at a time.
    A later call handles what has come since.
    """
    tasks = spark.sparkContext.defaultParallelism
    # a source lists its batches in the session it was made in
    own = small_files_session(spark)

    def start(folder: str):
        mine = f"folder=f{hashlib.md5(folder.encode()).hexdigest()}"

        def store(batch: DataFrame, batch_id: int) -> None:
            # a repeated batch overwrites its own folder
            batch.coalesce(tasks).write.mode("overwrite").parquet(f"{seen}/{mine}/batch={batch_id}")
        writer = checkpoint_stream(own, folder, max_files=max_files).writeStream.option("checkpointLocation", f"{state}/{mine}").foreachBatch(store)
        return writer.trigger(availableNow=True).start()

    running = []
    try:
        for k, folder in enumerate(folders):
            if len(running) >= together:
                running.pop(0).awaitTermination()
            if k % together == 0:
                gc.collect()  # ended streams are in cycles; until Python drops them, the JVM keeps their listings
            running.append(start(folder))
        while running:
            running.pop(0).awaitTermination()
    finally:
        for job in running:
            job.stop()


def advanced(batch: DataFrame, known: DataFrame | None) -> DataFrame:
    """:func:`improvements` of a micro-batch that goes on from the best score of each model before it (model, best).

    Entries of one model are spread over chunks of fixed size, whatever its share of
    the batch; what the state gets from a batch is one maximum per model.
    """
    out = running_before(batch, ["model"], ["seq"], {"_best": F.max("score")}, {"_best": "max"})
    if known is not None:
        out = out.join(known.withColumnRenamed("best", "_known"), "model", "left")
    else:
        out = out.withColumn("_known", F.lit(None).cast("double"))
    # greatest skips nulls; the best before any entry is 0
    best = F.greatest(F.lit(0.0), "_best", "_known")
    return out.select(*batch.columns, best.alias("best_before"), (F.coalesce("score", best) > best * MARGIN).alias("improved"))


def _version(spark: SparkSession, folder: str, batch_id: int) -> DataFrame | None:
    """State that the micro-batch before ``batch_id`` left."""
    path = f"{folder}/v={batch_id - 1}"
    return spark.read.parquet(path) if batch_id > 0 and exists(spark, path) else None


def _leave(state: DataFrame, folder: str, batch_id: int) -> DataFrame:
    """Write the state of ``batch_id``.  A repeated batch writes its own version over; only the one before is still needed."""
    path = f"{folder}/v={batch_id}"
    state.write.mode("overwrite").parquet(path)
    remove(state.sparkSession, f"{folder}/v={batch_id - 2}")
    return state.sparkSession.read.parquet(path)


def _start(stream: DataFrame, checkpoint: str, poll: str | None, store: Callable[[DataFrame, int], None]):
    def persisted(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            store(batch, batch_id)
        finally:
            batch.unpersist()
    writer = stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(persisted)
    return (writer.trigger(processingTime=poll) if poll else writer.trigger(availableNow=True)).start()


def run_selection(spark: SparkSession, source: str, log: str, checkpoint: str, best: str | None = None,
                  max_files: int | None = None, poll: str | None = None,
                  evaluate: Callable[[DataFrame, int], None] | None = None):
    """Start the job: append every entry to ``log`` and keep the best entry per model in ``best``.

    Without ``poll`` the job handles what is there and stops; ``poll`` (such as
    '60 seconds') keeps it running.  ``evaluate`` is called for each micro-batch.
    The best score per model stands beside the stream's checkpoint, a version per
    micro-batch, so a repeated batch starts from where it did before.
    """
    state = f"{checkpoint.rstrip('/')}-best"

    def store(batch: DataFrame, batch_id: int) -> None:
        known = _version(spark, state, batch_id)
        # a repeated batch overwrites its own folder, so the log holds each entry once
        advanced(batch, known).write.mode("overwrite").parquet(f"{log}/batch={batch_id}")
        flagged = spark.read.parquet(f"{log}/batch={batch_id}")
        now = flagged.groupBy("model").agg(F.max("score").alias("best"))
        if known is not None:
            now = now.unionByName(known).groupBy("model").agg(F.max("best").alias("best"))
        _leave(now, state, batch_id)
        if evaluate:
            evaluate(flagged, batch_id)
        if best:
            found = flagged.filter("improved").drop("improved")
            if (before := _version(spark, best, batch_id)) is not None:
                found = found.unionByName(before)
            newest = found.groupBy("model").agg(F.max_by(F.struct(*found.columns), F.col("seq")).alias("b"))
            _leave(newest.select("b.*"), best, batch_id)

    return _start(score_stream(spark, source, max_files), checkpoint, poll, store)


# --- metrics of all predictions so far -----------------------------------------------

def prediction_counts(rows: DataFrame, n_classes: int) -> tuple[DataFrame, DataFrame]:
    """What all metrics of (model, truth, prediction, probabilities) rows follow from, as counts that add up.

    (model, class, score, pos, neg) for the rankings of every class against the rest,
    and (model, truth, prediction, n).
    """
    scores = rows.select("model", F.col("truth").alias("_t"), F.posexplode(F.slice("probabilities", 1, n_classes)).alias("class", "p"))
    scores = scores.select("model", "class", "p", (F.col("_t") == F.col("class")).cast("int").alias("y"))
    return score_counts(scores, "p", "y", ["model", "class"]), rows.groupBy("model", "truth", "prediction").agg(F.count(F.lit(1)).alias("n"))


def metrics_of_counts(scores: DataFrame, confusion: DataFrame) -> DataFrame:
    """Per model: rows so far, acc, auc and average precision (map) of classes 1 and 2, and the mean of the two areas."""
    ranked = curve_metrics(curve_of_counts(scores.filter("class in (1, 2)"), ["model", "class"]), ["model", "class"])
    pick = lambda c, value: F.max(F.when(F.col("class") == c, F.col(value)))
    wide = ranked.groupBy("model").agg(pick(1, "auc").alias("auc1"), pick(2, "auc").alias("auc2"), pick(1, "ap").alias("map1"), pick(2, "ap").alias("map2"))
    right = F.sum(F.when(F.col("truth") == F.col("prediction"), F.col("n")).otherwise(0))
    acc = confusion.groupBy("model").agg(F.sum("n").alias("n"), (right / F.sum("n")).alias("acc"))
    return acc.join(wide, "model").withColumn("isbi", (F.col("auc1") + F.col("auc2")) / 2)


def run_evaluation(spark: SparkSession, stream: DataFrame, folder: str, checkpoint: str, n_classes: int = 3, poll: str | None = None):
    """Start the job: after each micro-batch of predictions, the exact metrics of all predictions so far of its models.

    ``stream`` has model, truth, prediction and probabilities.  Earlier predictions are
    not read again: ``folder/scores`` and ``folder/confusion`` keep their counts, one
    row per model, class and distinct score, a version per micro-batch.  The metrics
    of batch i are ``folder/metrics/batch=i``.
    """
    def merged(new: DataFrame, name: str, batch_id: int) -> DataFrame:
        before = _version(spark, f"{folder}/{name}", batch_id)
        values = [c for c in new.columns if c in ("pos", "neg", "n")]
        keys = [c for c in new.columns if c not in values]
        both = new if before is None else new.unionByName(before).groupBy(*keys).agg(*[F.sum(v).alias(v) for v in values])
        return _leave(both, f"{folder}/{name}", batch_id)

    def store(batch: DataFrame, batch_id: int) -> None:
        scores, confusion = (merged(c, name, batch_id) for c, name in zip(prediction_counts(batch, n_classes), ("scores", "confusion")))
        touched = batch.select("model").distinct()
        found = metrics_of_counts(*(t.join(touched, "model", "left_semi") for t in (scores, confusion)))
        found.write.mode("overwrite").parquet(f"{folder}/metrics/batch={batch_id}")

    return _start(stream, checkpoint, poll, store)
