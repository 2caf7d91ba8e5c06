"""Structured Streaming operators.

The monitor is the batch jobs run per micro-batch:

* source: raw messages arriving as parquet files (``maxFilesPerTrigger``
  bounds each batch without dropping the rest -- T04);
* dedup (T02) has two layers.  The state store (RocksDB) holds the hashes that
  arrived within the last ``horizon`` and drops their copies
  (``dropDuplicatesWithinWatermark``).  Its clock is the arrival, the instant of the
  micro-batch that a replay repeats, so no mail is too late for it, whatever its own
  date.  What passes may still be a copy of something older: its hashes are looked up
  in the log, only in their buckets, and only in the parts that the state no longer
  covers or that other runs wrote;
* own alerts are taken out before anything is scored or logged (T03);
* ``foreachBatch``: dimension tables are re-read every batch (T08), raw
  messages are parsed with rejects kept aside (T05), features, scores and
  explanations are computed by the batch operators, and the outputs are
  written under ``batch_id=<n>`` with overwrite, so a replayed batch replaces
  its own output (idempotent sink);
* each batch writes one metrics row from counters that its own jobs observe on the
  way; a listener adds what the source counted (T06).

Event-time rates (T07) are watermarked tumbling / sliding window counts.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from lurescope import dictionaries as D
from lurescope.operators import explain as EX
from lurescope.operators.detections import DetectionLog
from lurescope.operators.domains import collect_domains
from lurescope.operators.features import features_all
from lurescope.operators.scoring import blend
from lurescope.operators.verdicts import domain_verdicts
from lurescope.operators.versioned import HashLog
from lurescope.session import delete_path, path_exists, release_shuffles_of, releasing_shuffles, setting
from lurescope.sources import mail as MAIL

RAW_SCHEMA = "msg_id bigint, received_ts timestamp, raw binary"
#: Of the tables that hold texts: raw source and the stages of a running batch.
TEXT_CODEC = "zstd"


def fixed_scores(features: DataFrame) -> DataFrame:
    """Deterministic stand-in scores derived from the message id (tests and
    the batch/stream equality check); a model scorer has the same shape."""
    k = F.col("msg_id")
    s = features.select(
        "*",
        (((k * 37) % 101).cast("double") / F.lit(100.0)).alias("p_text"),
        (((k * 53 + 7) % 101).cast("double") / F.lit(100.0)).alias("p_full"),
        (((k * 17 + 3) % 101).cast("double") / F.lit(100.0)).alias("p_struct"))
    return s.withColumn("final_prob", blend("p_full", "p_struct", "p_text"))


def model_scorer(models: dict, text_model):
    """Scorer with trained models: text score, both boosted-tree models, blend."""
    from lurescope.operators.models import prompt_text, score_table, text_score

    def score(features: DataFrame) -> DataFrame:
        with_text = text_score(text_model, features.withColumn("text", prompt_text()))
        return score_table(with_text.drop("text"), models)
    return score


def _batch_path(base: str, batch_id: int) -> str:
    return f"{base}/batch_id={batch_id}"


# ----------------------------------------------------------------- T02 the recent window

#: Name under which the source's rows are observed.
SOURCE = "source"
#: Column with the instant of a row's micro-batch.
ARRIVED = "_arrived"
HORIZON = "1 day"
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def first_arrivals(stream: DataFrame, key: str, horizon: str = HORIZON) -> DataFrame:
    """Rows of the stream whose key did not arrive within ``horizon`` before, with the
    instant of their arrival.  State: one entry per key for about twice the horizon.
    Of copies within one micro-batch any one stays."""
    # both are read when the query starts; a cycle without mail has nothing to do
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    stream.sparkSession.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    return (stream.withColumn(ARRIVED, F.current_timestamp()).withWatermark(ARRIVED, horizon)
            .dropDuplicatesWithinWatermark([key]))


def run_of(spark: SparkSession, checkpoint: str) -> str:
    """The id of the run that a checkpoint belongs to, made with it: state that is lost
    takes its run along, so that nothing relies on it any more."""
    path = f"{checkpoint.rstrip('/')}/run"
    if not path_exists(spark, f"{path}/_SUCCESS"):
        spark.range(1).select(F.expr("uuid()").alias("run")).write.mode("overwrite").parquet(path)
    return spark.read.schema("run string").parquet(path).first()["run"]


def covered_since(batch: DataFrame, horizon: str) -> tuple[int, int] | None:
    """(arrival of the batch, instant since which the state store covers all keys that
    arrived) in microseconds; None for an empty batch.  A key leaves the state when the
    watermark, at most the last arrival less ``horizon``, passes its own expiry."""
    at = F.max(ARRIVED)
    row = batch.agg(F.unix_micros(at).alias("at"), F.unix_micros(
        at - F.expr(f"interval {horizon}")).alias("since")).first()
    return None if row["at"] is None else (row["at"], row["since"])


class CycleListener(StreamingQueryListener):
    """Hands each finished cycle's number and the rows that its source observed to
    ``done``; only cycles of the query called ``name``."""

    def __init__(self, name: str, done, spark: SparkSession):
        self.name, self.done, self.spark, self.query = name, done, spark, None

    def onQueryStarted(self, event):
        if event.name == self.name:
            self.query = event.id

    def onQueryProgress(self, event):
        progress = event.progress
        if progress.name == self.name and SOURCE in progress.observedMetrics:
            self.done(progress.batchId, progress.observedMetrics[SOURCE]["arrived"])

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        if event.id == self.query:  # all its progress came before
            self.spark.streams.removeListener(self)


class Monitor:
    """Parse -> features -> score -> log -> alert, once per micro-batch."""

    def __init__(self, spark: SparkSession, out_dir: str, dims, trusted, *, scorer,
                 dicts: D.Dictionaries, as_of=None, threshold: float = D.DEFAULT_THRESHOLD, alert_address: str | None = None,
                 urls: DataFrame | None = None, attachments: DataFrame | None = None,
                 horizon: str = HORIZON):
        """``dims()`` returns fresh (rank, threat, facts_history, cert_facts)
        DataFrames -- it is called every batch.  ``as_of`` is the instant of
        the verdicts: None for the time at which a batch starts, or a function
        of the batch id (replays).  ``scorer`` adds the score columns, such as
        :func:`model_scorer`.  Without ``urls`` the stream
        carries raw messages (parsed per batch); with ``urls`` /
        ``attachments`` it carries message rows and those two are static
        tables joined to each batch (stream-static join).  ``horizon`` is how long the
        state store remembers a hash."""
        self.static_urls, self.static_atts = urls, attachments
        self.spark, self.out = spark, out_dir.rstrip("/")
        self.dims, self.trusted, self.scorer = dims, trusted, scorer
        self.dicts, self.as_of, self.threshold, self.alert_address = dicts, as_of, threshold, alert_address
        self.log = DetectionLog(spark, self.log_path, order=("received_ts", "batch_id"))
        self.horizon, self.run, self.cycles = horizon, "", {}

    # paths of the outputs
    @property
    def log_path(self):
        return f"{self.out}/log"

    @property
    def alerts_path(self):
        return f"{self.out}/alerts"

    @property
    def metrics_path(self):
        return f"{self.out}/metrics"

    @property
    def rejects_path(self):
        return f"{self.out}/rejects"

    def _stage(self, df: DataFrame, name: str, batch_id: int) -> DataFrame:
        """Write a per-batch table (overwrite: a replayed batch rewrites it)
        and read it back -- every later plan starts from a small scan."""
        path = self._stage_path(name, batch_id)
        with releasing_shuffles(df.sparkSession):
            df.write.mode("overwrite").option("compression", TEXT_CODEC).parquet(path)
        return self.spark.read.parquet(path)

    def _stage_path(self, name: str, batch_id: int) -> str:
        return _batch_path(f"{self.out}/stage/{name}", batch_id)

    def _drop(self, name: str, batch_id: int) -> None:
        """Delete a staged table that nothing reads any more."""
        delete_path(self.spark, self._stage_path(name, batch_id))

    def _messages(self, fresh: DataFrame, batch_id: int):
        """(messages, urls, attachments, rejects) of a batch, staged."""
        if self.static_urls is not None:
            msgs = self._stage(fresh, "messages", batch_id)
            keys = msgs.select("msg_id")
            urls = self.static_urls.join(keys, "msg_id", "left_semi")
            atts = (self.static_atts.join(keys, "msg_id", "left_semi") if self.static_atts is not None
                    else self.spark.createDataFrame([], "msg_id bigint, filename string"))
            return (msgs, self._stage(urls, "urls", batch_id), self._stage(atts, "attachments", batch_id),
                    None)
        # The parser runs once per batch; its output, the batch's only table of texts, is
        # staged.  What came with the raw message stays beside it: no text is joined.
        meta = ("msg_id", "received_ts", "_hash")
        parsed = self._stage(MAIL.parse_messages(fresh.select(
            F.col("msg_id").cast("string").alias("msg_key"), "raw", "msg_id", "received_ts",
            F.col("email_hash").alias("_hash")), meta), "messages", batch_id)
        msgs, urls, atts, rejects = MAIL.ingest(parsed, meta)
        msgs, urls, atts = (x.filter(F.col("msg_id").isNotNull()) for x in (msgs, urls, atts))
        return (msgs.drop("email_hash").withColumnRenamed("_hash", "email_hash"),
                self._stage(urls.select("msg_id", "pos", "url"), "urls", batch_id),
                self._stage(atts.select("msg_id", "filename"), "attachments", batch_id), rejects)

    def _fresh(self, batch: DataFrame, batch_id: int) -> DataFrame:
        """The first arrivals of the batch without hashes of older parts of the log."""
        covered = covered_since(batch, self.horizon)
        self._arrival = covered and covered[0]
        if covered is None:
            return batch.drop(ARRIVED)
        return self.log.unseen(batch.drop(ARRIVED), self.run, covered[1], but=self._part(batch_id))

    def _part(self, batch_id: int) -> str:
        return f"{self.run}-{batch_id}"

    def _own_alert(self) -> Column:
        if not self.alert_address:
            return F.lit(False)
        return F.lower(F.coalesce("from_addr", F.lit(""))).contains(self.alert_address.lower())

    def process_batch(self, batch: DataFrame, batch_id: int) -> None:
        # The stream's state is asked once: what arrived is written, not held uncompressed,
        # and the mail that was shuffled by hash for it goes; the engine would keep it.
        # The texts of a batch go when its outputs are written; a replay makes them anew.
        arrived = self._stage(batch, "arrived", batch_id)
        release_shuffles_of(batch)
        self._process(arrived, batch_id)
        self._drop("messages", batch_id)

    def _counters(self, tables: dict[str, DataFrame]) -> dict:
        """Rows of each written table of a cycle, and positives of the log, in one job over
        the tables' footers and one column."""
        none = F.lit(None).cast("bigint")
        rows = None
        for name, df in tables.items():
            positive = F.count_if("is_phishing") if name == "scored" else none
            row = df.agg(F.count(F.lit(1)).alias("n"), positive.alias("positive")).withColumn("name", F.lit(name))
            rows = row if rows is None else rows.unionByName(row)
        got = {r["name"]: r for r in rows.collect()}
        return {name: r["n"] for name, r in got.items()} | {"positive": got["scored"]["positive"]}

    def _process(self, batch: DataFrame, batch_id: int) -> None:
        spark = self.spark
        instant = self.as_of(batch_id) if callable(self.as_of) else \
            spark.range(1).select(F.current_timestamp().cast("string")).first()[0] \
            if self.as_of is None else self.as_of
        every, urls, atts, rejects = self._messages(self._fresh(batch, batch_id), batch_id)
        self._drop("arrived", batch_id)
        msgs = every.filter(~self._own_alert())
        keys = msgs.select("msg_id")
        urls, atts = (x.join(keys, "msg_id", "left_semi") for x in (urls, atts))

        rank, threat, facts, cert = self.dims()          # T08: re-read every batch
        verdicts = domain_verdicts(collect_domains(msgs, urls, self.dicts.public_suffixes),
                                   rank, threat, facts, instant, self.dicts)
        # The batch's verdict table is written (per batch id) and re-read:
        # it cuts the lineage and keeps the feature plan small.
        verdicts = self._stage(verdicts, "verdicts", batch_id)
        feats = features_all(msgs, urls, atts, verdicts, self.trusted(rank), cert, self.dicts,
                             keep=("email_hash", "received_ts", "from_addr", "subject"))
        # models score a plain table; the scored table is what is logged.  The text meets the
        # features for a scorer that reads it, and is not written again.
        feats = self._stage(feats, "features", batch_id)
        texts = msgs.select("msg_id", "plain_text")
        scored = self._stage(self.scorer(feats.join(texts, "msg_id")).drop("plain_text"), "scored", batch_id)
        results = EX.detection_results(scored, threshold=self.threshold)
        results = results.join(msgs.select("msg_id", "email_hash", "received_ts"), "msg_id") \
            .withColumn("batch_id", F.lit(batch_id))
        self.log.append(results, self._part(batch_id), self.run, self._arrival)
        logged = self.log.part(self._part(batch_id))
        EX.alerts(logged).write.mode("overwrite").parquet(_batch_path(self.alerts_path, batch_id))
        counted = {"taken": every, "scored": logged, "threat_rows": threat}
        if rejects is not None:
            rejects.write.mode("overwrite").parquet(_batch_path(self.rejects_path, batch_id))
            counted["rejected"] = spark.read.schema(rejects.schema).parquet(_batch_path(self.rejects_path, batch_id))
        self.cycles[batch_id] = {"rejected": 0} | self._counters(counted)

    def _write_metrics(self, batch_id: int, arrived: int) -> None:
        """The metrics row of a cycle, from what the source observed and the cycle counted."""
        c = self.cycles.get(batch_id)
        if c is None:
            return
        row = (arrived, c["scored"], c["positive"], c["taken"] - c["scored"],
               arrived - c["taken"] - c["rejected"], c["rejected"], c["threat_rows"])
        self.spark.createDataFrame([row], "arrived bigint, scored bigint, positive bigint, skipped bigint, "
                                          "duplicates bigint, rejected bigint, threat_rows bigint") \
            .coalesce(1).write.mode("overwrite").parquet(_batch_path(self.metrics_path, batch_id))
        self.cycles.pop(batch_id)

    def start(self, source_dir: str, checkpoint: str, max_files: int = 10,
              available_now: bool = True, interval: str = "60 seconds", schema: str = RAW_SCHEMA):
        src = (self.spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files)
               .parquet(source_dir))
        if "email_hash" not in [f.split(" ")[0] for f in schema.split(", ")]:
            src = src.withColumn("email_hash", F.sha2("raw", 256))
        self.run = run_of(self.spark, checkpoint)
        name = f"monitor-{uuid.uuid4().hex}"
        self.spark.streams.addListener(CycleListener(name, self._write_metrics, self.spark))
        src = first_arrivals(src.observe(SOURCE, F.count(F.lit(1)).alias("arrived")), "email_hash", self.horizon)
        w = (src.writeStream.queryName(name).foreachBatch(self.process_batch)
             .option("checkpointLocation", checkpoint))
        w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=interval)
        return w.start()

    def stop(self) -> None:
        """Wait until the metrics rows of all finished cycles are written."""
        for _ in range(300):
            if not self.cycles:
                return
            time.sleep(0.1)

    # readers of the outputs
    def latest_log(self) -> DataFrame:
        return self.log.latest().select("email_hash", "received_ts", "batch_id", "msg_id", "is_phishing",
                                        "confidence", "risk_score", "risk_level")

    def alerts(self) -> DataFrame:
        return self.spark.read.parquet(self.alerts_path)

    def metrics(self) -> DataFrame:
        self.stop()
        return self.spark.read.parquet(self.metrics_path)


def write_raw_source(raw: DataFrame, path: str, files: int = 12) -> None:
    """Lay out raw messages as parquet files for the file stream source,
    ordered by arrival time across files.

    The files' bounds come from arrival times and ids alone.  Rendered messages are written
    once, by the file that they belong to, and each file then takes its own: no raw message
    is shuffled, and when the files are written the shuffles that made them are gone."""
    spark, drafts = raw.sparkSession, f"{path.rstrip('/')}-drafts"
    least = F.lit(-(1 << 63))
    rows = raw.select("msg_id", F.col("received_ts").cast("timestamp").alias("received_ts"),
                      F.encode("raw", "UTF-8").alias("raw"))
    at, key = F.coalesce(F.unix_micros("received_ts"), least), F.coalesce(F.col("msg_id").cast("bigint"), least)
    bounds = (rows.select(at.alias("at"), key.alias("key")).repartitionByRange(files, "at", "key")
              .select(F.spark_partition_id().alias("file"), F.struct("at", "key").alias("last"))
              .groupBy("file").agg(F.max("last").alias("last")).orderBy("file").collect())
    number = F.lit(0)
    for last in [b["last"] for b in bounds[:-1]]:
        number = number + ((at > last["at"]) | ((at == last["at"]) & (key > last["key"]))).cast("int")
    with releasing_shuffles(spark):
        rows.withColumn("file", number).write.mode("overwrite").option("compression", TEXT_CODEC) \
            .partitionBy("file").parquet(drafts)
    drawn = spark.read.schema(RAW_SCHEMA + ", file int").parquet(drafts)
    out = None
    for k in range(max(len(bounds), 1)):
        one = drawn.filter(F.col("file") == k).drop("file").coalesce(1)
        out = one if out is None else out.union(one)
    with setting(spark, "spark.sql.unionOutputPartitioning", "false"):  # a union of single partitions is not one
        out.write.mode("overwrite").option("compression", TEXT_CODEC).parquet(path)
    delete_path(spark, drafts)


# ----------------------------------------------------------------- T02 stream dedup

def stream_dedup(spark: SparkSession, source_dir: str, schema: str, key: str, out_dir: str,
                 checkpoint: str, max_files: int = 10, horizon: str = HORIZON) -> DataFrame:
    """One row per key, however late its copies come: equal, by key, to
    ``dropDuplicates([key])`` of the whole stream.  The state store answers for the last
    ``horizon``, the output itself, a ``HashLog``, for all before and for other runs; a
    replayed batch rewrites its own part."""
    log = HashLog(spark, out_dir, key)
    run = run_of(spark, checkpoint)

    def sink(df: DataFrame, batch_id: int) -> None:
        df = df.persist()
        try:
            covered = covered_since(df, horizon)
            if covered is not None:
                part = f"{run}-{batch_id}"
                log.append(log.unseen(df.drop(ARRIVED), run, covered[1], but=part), part, run, covered[0])
        finally:
            df.unpersist()

    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(source_dir)
    q = (first_arrivals(src, key, horizon).writeStream.foreachBatch(sink)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    found = log.versions()
    return spark.createDataFrame([], schema) if found is None else found


# ----------------------------------------------------------------- T07 event-time rates

def event_rates(spark: SparkSession, source_dir: str, schema: str, out_dir: str, checkpoint: str,
                window: str = "1 hour", slide: str | None = None, watermark: str = "1 hour",
                ts: str = "ts", positive=None, max_files: int = 10) -> DataFrame:
    """Counts and positives per event-time window (tumbling, or sliding
    with ``slide``).  Update mode: every batch writes the windows it changed
    (keyed by batch), the reader keeps the latest version of each window;
    rows later than the watermark are dropped."""
    positive = positive if positive is not None else F.lit(False)
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(source_dir)
    w = F.window(ts, window, slide) if slide else F.window(ts, window)
    agg = (s.withWatermark(ts, watermark).groupBy(w.alias("w"))
           .agg(F.count(F.lit(1)).alias("events"), F.count_if(positive).alias("positives")))

    def sink(df, batch_id):
        df.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                  "events", "positives", F.lit(batch_id).alias("batch_id")) \
            .write.mode("overwrite").parquet(_batch_path(out_dir, batch_id))

    q = (agg.writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    from lurescope.operators.detections import latest_versions
    res = spark.read.parquet(out_dir)
    return latest_versions(res.select("window_start", "window_end", "events", "positives", "batch_id"),
                           key="window_start", order=("batch_id",)).drop("batch_id")
