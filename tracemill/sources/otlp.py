"""Envelopes of trace batches and OTLP payloads as flat rows."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_VALUE = "struct<stringValue: string, intValue: string, boolValue: boolean>"
_ATTRIBUTES = f"array<struct<key: string, value: {_VALUE}>>"
_POINT = f"array<struct<asDouble: double, asInt: string, timeUnixNano: string, attributes: {_ATTRIBUTES}>>"
METRICS = f"resourceMetrics array<struct<scopeMetrics: array<struct<metrics: array<struct<name: string, gauge: struct<dataPoints: {_POINT}>, sum: struct<dataPoints: {_POINT}>, histogram: struct<dataPoints: {_POINT}>>>>>>>"
SPANS = f"resourceSpans array<struct<scopeSpans: array<struct<spans: array<struct<traceId: string, spanId: string, parentSpanId: string, name: string, startTimeUnixNano: string, endTimeUnixNano: string, status: struct<code: string>, attributes: {_ATTRIBUTES}>>>>>>"
LOGS = "resourceLogs array<struct<scopeLogs: array<struct<logRecords: array<struct<timeUnixNano: string, severityNumber: int, body: struct<stringValue: string>>>>>>>"
ENVELOPE = (
    "events array<struct<event_type: string, trace: struct<trace_id: string, thought_id: string, task_id: string, agent_id_hash: string, started_at: string, completed_at: string, "
    "components: array<struct<component_type: string, event_type: string, timestamp: string, data: string>>, signature: string, signature_key_id: string>>>, batch_timestamp string, consent_timestamp string, trace_level string, "
    "correlation_metadata struct<deployment_region: string, deployment_type: string, agent_role: string, agent_template: string, user_location: string, user_timezone: string, user_latitude: double, user_longitude: double>"
)
#: fixed values: severities of OTLP logs
LEVELS = {5: "DEBUG", 9: "INFO", 13: "WARNING", 17: "ERROR", 21: "CRITICAL"}


def _time(nanos: str) -> Column:
    return F.timestamp_micros(F.floor(F.col(nanos).cast("decimal(20,0)") / 1000).cast("long"))


def _labels(attributes: str) -> Column:
    text = lambda a: F.coalesce(a["value"]["stringValue"], a["value"]["intValue"], a["value"]["boolValue"].cast("string"))
    held = F.filter(F.transform(attributes, lambda a: F.struct(a["key"].alias("key"), text(a).alias("value"))), lambda e: e["value"].isNotNull())
    return F.map_from_entries(F.coalesce(held, F.array().cast("array<struct<key:string,value:string>>")))


def _traces_of(batches: DataFrame) -> DataFrame:
    """One row per trace with its batch's times, level and metadata; places are coarse, free text about them is dropped."""
    cell = lambda c: (F.bround(F.col(f"correlation_metadata.{c}") / 0.5) * 0.5).alias(c)
    kept = [F.col(f"correlation_metadata.{c}") for c in ("deployment_region", "deployment_type", "agent_role", "agent_template", "user_timezone")]
    level = F.coalesce("trace_level", F.lit("generic")).alias("trace_level")
    return batches.select(F.explode("events").alias("e"), "batch_timestamp", "consent_timestamp", level, *kept, cell("user_latitude"), cell("user_longitude")).select("e.trace.*", "*").drop("e")


def read_trace_batches(spark: SparkSession, path: str) -> DataFrame:
    """Traces of files of JSON batches."""
    return _traces_of(spark.read.schema(ENVELOPE).json(path))


def parse_trace_batches(raw: DataFrame, column: str = "value") -> DataFrame:
    """Traces of a column of JSON batches; text that is no batch gives none."""
    return _traces_of(raw.select(F.from_json(column, ENVELOPE).alias("b")).select("b.*"))


def read_lines(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Lines of the files of a folder as (value, file), once or as they come; blank lines are none."""
    reader = spark.readStream if stream else spark.read
    lines = reader.text(path).select("value", F.col("_metadata.file_path").alias("file"))
    return lines.where(F.trim("value") != "")


def sorted_out(lines: DataFrame, schema: str) -> tuple[DataFrame, DataFrame]:
    """(good, bad) of lines that should be JSON objects of a schema such as ``ENVELOPE``, ``METRICS``, ``SPANS`` or ``LOGS``.

    Good lines go to the parser of their kind as they are.  Bad ones are (record, file,
    reason): no JSON, no object, or fields of other types.  A bad line costs no other.
    """
    parsed = lines.withColumn("j", F.from_json("value", f"{schema}, __bad string", {"columnNameOfCorruptRecord": "__bad"})).withColumn("v", F.try_parse_json("value"))
    kind = F.schema_of_variant("v")
    reason = F.when(F.col("v").isNull(), "no JSON").when(~kind.startswith("OBJECT"), "no object").when(F.col("j").isNull() | F.col("j.__bad").isNotNull(), "other types")
    judged = parsed.select("value", "file", reason.alias("reason"))
    return judged.where("reason is null").select("value", "file"), judged.where("reason is not null").select(F.col("value").alias("record"), "file", "reason")


def explode_components(traces: DataFrame) -> DataFrame:
    """One row per component of a trace, in order."""
    return traces.select("trace_id", F.posexplode("components").alias("i", "c")).select("trace_id", "i", "c.component_type", "c.event_type", "c.timestamp", "c.data")


def flatten_otlp_metrics(raw: DataFrame, column: str = "value") -> DataFrame:
    """Points of gauges, sums and histograms; a point without a number is left out."""
    metrics = raw.select(F.from_json(column, METRICS).alias("j")).select(F.explode("j.resourceMetrics").alias("r")).select(F.explode("r.scopeMetrics").alias("s")).select(F.explode("s.metrics").alias("m"))
    points = metrics.select("m.name", F.explode(F.coalesce("m.gauge.dataPoints", "m.sum.dataPoints", "m.histogram.dataPoints")).alias("p"))
    value = F.coalesce("p.asDouble", F.col("p.asInt").try_cast("double"))
    return points.select("name", value.alias("value"), _time("p.timeUnixNano").alias("ts"), _labels("p.attributes").alias("labels")).where("value is not null")


def flatten_otlp_spans(raw: DataFrame, column: str = "value") -> DataFrame:
    spans = raw.select(F.from_json(column, SPANS).alias("j")).select(F.explode("j.resourceSpans").alias("r")).select(F.explode("r.scopeSpans").alias("s")).select(F.explode("s.spans").alias("x"))
    return spans.select("x.traceId", "x.spanId", F.nullif("x.parentSpanId", F.lit("")).alias("parentSpanId"), "x.name", _time("x.startTimeUnixNano").alias("started"), _time("x.endTimeUnixNano").alias("ended"), F.coalesce("x.status.code", F.lit("OK")).alias("status"), _labels("x.attributes").alias("labels"))


def flatten_otlp_logs(raw: DataFrame, column: str = "value") -> DataFrame:
    records = raw.select(F.from_json(column, LOGS).alias("j")).select(F.explode("j.resourceLogs").alias("r")).select(F.explode("r.scopeLogs").alias("s")).select(F.explode("s.logRecords").alias("x"))
    level = F.coalesce(F.create_map(*[F.lit(v) for pair in LEVELS.items() for v in pair])[F.col("x.severityNumber")], F.lit("INFO"))
    return records.select(_time("x.timeUnixNano").alias("ts"), level.alias("level"), F.col("x.body.stringValue").alias("message"))


def scratch(spark: SparkSession) -> str:
    """A new folder where driver and executors can both write: below the checkpoint folder that the cluster names."""
    named = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="scratch-")
    return f"{named}/scratch-{uuid.uuid4()}"


def written(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read from there: what several later plans start from."""
    folder = scratch(df.sparkSession)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def write_traces(traces: DataFrame, path: str) -> None:
    """Trace store by date, sorted by agent and time inside each file."""
    traces.withColumn("dt", F.to_date("ts")).repartition("dt", F.pmod(F.xxhash64("agent_id_hash"), F.lit(16))).sortWithinPartitions("agent_id_hash", "ts").write.partitionBy("dt").mode("overwrite").parquet(path)


#: fixed values: the data sets of a corpus export and the column that each is ordered by
DATASETS = {"traces": "event_id", "trace_batches": "batch_timestamp", "public_keys": "created_at", "connectivity_events": "ts", "trace_context": "event_id"}


def export_jsonl(tables: dict[str, DataFrame], path: str, order: dict[str, str] | None = None) -> None:
    """Each table as lines of JSON, ordered by the column named for it or else by its first."""
    for name, df in tables.items():
        df.orderBy((order or {}).get(name, df.columns[0])).write.mode("overwrite").json(f"{path}/{name}")


def export_corpus(tables: dict[str, DataFrame], path: str) -> None:
    """The five data sets of a corpus, each in its own order; all of them or none."""
    missing = [f"{name}.{column}" for name, column in DATASETS.items() if name not in tables or column not in tables[name].columns]
    if missing:
        raise ValueError(f"a corpus export needs {', '.join(missing)}")
    export_jsonl({name: tables[name] for name in DATASETS}, path, DATASETS)
