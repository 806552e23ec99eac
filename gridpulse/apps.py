"""The jobs as programs for ``spark-submit`` or ``python -m gridpulse.apps``.

    max       store readings, counts, maxima and temperatures, publish the maxima
    alert     publish maxima and alerts per subject
    average   average voltage per transformer and day
    train     train the model again and again
    predict   score forecasts with the newest model
    accuracy  accuracy on held-out rows

``--root`` is the folder of all tables; every job finds there what the others stored.
Messages come from Parquet files of ``(subject, payload)``, or from Kafka.
"""

from __future__ import annotations

import argparse
import os

from pyspark.sql import DataFrame, SparkSession

from .operators import aggregates as agg
from .plans import averages, prediction
from .session import use_utc
from .sinks import tables
from .sources import messages
from .streaming import jobs, runner, state

ARRIVAL = ("epoch",)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="gridpulse", description=__doc__)
    p.add_argument("job", choices=sorted(JOBS))
    p.add_argument("--root", required=True, help="folder of the tables")
    p.add_argument("--messages", help="folder of landed messages")
    p.add_argument("--kafka", help="bootstrap servers, instead of --messages")
    p.add_argument("--topics", help="Kafka topics")
    p.add_argument("--input", default="raw", help="subject prefix, for alert the whole pattern")
    p.add_argument("--output", default="extract", help="subject prefix of published messages")
    p.add_argument("--interval", type=int, default=int(os.environ.get("STREAMING_DURATION", 5000)),
                   help="milliseconds per micro-batch or between training passes")
    p.add_argument("--threshold", type=float,
                   default=float(os.environ.get("ALERT_THRESHOLD", prediction.THRESHOLD)))
    p.add_argument("--utc-offset-hours", type=int, default=0)
    p.add_argument("--max-iter", type=int, default=prediction.MAX_ITER)
    p.add_argument("--log-level", default=os.environ.get("LOG_LEVEL", ""),
                   help="names of stages to print, e.g. MAX,ALERTS")
    p.add_argument("--once", action="store_true", help="handle what is there and stop")
    return p


def _source(spark: SparkSession, args) -> DataFrame:
    if args.kafka:
        return messages.message_topic(spark, args.kafka, args.topics)
    return messages.message_files(spark, args.messages, files_per_batch=messages.FILES_PER_BATCH)


def _start(stream: DataFrame, handler, args, name: str, mode: str = "append"):
    interval = None if args.once else f"{args.interval} milliseconds"
    return runner.start(stream, handler, f"{args.root}/progress/{name}", mode, interval)


def run_max(spark: SparkSession, args) -> None:
    source = _source(spark, args)
    voltages = messages.point_readings(source, f"{args.input}.voltage.data.>")
    temperatures = messages.unkeyed(source, f"{args.input}.temperature.data")
    queries = [
        _start(
            voltages.withColumnRenamed("value", "voltage"),
            jobs.store_readings(args.root, args.output, args.log_level, ARRIVAL),
            args, "voltage",
        ),
        _start(
            temperatures.withColumnRenamed("value", "temperature"),
            jobs.store_temperatures(args.root, args.output),
            args, "temperature",
        ),
    ]
    for query in queries:
        query.awaitTermination()


def run_alert(spark: SparkSession, args) -> None:
    decoded = messages.keyed(_source(spark, args), args.input)
    handler = jobs.publish_states(
        args.root, log_level=args.log_level, subject=f"{args.output}.voltage.max"
    )
    known = state.subject_states(decoded, ttl_seconds=None if args.once else state.TIME_TO_LIVE)
    _start(known, handler, args, "alert", "update").awaitTermination()


def run_average(spark: SparkSession, args) -> None:
    raw = tables.read_upserts(spark, f"{args.root}/raw", jobs.POINT_KEY, list(ARRIVAL))
    averages.run(raw, f"{args.root}/avg_voltage_by_transformer").show(10)


def _training_rows(spark: SparkSession, args) -> DataFrame:
    voltage = tables.read_folded(spark, f"{args.root}/max", ["epoch"], "voltage")
    temperature = tables.read_folded(spark, f"{args.root}/temperature", ["epoch"], "temperature")
    return prediction.training_rows(voltage, temperature, args.threshold, args.utc_offset_hours)


def _models(spark: SparkSession, args) -> prediction.ModelStore:
    return prediction.ModelStore(spark, f"{args.root}/voltage_prediction")


def run_train(spark: SparkSession, args) -> None:
    prediction.retrain(
        _models(spark, args),
        lambda: _training_rows(spark, args),
        args.interval / 1000,
        passes=1 if args.once else None,
        max_iter=args.max_iter,
    )


def run_predict(spark: SparkSession, args) -> None:
    forecast = messages.unkeyed(_source(spark, args), f"{args.input}.temperature.forecast.12")
    handler = prediction.score_stream(
        prediction.CurrentModel(_models(spark, args)).get,
        f"{args.root}/prediction",
        args.threshold,
        args.utc_offset_hours,
    )
    _start(
        forecast.withColumnRenamed("value", "temperature"), handler, args, "prediction"
    ).awaitTermination()


def run_accuracy(spark: SparkSession, args) -> None:
    rows = _training_rows(spark, args)
    rows.show()
    print("Size:", agg.total_count(rows).first().n)
    accuracy = prediction.holdout_accuracy(rows, max_iter=args.max_iter)
    print("Test set accuracy =", accuracy.first().accuracy)


JOBS = {
    "max": run_max,
    "alert": run_alert,
    "average": run_average,
    "train": run_train,
    "predict": run_predict,
    "accuracy": run_accuracy,
}


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = use_utc(SparkSession.builder.appName(f"gridpulse-{args.job}").getOrCreate())
    JOBS[args.job](spark, args)


if __name__ == "__main__":
    main()
