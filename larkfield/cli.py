"""Command line of the query-log operators: python -m larkfield.cli COMMAND INPUT.csv [options]."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkfield.operators import assistant, models
from larkfield.operators import querylog as q
from larkfield.sources.sinks import output_path, report, stamp, write_csv
from larkfield.sources.tables import read_query_log, with_row_index

#: Suffix of each trend's file, and its aggregate.
TRENDS = {
    "trend_daily_volume_result": lambda r, a: q.daily(r).orderBy("date"),
    "trend_hourly_volume_result": lambda r, a: q.hourly(r).orderBy(F.expr("try_cast(hour_jst as int)").asc_nulls_last()),
    "trend_proximity_prefecture_result": lambda r, a: q.by_prefecture(r),
    "trend_top_queries_result": lambda r, a: q.top_queries(r, a.top_n).orderBy(q.category_rank().asc_nulls_last(), "ai_classification", "rank"),
    "trend_daily_category_result": lambda r, a: q.daily_category(r).orderBy("date", q.category_rank().asc_nulls_last(), "ai_classification"),
    "trend_column_usage_result": lambda r, a: q.column_usage(r),
    "trend_long_tail_result": lambda r, a: q.long_tail(r),
}


CHARTS = {"trend_daily_volume_result": "line", "trend_hourly_volume_result": "bar", "trend_proximity_prefecture_result": "bar", "trend_column_usage_result": "pie"}


def run(spark: SparkSession, args: argparse.Namespace) -> list[str]:
    """Run a command and return the paths it wrote."""
    needed = ("query", "ai_classification", "datetime") if args.command.startswith("analyze") else ("ai_classification",) if args.command == "count-classifications" else ("query",)
    rows, when, out = with_row_index(read_query_log(spark, args.input, needed)), stamp(), []

    def labelled(df: DataFrame) -> DataFrame:
        """Labels of df's queries by the model named, or the stand-in; as one batch job or on so many workers."""
        model = models.load(args.model) if args.model else models.stub
        if args.batch_api:
            requests = assistant.batch_requests(df, args.batch_size)
            return assistant.batch_labels(requests, models.answered(requests, model))
        return models.classify(df, model, args.batch_size, workers=args.workers)

    def save(df: DataFrame, suffix: str, single: bool = False) -> None:
        out.append(output_path(args.out, args.input, suffix, when))
        write_csv(df.drop("row_idx", "first_idx"), out[-1], single=single)

    if args.command == "dedup":
        kept = q.clean(rows).orderBy("row_idx")
        save(kept.select("query", "same_query_count") if args.columns_only else kept, "cleaning_queryonly" if args.columns_only else "cleaning")
    elif args.command == "add-query-count":
        save(q.with_query_count(rows).orderBy("row_idx"), "query_count_annotated")
    elif args.command == "count-queries":
        save(q.count_queries(rows), "count_analysis_result")
    elif args.command == "ai-classify":
        rows = rows if args.max_batches is None else rows.where(F.col("row_idx") < args.max_batches * args.batch_size)
        save(q.apply_labels(rows.drop("ai_classification"), labelled(rows)).orderBy("row_idx"), "classified_analysis_result")
    elif args.command == "ai-retry":
        redone = q.retry(rows, labelled, args.category, args.max_batches and args.max_batches * args.batch_size)
        save(redone.orderBy("row_idx"), "classified_retry_analysis_result")
    elif args.command == "count-classifications":
        save(q.count_labels(rows), "classification_count_analysis_result", True)
    else:
        rows = rows.cache()  # seven aggregates read it
        found = {name: f(rows, args) for name, f in TRENDS.items()}
        for name, df in found.items():
            save(df, name, True)
        path = output_path(args.out, args.input, "trend_report_ai" if args.command == "analyze-ai" else "trend_report", when, "html")
        text = assistant.commentary(q.summary_payload(rows), models.load(args.model)) if args.command == "analyze-ai" and args.model else ""
        page = report("Query trends", list(found.items()), text, charts=CHARTS)
        spark.createDataFrame([(page,)], "value string").coalesce(1).write.mode("overwrite").text(path)
        out.append(path)
        rows.unpersist()
    return out


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="larkfield")
    p.add_argument("command", choices=["dedup", "add-query-count", "count-queries", "ai-classify", "ai-retry", "count-classifications", "analyze", "analyze-ai"])
    p.add_argument("input")
    p.add_argument("--out", default="local_output")
    p.add_argument("--columns-only", action="store_true")
    p.add_argument("--batch-size", type=int, default=30)
    p.add_argument("--max-batches", type=int)
    p.add_argument("--model", help="module:function of a model; its environment holds its own credentials")
    p.add_argument("--batch-api", action="store_true", help="requests in one job, those that fail get the default label")
    p.add_argument("--workers", type=int, help="batches asked at once")
    p.add_argument("--category", default="others")
    p.add_argument("--top-n", type=int, default=20)
    return p


if __name__ == "__main__":
    session = SparkSession.builder.getOrCreate()
    print("\n".join(run(session, parser().parse_args())))
