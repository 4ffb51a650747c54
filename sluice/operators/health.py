"""Feed health out of run logs: rows (source, id, at epoch seconds, ok, items, feed_at)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Windows in seconds, counts and ratios of the verdicts.
DAY, WEEK = 86_400, 7 * 86_400
EMPTY_RUNS, FLAKY_RUNS, FLAKY_RATIO, SHORT_RUNS, SHORT_RATIO, DROP_RATIO = 3, 3, 0.3, 20, 0.2, 0.3


def streaks(runs: DataFrame) -> DataFrame:
    """(source, failed, empty): length of the trailing failures, and of the trailing
    successes without items."""
    last_ok = F.coalesce(F.max(F.when(F.col("ok"), F.col("id"))).over(Window.partitionBy("source")), F.lit(-1))
    last_other = F.coalesce(F.max(F.when(~(F.col("ok") & (F.col("items") == 0)), F.col("id"))).over(Window.partitionBy("source")), F.lit(-1))
    marked = runs.withColumns({"a": last_ok, "b": last_other})
    return marked.groupBy("source").agg(F.sum((F.col("id") > F.col("a")).cast("long")).alias("failed"), F.sum((F.col("id") > F.col("b")).cast("long")).alias("empty"))


def observed(runs: DataFrame) -> DataFrame:
    """Runs without episodes of fewer than three failures; a source that only ever
    failed keeps all its runs."""
    island = F.sum(F.col("ok").cast("long")).over(Window.partitionBy("source").orderBy("id"))
    marked = runs.withColumn("island", island)
    marked = marked.withColumn("failures", F.sum((~F.col("ok")).cast("long")).over(Window.partitionBy("source", "island")))
    marked = marked.withColumn("never", F.max(F.col("ok").cast("int")).over(Window.partitionBy("source")) == 0)
    return marked.where(F.col("ok") | (F.col("failures") >= 3) | F.col("never")).drop("island", "failures", "never")


def rolling_mean(runs: DataFrame) -> DataFrame:
    """Adds mean: items of the successful runs of the last seven days that were logged
    before. Runs are logged in order of time."""
    w = Window.partitionBy("source").orderBy("at").rangeBetween(-WEEK, 0)
    same = Window.partitionBy("source", "at").orderBy("id").rowsBetween(0, Window.unboundedFollowing)
    items, n = F.when(F.col("ok"), F.col("items")), F.col("ok").cast("long")
    total = F.sum(items).over(w) - F.coalesce(F.sum(items).over(same), F.lit(0))
    count = F.sum(n).over(w) - F.sum(n).over(same)
    return runs.withColumn("mean", F.when(count > 0, total / count))


def last_productive(runs: DataFrame) -> DataFrame:
    """Adds productive: items of the last productive run so far."""
    w = Window.partitionBy("source").orderBy("id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return runs.withColumn("productive", F.last(F.when(F.col("ok") & (F.col("items") > 0), F.col("items")), ignorenulls=True).over(w))


def window_counts(runs: DataFrame, now: Column, days: int) -> list[Column]:
    """Runs and failures of the last ``days`` days, both ends included."""
    inside = F.col("at").between(now - days * DAY, now)
    return [F.sum(inside.cast("long")).alias(f"runs_{days}d"), F.sum((inside & ~F.col("ok")).cast("long")).alias(f"failed_{days}d")]


def verdicts(runs: DataFrame, now: int | Column, feed_silent_days: int | None = None) -> DataFrame:
    """(source, status): the first of the verdicts that applies to a source's runs,
    judged at ``now`` (epoch seconds, a number or a column)."""
    seen = last_productive(rolling_mean(observed(runs)))
    by_source = Window.partitionBy("source")
    last_other = F.coalesce(F.max(F.when(~(F.col("ok") & (F.col("items") == 0)), F.col("id"))).over(by_source), F.lit(-1))
    seen = seen.withColumn("other", last_other)
    tail = seen.groupBy("source").agg(
        F.max_by("ok", "id").alias("last_ok"),
        F.max_by("items", "id").alias("last_items"),
        F.max_by("mean", "id").alias("last_mean"),
        F.sum((F.col("id") > F.col("other")).cast("long")).alias("empty"),
        F.min_by("mean", F.when(F.col("id") > F.col("other"), F.col("id"))).alias("mean_before"),
        F.min_by("productive", F.when(F.col("id") > F.col("other"), F.col("id"))).alias("productive_before"),
    )
    runs, at = runs.withColumn("__now", F.lit(now)), F.col("__now")
    whole = runs.groupBy("source").agg(
        F.max(at).alias("__now"),
        F.max(F.when(F.col("at") <= at, F.col("at"))).alias("credible"),
        (F.max("at") - F.min("at")).alias("span"),
        F.sum(F.col("ok").cast("long")).alias("good"),
        F.max((F.col("ok") & (F.col("items") > 0)).cast("int")).alias("produced"),
        *window_counts(runs, at, 7),
        *window_counts(runs, at, 1),
        F.max(F.when(F.col("feed_at") <= at + 3600, F.col("feed_at"))).alias("feed"),
        F.max("feed_at").alias("any_feed"),
    )
    baseline = F.coalesce("mean_before", F.col("productive_before").cast("double"))
    silent = F.lit(False) if feed_silent_days is None else F.col("any_feed").isNotNull() & (F.col("last_items") > 0) & (F.col("feed").isNull() | (F.greatest(F.lit(0), at - F.col("feed")) >= feed_silent_days * DAY))
    status = (
        F.when(~F.col("last_ok"), "BROKEN")
        .when((F.col("empty") >= EMPTY_RUNS) & (baseline > 0), "BROKEN")
        .when(F.col("credible").isNull(), "STALE")
        .when(at - F.col("credible") > WEEK, "STALE")
        .when((F.col("produced") == 0) & (F.col("good") >= EMPTY_RUNS) & (F.col("span") >= WEEK), "NEVER_PRODUCED")
        .when((F.col("runs_7d") >= FLAKY_RUNS) & (F.col("failed_7d") / F.col("runs_7d") > FLAKY_RATIO), "WARN_FLAKY")
        .when((F.col("runs_1d") >= SHORT_RUNS) & (F.col("failed_1d") / F.col("runs_1d") > SHORT_RATIO), "WARN_FLAKY")
        .when(silent, "FEED_SILENT")
        .when((F.col("last_mean") > 0) & (F.col("last_items") < F.col("last_mean") * DROP_RATIO), "WARN_DROP")
        .otherwise("OK")
    )
    return whole.join(tail, "source").select("source", status.alias("status"))


def due_alerts(verdict: DataFrame, alerts: DataFrame, now: int | Column, hours: int) -> DataFrame:
    """Alerting verdicts without an alert of the same status in the last hours; an
    alert in the future doesn't count. alerts has (source, status, at)."""
    last = alerts.groupBy("source", "status").agg(F.max("at").alias("at"))
    joined = verdict.where("status <> 'OK'").join(last, ["source", "status"], "left")
    return joined.where(F.col("at").isNull() | (F.col("at") > now) | (F.lit(now) - F.col("at") >= hours * 3600)).select("source", "status")


def recoveries(statuses: DataFrame) -> DataFrame:
    """(source, id): the first OK after an alerting status. statuses has (source, id, status)."""
    before = F.lag("status").over(Window.partitionBy("source").orderBy("id"))
    return statuses.withColumn("before", before).where("status = 'OK' and before <> 'OK'").select("source", "id")


def same_filter(judged: DataFrame) -> DataFrame:
    """(source, reason, n): sources with three or more judged listings that all were
    refused for one reason. Figures in a reason don't count; a reason of class is the
    classifier at work and none of these."""
    lower = F.lower("reason")
    plain = F.trim(F.regexp_replace(lower, "[0-9]+(?:[.,][0-9]+)?", "N"))
    key = F.when((F.trim("reason") != "") & ~lower.rlike("^(tenure:|exclu ?:)"), plain)
    per = judged.withColumn("reason", key).groupBy("source").agg(F.count("*").alias("n"), F.count("reason").alias("refused"), F.min("reason").alias("low"), F.max("reason").alias("high"))
    return per.where("n >= 3 and refused = n and low = high").select("source", F.col("low").alias("reason"), "n")


def pattern_misses(calls: DataFrame) -> DataFrame:
    """(source, pattern, calls): patterns tried three times or more that never matched."""
    return calls.groupBy("source", "pattern").agg(F.count("*").alias("calls"), F.sum(F.col("hit").cast("long")).alias("hits")).where("calls >= 3 and hits = 0").select("source", "pattern", "calls")
