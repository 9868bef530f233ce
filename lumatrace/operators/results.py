"""Reading, sorting, filtering, selecting and changing result groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.display import sort_priority
from ..functions.paths import file_name


def fetch_group(results: DataFrame, group_id: int, limit: int = 10_000) -> DataFrame:
    """Rows of one group, best first, then by score; the filter reaches the scan."""
    return results.where(F.col("group_id") == group_id).orderBy(F.col("is_best").desc(), F.col("distance").desc(), "path").limit(limit)


def sorted_groups(summary: DataFrame, by: str) -> DataFrame:
    order = {"count": F.col("dup_count").desc(), "size": F.col("total_size").desc(), "name": F.col("name").asc()}
    return summary.orderBy(order[by], "group_id")


def with_priority(results: DataFrame) -> DataFrame:
    return results.withColumn("priority", sort_priority(F.col("is_best"), F.col("found_by"), F.col("distance")))


def child_order(results: DataFrame) -> DataFrame:
    """``position`` of each row in its group: best first, then the higher score, then the path."""
    w = Window.partitionBy("group_id").orderBy(F.col("is_best").desc(), F.col("distance").desc(), "path", F.coalesce("channel", F.lit("")))
    return results.withColumn("position", F.row_number().over(w))


def min_similarity(results: DataFrame, least: int) -> DataFrame:
    """Best rows and hash matches always pass, AI matches from ``least``; 0 switches the filter off."""
    if not least:
        return results
    return results.where(F.col("is_best") | (F.col("found_by") != "AI") | (F.col("distance") >= least))


def name_filter(results: DataFrame, text: str) -> DataFrame:
    return results.where(F.contains(F.lower(file_name(F.col("path"))), F.lit(text.lower())))


def check(results: DataFrame, action: str, checked: str = "checked") -> DataFrame:
    """Check state after select all, none, all except best, or invert."""
    now = F.coalesce(F.col(checked), F.lit(False)) if checked in results.columns else F.lit(False)
    new: dict[str, Column] = {"all": F.lit(True), "none": F.lit(False), "except_best": ~F.col("is_best"), "invert": ~now}
    return results.withColumn(checked, new[action])


def check_rollup(results: DataFrame) -> DataFrame:
    """``group_id, state``: none, all or partial."""
    n, on = F.count("*"), F.sum(F.col("checked").cast("int"))
    return results.groupBy("group_id").agg(F.when(on == 0, "none").when(on == n, "all").otherwise("partial").alias("state"))


def totals(summary: DataFrame) -> DataFrame:
    """Header line: number of groups, duplicates and bytes."""
    return summary.agg(F.count("*").alias("groups"), F.coalesce(F.sum(F.greatest(F.lit(0), F.col("dup_count"))), F.lit(0)).alias("duplicates"), F.coalesce(F.sum("total_size"), F.lit(0)).alias("total_size"))


def affected(results: DataFrame) -> DataFrame:
    return results.where("checked").agg(F.count_distinct("group_id").alias("groups"), F.count_distinct("path").alias("files"))


def link_plan(results: DataFrame, method: str = "hardlink") -> DataFrame:
    """``source, target, method``: each checked duplicate is to be replaced by a link to its group's best file."""
    best = results.where("is_best").groupBy("group_id").agg(F.min("path").alias("target"))
    dup = results.where(F.col("checked") & ~F.col("is_best")).select("group_id", F.col("path").alias("source"))
    return dup.join(best, "group_id").where("source <> target").select("source", "target", F.lit(method).alias("method")).distinct()


def delete_plan(results: DataFrame) -> DataFrame:
    return results.where("checked").select(F.col("path").alias("source"), F.lit(None).cast("string").alias("target"), F.lit("delete").alias("method")).distinct()


def remove_paths(results: DataFrame, gone: DataFrame, least: int = 2) -> DataFrame:
    """Rows without the paths in ``gone`` (letter case does not matter); the first row left becomes best, and groups below ``least`` rows go."""
    key = F.lower(F.translate("path", "\\", "/"))
    left = results.withColumn("_k", key).join(gone.select(key.alias("_k")).distinct(), "_k", "left_anti").drop("_k")
    n = F.count("*").over(Window.partitionBy("group_id"))
    ordered = child_order(left).withColumn("_n", n).where(F.col("_n") >= least)
    return ordered.withColumn("is_best", F.col("position") == 1).drop("position", "_n")


def report_pages(results: DataFrame, per_group: int = 200, per_page: int = 50, max_visuals: int | None = None) -> DataFrame:
    """``group_id, page, place, path``: the best and then the duplicates by score, at most ``per_group`` of a group, ``per_page`` on a page.

    With ``max_visuals`` only the pages of that many groups, the largest in bytes first.
    """
    if max_visuals is not None:
        size = results.groupBy("group_id").agg(F.sum(F.coalesce("file_size", F.lit(0))).alias("size"))
        results = results.join(size.orderBy(F.col("size").desc(), "group_id").limit(max_visuals).select("group_id"), "group_id", "left_semi")
    return (
        child_order(results).where(F.col("position") <= per_group)
        .select("group_id", F.floor((F.col("position") - 1) / per_page).cast("int").alias("page"), ((F.col("position") - 1) % per_page).alias("place"), "path")
    )


def reconstruct_groups(results: DataFrame) -> DataFrame:
    """``group_id, best, duplicates``: the nested form, duplicates by score. Meant for one page of groups, as a group becomes one array."""
    best = F.max_by("path", F.struct(F.col("is_best").cast("int").alias("b"), "distance"))
    dups = F.collect_list(F.when(~F.col("is_best"), F.struct((-F.col("distance")).alias("d"), F.col("path"), F.col("found_by"))))
    return results.groupBy("group_id").agg(best.alias("best"), F.array_sort(dups).alias("duplicates"))


def reader_stats(runs: DataFrame, key: str, ok: Column, millis: Column, memory: Column) -> DataFrame:
    """Successes, failures, not applicable, least, mean and greatest time and summed memory of each reader."""
    good = F.coalesce(ok, F.lit(False))
    return runs.groupBy(key).agg(
        F.sum(good.cast("int")).alias("ok"), F.sum((~ok).cast("int")).alias("failed"), F.sum(ok.isNull().cast("int")).alias("not_applicable"),
        F.round(F.min(F.when(good, millis)), 6).alias("min_ms"), F.round(F.avg(F.when(good, millis)), 6).alias("avg_ms"), F.round(F.max(F.when(good, millis)), 6).alias("max_ms"),
        F.round(F.sum(memory), 6).alias("sum_mb"),
    )
