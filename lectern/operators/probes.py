"""Probe results, failures and run retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lectern.functions import ordered, text as tx

# Error texts that mean a dead link rather than a platform failure.
LINK_MARKERS = ("xsec_token", "作品不可见", "稿件不可见", "不存在或已删除", "找不到这个内容")
# HTTP status codes with a meaning of their own. Texts are this library's.
HTTP_HINTS = (
    (403, "{p} refused access", "open the link in a browser without signing in"),
    (404, "{p} has no such item", "copy the link again from the page"),
    (412, "{p} blocked this network", "run from another network, or later"),
    (429, "{p} limits the request rate", "wait, and send fewer requests at once"),
    (461, "{p} wants a human check", "sign in once in a browser, then retry"),
    (471, "{p} wants a human check", "sign in once in a browser, then retry"),
)
HTTP_DEFAULT = ("{p} answered HTTP {c}", "retry later")
# Business codes of the video platform.
BUSINESS_CODES = (
    (-412, "blocked as unusual traffic", "run from another network, or later"),
    (-404, "no such video", "check the link"),
    (-403, "no permission to watch", "choose a public video"),
    (-352, "blocked by a traffic check", "run from another network, or later"),
    (-101, "sign-in needed", "sign in, then retry"),
    (62002, "video is hidden", "choose a public video"),
    (62004, "video is under review", "retry after the review"),
    (62012, "video is visible to its owner only", "choose a public video"),
)
BUSINESS_DEFAULT = ("platform error code {c}", "retry later")
DEFAULT_IMPACT = "step not finished"
RETRY_STEP = "run this item again"


def failure_category(error: Column) -> Column:
    link = F.exists(F.array(*map(F.lit, LINK_MARKERS)), lambda m: F.contains(error, m))
    return F.when(F.coalesce(error, F.lit("")) == "", "ok").when(link, "link").otherwise("platform")


def classify_failures(probes: DataFrame) -> DataFrame:
    return probes.withColumn("category", failure_category(F.col("error")))


def success_rates(classified: DataFrame) -> DataFrame:
    """Counts and rate per platform plus an overall row (platform NULL); dead links do not count."""
    per = classified.groupBy("platform").agg(
        F.count("*").alias("t"), F.count_if(F.col("category") == "ok").alias("o"), F.count_if(F.col("category") == "link").alias("l"))
    g = per.rollup("platform").agg(F.sum("t").alias("total"), F.sum("o").alias("ok"), F.sum("l").alias("link"))
    valid = F.col("total") - F.col("link")
    return g.select("platform", "total", "ok", "link", F.when(valid > 0, F.col("ok") / valid).otherwise(0.0).alias("rate"))


def explain_failures(failures: DataFrame) -> DataFrame:
    """Reason and next step of ``(failure_id, source, platform, code)``; source is http or business."""
    def table(rows, source):
        return F.array(*[F.struct(F.lit(source).alias("source"), F.lit(c).alias("code"), F.lit(r).alias("reason"), F.lit(n).alias("next_step")) for c, r, n in rows])

    spark = failures.sparkSession
    known = spark.range(1).select(F.inline(F.concat(table(HTTP_HINTS, "http"), table(BUSINESS_CODES, "business"))))
    rows = failures.join(F.broadcast(known), ["source", "code"], "left")  # fourteen fixed rows
    http = F.col("source") == "http"
    reason = F.coalesce("reason", F.when(http, HTTP_DEFAULT[0]).otherwise(BUSINESS_DEFAULT[0]))
    step = F.coalesce("next_step", F.when(http, HTTP_DEFAULT[1]).otherwise(BUSINESS_DEFAULT[1]))
    filled = F.replace(F.replace(reason, F.lit("{p}"), F.coalesce("platform", F.lit("the platform"))), F.lit("{c}"), F.col("code").cast("string"))
    return rows.select("failure_id", filled.alias("reason"), step.alias("next_step"))


def failure_records(logs: DataFrame) -> DataFrame:
    """Uniform records of ``(log_id, error_type, message, impact, rerun)``."""
    first = F.substring(F.element_at(tx.lines_of(tx.strip(F.coalesce("message", F.lit("")))), 1), 1, 200)
    reason = F.when(F.coalesce(first, F.lit("")) == "", F.col("error_type")).otherwise(first)
    impact = F.when(F.coalesce("impact", F.lit("")) == "", DEFAULT_IMPACT).otherwise(F.col("impact"))
    rerun = F.coalesce("rerun", F.lit(""))
    step = F.when(rerun != "", F.concat(F.lit(RETRY_STEP + ": "), rerun)).otherwise(RETRY_STEP)
    error = F.concat(F.lit("reason: "), reason, F.lit("\nimpact: "), impact, F.lit("\nnext: "), step, F.lit("\ndetail: "), F.substring("error_type", 1, 300))
    return logs.select("log_id", error.alias("error"), reason.alias("reason"), impact.alias("impact"), step.alias("next_step"), rerun.alias("rerun"))


def latest_runs(runs: DataFrame, keep: int) -> DataFrame:
    """The newest ``keep`` runs of each report kind (the limit reaches the map side)."""
    order = W.partitionBy("kind").orderBy(F.desc("ts"), F.desc("run_id"))
    return runs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= keep)


# Lines of the probe report.
REPORT_TABLE = ("| 平台 | 成功 / 有效链接 | 成功率 | 链接失效 |", "|---|---|---|---|")
REPORT_DETAIL = ("| 平台 | 结果 | 耗时(s) | 链接 | 摘要 / 错误 |", "|---|---|---|---|---|")
REPORT_HINT = "链接失效的处理：按 references/smoke_urls.json 的 _说明 重新取链接（小红书要从网页搜索结果里重取令牌）。"
REPORT_MARKS = {"ok": "✅", "link": "⚠️ 链接失效"}
REPORT_FAULT = "❌ 平台故障"


def probe_report(classified: DataFrame) -> DataFrame:
    """Report of every probe run as numbered lines ``(run_id, line_no, line)``.

    ``classified(run_id, pos, platform, category, seconds, url, error, detail)``; platforms are in
    order of first appearance, rates are rounded to three digits first. Dead links do not count.
    """
    per = classified.groupBy("run_id", "platform").agg(
        F.count("*").alias("total"), F.count_if(F.col("category") == "ok").alias("ok"), F.count_if(F.col("category") == "link").alias("link"), F.min("pos").alias("pos"))
    whole = per.groupBy("run_id").agg(*[F.sum(c).alias(c) for c in ("total", "ok", "link")])

    def rate():
        valid = F.col("total") - F.col("link")
        share = F.bround(F.when(valid > 0, F.col("ok") / valid).otherwise(0.0), 3)
        return F.concat(F.rint(share * 100).cast("int").cast("string"), F.lit("%"))

    def s(c):
        return F.col(c).cast("string")

    valid = (F.col("total") - F.col("link")).cast("string")

    def line(df, part, *parts, pos=None):
        order = F.struct(F.lit(part).alias("part"), (F.lit(0) if pos is None else F.col(pos)).cast("bigint").alias("pos"))
        return df.select("run_id", order.alias("o"), F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts]).alias("line"))

    info = F.when(F.col("category") == "ok", F.col("detail")).otherwise(F.col("error"))
    info = F.replace(F.replace(F.coalesce(info, F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))
    mark = F.coalesce(*[F.when(F.col("category") == k, v) for k, v in REPORT_MARKS.items()], F.lit(REPORT_FAULT))
    dead = whole.filter("link > 0")
    return ordered.number_lines([
        line(whole, 0, "**整体成功率 ", rate(), "**（", s("ok"), " / ", valid, "，不含链接失效 ", s("link"), " 条）"),
        *[line(whole, 1 + i, x) for i, x in enumerate(("", *REPORT_TABLE))],
        line(per, 4, "| ", F.col("platform"), " | ", s("ok"), " / ", valid, " | ", rate(), " | ", s("link"), " |", pos="pos"),
        *[line(whole, 5 + i, x) for i, x in enumerate(("", *REPORT_DETAIL))],
        line(classified, 8, "| ", F.col("platform"), " | ", mark, " | ", F.coalesce(s("seconds"), F.lit("")), " | ", F.coalesce("url", F.lit("")), " | ", info, " |", pos="pos"),
        line(dead, 9, ""), line(dead, 10, REPORT_HINT),
    ], "run_id")
