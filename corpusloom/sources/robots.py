"""robots.txt tables: parsing, and the check of paths against the rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rules(robots: DataFrame) -> DataFrame:
    """host, body -> host, agent, allow, disallow, delay (0 if there is none), a row for each agent that a file names.

    Directives need a blank after their colon; what comes before the first agent, and lines that are empty or comments, don't count. The last delay
    of an agent holds.
    """
    lines = robots.select("host", F.posexplode(F.split("body", "\n")).alias("ord", "line")).withColumn("line", F.regexp_replace("line", r"^\s+|\s+$", ""))
    fields = lines.where("line <> '' and not startswith(line, '#')").withColumn("f", F.split("line", r"\s+")).where("size(f) >= 2")
    d = fields.select("host", "ord", F.lower(F.col("f")[0]).alias("name"), F.col("f")[1].alias("value"))
    w = Window.partitionBy("host").orderBy("ord")
    d = d.withColumn("agent", F.last(F.when(F.col("name") == "user-agent:", F.col("value")), ignorenulls=True).over(w)).where("agent is not null")
    of = lambda name: F.transform(F.array_sort(F.collect_list(F.when(F.col("name") == name, F.struct("ord", "value")))), lambda x: x["value"])
    delay = F.max_by(F.coalesce(F.expr("try_cast(value as int)"), F.lit(0)), F.when(F.col("name") == "crawl-delay:", F.col("ord")))
    return d.groupBy("host", "agent").agg(of("allow:").alias("allow"), of("disallow:").alias("disallow"), F.coalesce(delay, F.lit(0)).alias("delay"))


def allowed(urls: DataFrame, rules: DataFrame, agent: str) -> DataFrame:
    """Adds allowed (and delay) to rows with host and path: by the agent's rules, else those for *. A disallowed prefix decides; else all is allowed."""
    mine = rules.where(F.col("agent").isin(agent, "*")).groupBy("host").agg(F.max_by(F.struct("disallow", "delay"), (F.col("agent") == agent).cast("int")).alias("r"))
    joined = urls.join(mine, "host", "left")
    barred = F.exists(F.col("r.disallow"), lambda p: F.startswith(F.col("path"), p))
    return joined.withColumn("allowed", ~F.coalesce(barred, F.lit(False))).withColumn("delay", F.coalesce("r.delay", F.lit(0))).drop("r")


DEFAULT_DELAY = 3  # seconds between fetches of one host


def fetch_schedule(urls: DataFrame, default_delay: int = DEFAULT_DELAY) -> DataFrame:
    """Adds fetch_at, the second at which each URL of a host may be fetched: one every delay seconds."""
    gap = F.when(F.col("delay") > 0, F.col("delay")).otherwise(default_delay)
    return urls.withColumn("fetch_at", (F.row_number().over(Window.partitionBy("host").orderBy("path")) - 1) * gap)
