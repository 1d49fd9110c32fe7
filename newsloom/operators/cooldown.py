"""Rate-limit cooldowns: a fold over each scope's observations in order of time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHORT_SECONDS, LONG_FROM, REPEAT_SECONDS, REPEAT_WAIT, FIRST_WAIT = 1800, 1800, 900, 3600, 300


def _step(state: Column, x: Column) -> Column:
    explicit = x["retry_after"].isNotNull()
    repeated = state["last"].isNotNull() & (x["at"] - state["last"] <= REPEAT_SECONDS)
    count = F.when(explicit, F.lit(0)).when(repeated, state["count"] + 1).otherwise(F.lit(1))
    wait = F.when(explicit, x["retry_after"]).when(count >= 2, F.lit(REPEAT_WAIT)).otherwise(F.lit(FIRST_WAIT)).cast("long")
    kind = F.when(explicit, F.when(x["retry_after"] >= LONG_FROM, "provider_long").otherwise("provider_short")).when(count >= 2, "ambiguous_long").otherwise("ambiguous_short")
    return F.struct(
        F.greatest(F.coalesce(state["resume"], F.lit(0).cast("long")), x["at"] + wait).alias("resume"), count.cast("int").alias("count"),
        F.when(explicit, F.lit(None).cast("long")).otherwise(x["at"]).alias("last"), kind.alias("kind"),
    )


def fold(observations: DataFrame) -> DataFrame:
    """(scope, resume, ambiguous_count, cooldown_kind) from observations (scope, at seconds, retry_after or null).

    An explicit delay is taken as it is (short under half an hour) and clears the evidence
    of vague ones. A vague one waits five minutes, and an hour if the one before is at most
    15 minutes old. The time to resume never moves back.
    """
    rows = F.array_sort(F.collect_list(F.struct(F.col("at").cast("long").alias("at"), F.col("retry_after").cast("long").alias("retry_after"))))
    start = F.struct(F.lit(None).cast("long").alias("resume"), F.lit(0).alias("count"), F.lit(None).cast("long").alias("last"), F.lit("").alias("kind"))
    folded = observations.groupBy("scope").agg(F.aggregate(rows, start, _step).alias("s"))
    return folded.select("scope", F.col("s.resume").alias("resume"), F.col("s.count").alias("ambiguous_count"), F.col("s.kind").alias("cooldown_kind"))


def escalations(observations: DataFrame) -> DataFrame:
    """Each vague observation and whether the one before it in its scope is at most 15 minutes old."""
    from pyspark.sql import Window

    before = F.lag("at").over(Window.partitionBy("scope").orderBy("at"))
    return observations.where("retry_after is null").withColumn("repeated", F.coalesce(F.col("at") - before <= REPEAT_SECONDS, F.lit(False)))


def clear_expired(cooldowns: DataFrame, now: Column) -> DataFrame:
    """Vague evidence is forgotten once the cooldown is over."""
    over = F.col("resume") <= now
    return cooldowns.withColumns({"ambiguous_count": F.when(over, 0).otherwise(F.col("ambiguous_count"))})
