"""Maximal-scoring segments and runs, as window functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Running scores at or below this are a reset.
ZERO = 1e-12


def segment_scan(obs: DataFrame, by: list[str], *, step: str = "step", hit: str = "hit", opp: str = "opp", min_llr: float = 3.0, min_opps: int = 3) -> DataFrame:
    """Calls (*by, start, stop, llr, opps, left_amb, right_amb) over rows (*by, pos, step, hit, opp).

    A call is where the running score, which restarts once it falls to 0, first reaches the
    peak of a stretch above 0. With prefix sums S the running score is S - min(0, running
    min of S), so one sort by position serves all windows. hit and opp are 0 or 1; opps
    counts opportunities up to the peak. The ambiguities are the distances from the call's
    edges to the nearest hit outside, or to the end of the rows.
    """
    w = Window.partitionBy(*by).orderBy("pos")
    upto, after, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(1, Window.unboundedFollowing), w.rowsBetween(Window.unboundedPreceding, -1)
    hit_at = F.when(F.col(hit) == 1, F.col("pos"))
    rows = obs.withColumns({
        "__s": F.sum(step).over(upto),
        "__o": F.sum(opp).over(upto),
        "__left": F.col("pos") - F.coalesce(F.last(hit_at, ignorenulls=True).over(before) + 1, F.min("pos").over(upto)),
        "__right": F.coalesce(F.first(hit_at, ignorenulls=True).over(after) - 1, F.last("pos").over(w.rowsBetween(0, Window.unboundedFollowing))) - F.col("pos"),
    })
    rows = rows.withColumn("__r", F.col("__s") - F.least(F.lit(0.0), F.min("__s").over(upto)))
    rows = rows.withColumn("__island", F.sum(F.when(F.col("__r") <= ZERO, 1).otherwise(0)).over(upto)).where(F.col("__r") > ZERO)
    peak = F.max_by(F.struct("pos", "__r", "__o", "__right"), F.struct("__r", -F.col("pos")))
    first = F.min(F.struct("pos", "__left", (F.col("__o") - F.col(opp)).alias("__o")))
    calls = rows.groupBy(*by, "__island").agg(peak.alias("p"), first.alias("f"))
    out = calls.select(*by, F.col("f.pos").alias("start"), (F.col("p.pos") + 1).alias("stop"), F.col("p.__r").alias("llr"), (F.col("p.__o") - F.col("f.__o")).alias("opps"), F.col("f.__left").alias("left_amb"), F.col("p.__right").alias("right_amb"))
    return out.where((F.col("llr") >= min_llr) & (F.col("opps") >= min_opps))


def runs(states: DataFrame, by: list[str], *, state: str = "state", score: Column | None = None) -> DataFrame:
    """Runs of equal state: (*by, state, start, stop[, score: the mean])."""
    w = Window.partitionBy(*by).orderBy("pos")
    change = F.when(F.col(state) == F.lag(state, 1).over(w), 0).otherwise(1)
    rows = states.withColumn("__change", change).withColumn("__run", F.sum("__change").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    more = [] if score is None else [F.avg(score).alias("score")]
    return rows.groupBy(*by, "__run", state).agg(F.min("pos").alias("start"), (F.max("pos") + 1).alias("stop"), *more).drop("__run")


def smoothed_rate(obs: DataFrame, by: list[str], half: int = 10, *, hit: str = "hit", opp: str = "opp") -> DataFrame:
    """Adds ``rate``: hits per opportunity in a centred frame of 2 * half + 1 rows, null without any."""
    w = Window.partitionBy(*by).orderBy("pos").rowsBetween(-half, half)
    return obs.withColumn("rate", F.sum(hit).over(w).cast("double") / F.nullif(F.sum(opp).over(w), F.lit(0)))


def footprints(states: DataFrame, by: list[str], *, state: str = "state", score: Column | None = None) -> DataFrame:
    """(*by, start, stop[, score]): runs of state 0, with the mean score of each."""
    found = runs(states, by, state=state, score=score).where(F.col(state) == 0)
    return found.select(*by, "start", "stop", *([] if score is None else ["score"]))


def call_sums(calls: DataFrame, by: list[str]) -> DataFrame:
    """(*by, n, llr, opps, longest) of calls."""
    return calls.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum("llr").alias("llr"), F.sum("opps").alias("opps"), F.max(F.col("stop") - F.col("start")).alias("longest"))
