"""Named queries over the driver's tables, each beside the SQL that gives the same rows."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from molspan.functions import chain
from molspan.functions import sequences as S
from molspan.functions.marks import to_lists
from molspan.operators import contexts, duplicates, intervals, reads, segments
from molspan.operators.similarity import mix64
from molspan.session import cut, map_batches
from molspan.streaming import flow

from .bridge import CONTIGS, INTERVALS, MODEL, OBS, READS, coded_reads, seqs_sql, table
from .bridge import contigs as contigs_of
from .bridge import intervals as intervals_of
from .bridge import obs as obs_of
from .bridge import reads as reads_of
from .bridge import seqs as seqs_of

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})


# Segments and runs

SCAN = f"""
WITH {OBS},
a AS (SELECT *, sum(step) OVER w AS s, sum(opp) OVER w AS o, min(pos) OVER w AS lo, max(pos) OVER (PARTITION BY read_id) AS hi,
    max(CASE WHEN hit = 1 THEN pos END) OVER (PARTITION BY read_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lh,
    min(CASE WHEN hit = 1 THEN pos END) OVER (PARTITION BY read_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS rh
  FROM obs WINDOW w AS (PARTITION BY read_id ORDER BY pos ROWS UNBOUNDED PRECEDING)),
b AS (SELECT *, s - least(0.0, min(s) OVER (PARTITION BY read_id ORDER BY pos ROWS UNBOUNDED PRECEDING)) AS r FROM a),
c AS (SELECT *, sum(CASE WHEN r <= 1e-12 THEN 1 ELSE 0 END) OVER (PARTITION BY read_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS island FROM b),
d AS (SELECT *, row_number() OVER (PARTITION BY read_id, island ORDER BY pos) AS f, row_number() OVER (PARTITION BY read_id, island ORDER BY r DESC, pos) AS p FROM c WHERE r > 1e-12),
calls AS (SELECT x.read_id, x.pos AS start, y.pos + 1 AS stop, y.r AS llr, CAST(y.o - x.o + x.opp AS BIGINT) AS opps,
    x.pos - coalesce(x.lh + 1, 0) AS left_amb, coalesce(y.rh - 1, y.hi) - y.pos AS right_amb
  FROM d x JOIN d y ON x.read_id = y.read_id AND x.island = y.island AND x.f = 1 AND y.p = 1
  WHERE y.r >= 3.0 AND y.o - x.o + x.opp >= 3)
"""


def scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.segment_scan(obs_of(spark, sf_dir), ["read_id"])


@query("q_iv08_segments", SCAN + "SELECT * FROM calls")
def iv08(spark, sf_dir):
    return scan(spark, sf_dir)


@query("q_fn23_call_bytes", SCAN + """SELECT read_id, start, CAST(least(255, greatest(0, round_even(llr * 10, 0))) AS INT) AS tq,
  CASE WHEN left_amb <= 0 THEN 255 WHEN left_amb >= 30 THEN 0 ELSE CAST(round_even(255 * (1 - left_amb / 30.0::DOUBLE), 0) AS INT) END AS el,
  CASE WHEN right_amb <= 0 THEN 255 WHEN right_amb >= 30 THEN 0 ELSE CAST(round_even(255 * (1 - right_amb / 30.0::DOUBLE), 0) AS INT) END AS er FROM calls""")  # fmt: skip
def fn23(spark, sf_dir):
    return scan(spark, sf_dir).select("read_id", "start", S.llr_byte(F.col("llr")).alias("tq"), S.edge_byte(F.col("left_amb")).alias("el"), S.edge_byte(F.col("right_amb")).alias("er"))


@query("q_flt10_strong_calls", SCAN + "SELECT read_id, count(*) AS n, max(llr) AS best FROM calls WHERE least(255, greatest(0, round_even(llr * 10, 0))) >= 50 GROUP BY read_id")
def flt10(spark, sf_dir):
    return scan(spark, sf_dir).where(S.llr_byte(F.col("llr")) >= 50).groupBy("read_id").agg(F.count(F.lit(1)).alias("n"), F.max("llr").alias("best"))


@query("q_iv15_smoothed_rate", f"""WITH {OBS} SELECT read_id, pos, round(CAST(sum(hit) OVER w AS DOUBLE) / nullif(sum(opp) OVER w, 0), 6) AS rate
  FROM obs WINDOW w AS (PARTITION BY read_id ORDER BY pos ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING)""")
def iv15(spark, sf_dir):
    return rounded(segments.smoothed_rate(obs_of(spark, sf_dir), ["read_id"]).select("read_id", "pos", "rate"), "rate")


@query("q_wn02_runs", f"""WITH {OBS}, a AS (SELECT *, CASE WHEN hit = lag(hit) OVER (PARTITION BY read_id ORDER BY pos) THEN 0 ELSE 1 END AS c FROM obs),
b AS (SELECT *, sum(c) OVER (PARTITION BY read_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS run FROM a)
SELECT read_id, hit AS state, min(pos) AS start, max(pos) + 1 AS stop FROM b GROUP BY read_id, run, hit""")
def wn02(spark, sf_dir):
    return segments.runs(obs_of(spark, sf_dir).withColumn("state", F.col("hit")), ["read_id"]).select("read_id", "state", "start", "stop")


# The chain

E0 = "CASE code WHEN 0 THEN 0.04 WHEN 1 THEN 0.06 WHEN 3 THEN 0.96 WHEN 4 THEN 0.94 ELSE 1.0 END::DOUBLE"
E1 = "CASE code WHEN 0 THEN 0.75 WHEN 1 THEN 0.85 WHEN 3 THEN 0.25 WHEN 4 THEN 0.15 ELSE 1.0 END::DOUBLE"
LOGS = "ln(0.05::DOUBLE) - ln(0.95::DOUBLE)", "ln(0.95::DOUBLE) - ln(0.05::DOUBLE)"
VITERBI = f"""
WITH RECURSIVE {OBS}, e AS (SELECT read_id, pos, ln({E1}) - ln({E0}) AS de FROM obs),
v AS (SELECT read_id, pos, de AS d FROM e WHERE pos = 0
  UNION ALL SELECT e.read_id, e.pos, greatest({LOGS[0]}, least({LOGS[1]}, v.d)) + e.de FROM v JOIN e ON e.read_id = v.read_id AND e.pos = v.pos + 1),
f AS (SELECT read_id, pos, CASE WHEN lead(pos) OVER (PARTITION BY read_id ORDER BY pos) IS NULL THEN CASE WHEN d > 0 THEN 1 ELSE 0 END
  WHEN d > {LOGS[1]} THEN 1 WHEN d <= {LOGS[0]} THEN 0 END AS forced FROM v),
st AS (SELECT read_id, pos, first_value(forced IGNORE NULLS) OVER (PARTITION BY read_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS state FROM f),
ch AS (SELECT *, CASE WHEN state = lag(state) OVER (PARTITION BY read_id ORDER BY pos) THEN 0 ELSE 1 END AS c FROM st),
rn AS (SELECT *, sum(c) OVER (PARTITION BY read_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS run FROM ch),
runs AS (SELECT read_id, state, min(pos) AS start, max(pos) + 1 AS stop FROM rn GROUP BY read_id, run, state)
"""


def states_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(read_id, pos, state)."""
    found = chain.run_chain(coded_reads(spark, sf_dir), MODEL, want="states")
    return found.select("read_id", F.posexplode("states").alias("pos", "state")).select("read_id", F.col("pos").cast("long").alias("pos"), F.col("state").cast("int").alias("state"))


@query("q_hmm01_viterbi", VITERBI + "SELECT read_id, pos, state FROM st")
def hmm01(spark, sf_dir):
    return states_of(spark, sf_dir)


@query("q_iv01_footprints", VITERBI + "SELECT read_id, start, stop FROM runs WHERE state = 0")
def iv01(spark, sf_dir):
    return segments.runs(states_of(spark, sf_dir), ["read_id"]).where("state = 0").select("read_id", "start", "stop")


@query("q_iv04_msps", VITERBI + """, nuc AS (SELECT * FROM runs WHERE state = 0 AND stop - start >= 8),
span AS (SELECT read_id, 0 AS lo, max(pos) + 1 AS hi FROM obs GROUP BY read_id),
g AS (SELECT s.read_id, coalesce(lag(stop) OVER (PARTITION BY s.read_id ORDER BY start), lo) AS a, coalesce(start, hi) AS b, hi, stop FROM span s LEFT JOIN nuc n ON n.read_id = s.read_id),
m AS (SELECT read_id, a AS start, b AS stop FROM g UNION ALL SELECT read_id, max(stop), max(hi) FROM g WHERE stop IS NOT NULL GROUP BY read_id)
SELECT read_id, start, stop FROM m WHERE stop - start >= 5""")
def iv04(spark, sf_dir):
    states = cut(states_of(spark, sf_dir))
    nucs = segments.runs(states, ["read_id"]).where("state = 0 AND stop - start >= 8").select("read_id", "start", "stop")
    span = states.groupBy("read_id").agg(F.lit(0).cast("long").alias("lo"), (F.max("pos") + 1).alias("hi"))
    return intervals.complement(nucs, ["read_id"], span, 5)


PAIR = "ln(exp({0} - greatest({0}, {1})) + exp({1} - greatest({0}, {1}))) + greatest({0}, {1})"
STAY, MOVE = "ln(0.95::DOUBLE)", "ln(0.05::DOUBLE)"
FORWARD = f"""
WITH RECURSIVE {OBS}, e AS (SELECT read_id, pos, ln({E0}) AS e0, ln({E1}) AS e1, max(pos) OVER (PARTITION BY read_id) AS last FROM obs),
al AS (SELECT read_id, pos, ln(0.5::DOUBLE) + e0 AS a0, ln(0.5::DOUBLE) + e1 AS a1, last FROM e WHERE pos = 0
  UNION ALL SELECT e.read_id, e.pos, {PAIR.format(f'(al.a0 + {STAY})', f'(al.a1 + {MOVE})')} + e.e0, {PAIR.format(f'(al.a0 + {MOVE})', f'(al.a1 + {STAY})')} + e.e1, e.last
  FROM al JOIN e ON e.read_id = al.read_id AND e.pos = al.pos + 1),
be AS (SELECT read_id, pos, 0.0::DOUBLE AS b0, 0.0::DOUBLE AS b1 FROM e WHERE pos = last
  UNION ALL SELECT n.read_id, n.pos - 1, {PAIR.format(f'({STAY} + n.e0 + be.b0)', f'({MOVE} + n.e1 + be.b1)')}, {PAIR.format(f'({MOVE} + n.e0 + be.b0)', f'({STAY} + n.e1 + be.b1)')}
  FROM be JOIN e n ON n.read_id = be.read_id AND n.pos = be.pos AND n.pos > 0),
tot AS (SELECT read_id, {PAIR.format('a0', 'a1')} AS total FROM al WHERE pos = last)
"""


@query("q_hmm07_score", FORWARD + "SELECT read_id, round(total, 6) AS score FROM tot")
def hmm07(spark, sf_dir):
    return rounded(chain.run_chain(coded_reads(spark, sf_dir), MODEL, want="score"), "score")


@query("q_hmm04_posterior", FORWARD + "SELECT al.read_id, al.pos, round(1 / (1 + exp(a0 + b0 - a1 - b1)), 6) AS p FROM al JOIN be ON al.read_id = be.read_id AND al.pos = be.pos")
def hmm04(spark, sf_dir):
    found = chain.run_chain(coded_reads(spark, sf_dir), MODEL, want="posterior")
    out = found.select("read_id", F.posexplode("posterior").alias("pos", "p"))
    return rounded(out.withColumn("pos", F.col("pos").cast("long")), "p")


@query("q_hmm08_em_step", FORWARD + f""", x AS (SELECT
    sum(exp(al.a0 + {STAY} + n.e0 + be.b0 - total)) AS x00, sum(exp(al.a0 + {MOVE} + n.e1 + be.b1 - total)) AS x01,
    sum(exp(al.a1 + {MOVE} + n.e0 + be.b0 - total)) AS x10, sum(exp(al.a1 + {STAY} + n.e1 + be.b1 - total)) AS x11
  FROM al JOIN e n ON n.read_id = al.read_id AND n.pos = al.pos + 1 JOIN be ON be.read_id = n.read_id AND be.pos = n.pos JOIN tot ON tot.read_id = al.read_id),
g AS (SELECT sum(exp(a0 + b0 - total)) AS g0, sum(exp(a1 + b1 - total)) AS g1 FROM al JOIN be ON al.read_id = be.read_id AND al.pos = be.pos JOIN tot ON tot.read_id = al.read_id WHERE al.pos = 0)
SELECT round(g0 / (g0 + g1), 6) AS start0, round(x00 / (x00 + x01), 6) AS stay0, round(x11 / (x10 + x11), 6) AS stay1, round((SELECT sum(total) FROM tot), 4) AS score FROM x, g""")
def hmm08(spark, sf_dir):
    model, score = chain.train_step(coded_reads(spark, sf_dir), MODEL)
    rows = [(round(model.start[0], 6), round(model.stay[0], 6), round(model.stay[1], 6), round(score, 4))]
    return spark.createDataFrame(rows, "start0 double, stay0 double, stay1 double, score double")


# Intervals

MERGED = f"""
WITH {INTERVALS},
m1 AS (SELECT *, max(stop) OVER (PARTITION BY read_id ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM iv),
m2 AS (SELECT *, sum(CASE WHEN far IS NULL OR start > far THEN 1 ELSE 0 END) OVER (PARTITION BY read_id ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS island FROM m1),
merged AS (SELECT read_id, min(start) AS start, max(stop) AS stop, count(*) AS n FROM m2 GROUP BY read_id, island)
"""


@query("q_iv02_merge", MERGED + "SELECT * FROM merged")
def iv02(spark, sf_dir):
    return intervals.merge(intervals_of(spark, sf_dir), ["read_id"])


@query("q_so03_complement", MERGED + """, g AS (SELECT *, lead(start) OVER (PARTITION BY read_id ORDER BY start) AS nxt, row_number() OVER (PARTITION BY read_id ORDER BY start) AS k FROM merged)
SELECT read_id, start, stop FROM (SELECT read_id, stop AS start, coalesce(nxt, 600) AS stop FROM g UNION ALL SELECT read_id, 0, start FROM g WHERE k = 1) WHERE stop > start""")
def so03(spark, sf_dir):
    merged = cut(intervals.merge(intervals_of(spark, sf_dir), ["read_id"]))
    span = merged.select("read_id").distinct().select("read_id", F.lit(0).cast("long").alias("lo"), F.lit(600).cast("long").alias("hi"))
    return intervals.complement(merged.drop("n"), ["read_id"], span)


@query("q_iv07_scan_space", f"""WITH {INTERVALS},
c AS (SELECT read_id, greatest(start, 0) AS start, least(stop, 450) AS stop FROM iv WHERE kind = 'tf' OR stop - start < 20),
k AS (SELECT * FROM c WHERE stop > start),
m1 AS (SELECT *, max(stop) OVER (PARTITION BY read_id ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM k),
m2 AS (SELECT *, sum(CASE WHEN far IS NULL OR start > far THEN 1 ELSE 0 END) OVER (PARTITION BY read_id ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS island FROM m1)
SELECT read_id, min(start) AS start, max(stop) AS stop, count(*) AS n FROM m2 GROUP BY read_id, island""")
def iv07(spark, sf_dir):
    rows = intervals_of(spark, sf_dir).select("read_id", "start", "stop", "kind")
    tf, nuc = rows.where("kind = 'tf'").drop("kind"), rows.where("kind = 'nuc'").drop("kind")
    return intervals.scan_space(tf, nuc, ["read_id"], short=20, length=F.lit(450))


@query("q_iv25_unify", f"""WITH {INTERVALS} SELECT read_id, start, stop FROM iv n WHERE kind = 'nuc' AND (stop - start >= 30 OR NOT EXISTS (
  SELECT 1 FROM iv t WHERE t.kind = 'tf' AND t.read_id = n.read_id AND t.start < n.stop AND t.stop > n.start))""")
def iv25(spark, sf_dir):
    rows = intervals_of(spark, sf_dir).select("read_id", "start", "stop", "kind")
    return intervals.unify(rows.where("kind = 'nuc'").drop("kind"), rows.where("kind = 'tf'").drop("kind"), ["read_id"], short=30)


@query("q_iv22_tiling", f"""WITH RECURSIVE {INTERVALS},
o AS (SELECT read_id, start, stop, row_number() OVER (PARTITION BY read_id ORDER BY start, stop DESC) AS k FROM iv),
t AS (SELECT read_id, k, start, stop, start AS s, CASE WHEN stop - start >= 10 THEN stop END AS last, stop - start >= 10 AS fits FROM o WHERE k = 1
  UNION ALL SELECT o.read_id, o.k, o.start, o.stop, greatest(o.start, coalesce(t.last, o.start)),
    CASE WHEN o.stop - greatest(o.start, coalesce(t.last, o.start)) >= 10 THEN o.stop ELSE t.last END,
    o.stop - greatest(o.start, coalesce(t.last, o.start)) >= 10 FROM t JOIN o ON o.read_id = t.read_id AND o.k = t.k + 1)
SELECT read_id, s AS start, stop, s > start AS clipped FROM t WHERE fits""")
def iv22(spark, sf_dir):
    return intervals.tile(intervals_of(spark, sf_dir), ["read_id"], least=10)


@query("q_fn28_circular_split", f"""WITH {INTERVALS}, c AS (SELECT read_id, kind, score, start % 400 AS s, least(stop - start, 400) AS n FROM iv WHERE stop > start)
SELECT read_id, kind, score, 0 AS piece, s AS start, least(n, 400 - s) AS n FROM c UNION ALL SELECT read_id, kind, score, 1, 0, n - (400 - s) FROM c WHERE n > 400 - s""")
def fn28(spark, sf_dir):
    rows = intervals_of(spark, sf_dir).withColumn("n", F.col("stop") - F.col("start")).drop("stop")
    return intervals.split_circular(rows, F.lit(400).cast("long")).select("read_id", "kind", "score", "piece", "start", "n")


@query("q_jn07_circular_anti", f"""WITH {INTERVALS}, c AS (SELECT read_id, kind, score, start AS orig, start % 200 AS s, least(stop - start, 200) AS n FROM iv),
p AS (SELECT read_id, kind, score, orig, s AS start, s + least(n, 200 - s) AS stop FROM c UNION ALL SELECT read_id, kind, score, orig, 0, n - (200 - s) FROM c WHERE n > 200 - s)
SELECT DISTINCT read_id, score, orig FROM c WHERE kind = 'nuc' AND NOT EXISTS (SELECT 1 FROM p a JOIN p b ON a.read_id = b.read_id AND a.kind = 'nuc' AND b.kind = 'tf' AND b.start < a.stop AND b.stop > a.start
  WHERE a.read_id = c.read_id AND a.score = c.score AND a.orig = c.orig)""")
def jn07(spark, sf_dir):
    rows = intervals_of(spark, sf_dir).withColumns({"n": F.col("stop") - F.col("start"), "orig": F.col("start")}).drop("stop")
    pieces = intervals.split_circular(rows, F.lit(200).cast("long")).withColumn("stop", F.col("start") + F.col("n")).drop("piece", "n")
    nuc, tf = pieces.where("kind = 'nuc'"), pieces.where("kind = 'tf'")
    clear = intervals.without_overlap(nuc, tf, ["read_id"])
    # a circle's interval is clear if all of its pieces are
    whole = nuc.groupBy("read_id", "score", "orig").agg(F.count(F.lit(1)).alias("all"))
    some = clear.groupBy("read_id", "score", "orig").agg(F.count(F.lit(1)).alias("left"))
    return whole.join(some, ["read_id", "score", "orig"]).where(F.col("all") == F.col("left")).select("read_id", "score", "orig")


@query("q_jn16_overlap", f"""WITH {INTERVALS}, r AS (SELECT DISTINCT l_orderkey AS read_id, l_suppkey % 5 AS region, (l_suppkey % 5) * 100 AS r_start, (l_suppkey % 5) * 100 + 60 AS r_stop FROM lineitem)
SELECT iv.read_id, region, count(*) AS n, sum(least(stop, r_stop) - greatest(start, r_start))::BIGINT AS bases FROM iv JOIN r ON r.read_id = iv.read_id AND stop > r_start AND start < r_stop GROUP BY 1, 2""")
def jn16(spark, sf_dir):
    regions = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("read_id"), (F.col("l_suppkey") % 5).alias("region")).distinct()
    regions = regions.withColumns({"r_start": F.col("region") * 100, "r_stop": F.col("region") * 100 + 60})
    met = intervals.overlap(intervals_of(spark, sf_dir), regions, key="read_id", width=128)
    return met.groupBy("read_id", "region").agg(F.count(F.lit(1)).alias("n"), F.sum(F.least("stop", "r_stop") - F.greatest("start", "r_start")).alias("bases"))


NRL = f"WITH {INTERVALS}, g AS (SELECT lead((start + stop) / 2) OVER (PARTITION BY read_id ORDER BY start, stop) - (start + stop) / 2 AS gap FROM iv), u AS (SELECT gap FROM g WHERE gap BETWEEN 120 AND 260)"


@query("q_iv29_nrl", NRL + """, b AS (SELECT CAST(floor((gap - 120) / 10) AS BIGINT) AS bin, count(*) AS c FROM u GROUP BY 1), m AS (SELECT bin AS mode_bin FROM b ORDER BY c DESC, bin LIMIT 1)
SELECT n, mode_bin, median_gap, CASE WHEN n < 300 THEN 185.0 ELSE round_even(greatest(150.0, least(215.0, 0.5 * (120 + mode_bin * 10 + 5 + median_gap))), 0) END::DOUBLE AS nrl
FROM (SELECT count(*) AS n, median(gap) AS median_gap FROM u), m""")
def iv29(spark, sf_dir):
    return intervals.repeat_length(intervals.spacing(intervals_of(spark, sf_dir), ["read_id"]))


@query("q_snk04_bed12", f"""WITH {INTERVALS}, pl AS (SELECT o_orderkey AS read_id, 'chr' || (o_custkey % 7) AS chrom, CASE WHEN o_orderstatus = 'F' THEN '-' ELSE '+' END AS strand FROM orders),
iw AS (SELECT iv.*, chrom, strand, min(start) OVER (PARTITION BY iv.read_id) AS lo, last_value(stop) OVER (PARTITION BY iv.read_id ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS hi FROM iv JOIN pl ON pl.read_id = iv.read_id)
SELECT read_id, concat_ws(chr(9), chrom, lo, hi, read_id, CAST(trunc(avg(score)) AS INT), strand, lo, hi, '0', count(*),
  string_agg(CAST(stop - start AS VARCHAR), ',' ORDER BY start, stop), string_agg(CAST(start - lo AS VARCHAR), ',' ORDER BY start, stop)) AS line FROM iw GROUP BY read_id, chrom, strand, lo, hi""")
def snk04(spark, sf_dir):
    strand = F.when(F.col("o_orderstatus") == "F", "-").otherwise("+")
    places = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("read_id"), F.concat(F.lit("chr"), F.col("o_custkey") % 7).alias("chrom"), strand.alias("strand"))
    return reads.bed12(intervals_of(spark, sf_dir).join(places, "read_id"), ["read_id"])


@query("q_fn29_annotations", f"""WITH {INTERVALS} SELECT read_id, concat_ws(';', '600', 'nuc.Q:' || string_agg(CASE WHEN kind = 'nuc' THEN (start + 1) || '-' || (stop - start) END, ',' ORDER BY start, stop),
  'tf.QQQ:' || string_agg(CASE WHEN kind = 'tf' THEN (start + 1) || '-' || (stop - start) END, ',' ORDER BY start, stop)) AS ma FROM iv GROUP BY read_id""")
def fn29(spark, sf_dir):
    return annotated(spark, sf_dir)


def annotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = F.struct("start", (F.col("stop") - F.col("start")).alias("n"))
    rows = intervals_of(spark, sf_dir).groupBy("read_id").agg(*[F.sort_array(F.collect_list(F.when(F.col("kind") == k, item))).alias(k) for k in ("nuc", "tf")])
    return rows.select("read_id", S.annotation_text(F.lit(600), [("nuc.Q", F.col("nuc")), ("tf.QQQ", F.col("tf"))]).alias("ma"))


@query("q_fn30_annotations_back", f"WITH {INTERVALS} SELECT read_id, kind, CASE WHEN kind = 'nuc' THEN 'Q' ELSE 'QQQ' END AS quals, start, stop - start AS n FROM iv")
def fn30(spark, sf_dir):
    return annotated(spark, sf_dir).select("read_id", F.explode(S.parse_annotations(F.col("ma"))).alias("a")).select("read_id", "a.kind", "a.quals", "a.start", "a.n")


@query("q_fn26_flip", f"WITH {INTERVALS} SELECT read_id, score, 600 - stop AS start, stop - start AS n FROM iv")
def fn26(spark, sf_dir):
    n = F.col("stop") - F.col("start")
    return intervals_of(spark, sf_dir).select("read_id", "score", S.flip(F.col("start"), n, F.lit(600)).alias("start"), n.alias("n"))


@query("q_ag22_projection", f"WITH {INTERVALS} SELECT pos, count(*) AS depth, max(score) AS top, round(avg(score), 6) AS mean FROM (SELECT unnest(range(start, stop)) AS pos, score FROM iv) GROUP BY pos")
def ag22(spark, sf_dir):
    return rounded(intervals.depth(intervals_of(spark, sf_dir), "score"), "mean")


@query("q_ag10_stats", f"""WITH {INTERVALS} SELECT kind, count(v) AS n, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, min(v) AS least, quantile_cont(v, 0.25) AS q25,
  quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS q75, max(v) AS greatest FROM (SELECT kind, stop - start AS v FROM iv) GROUP BY kind""")
def ag10(spark, sf_dir):
    rows = intervals_of(spark, sf_dir).withColumn("v", F.col("stop") - F.col("start"))
    return rounded(reads.summary(rows, "v", ["kind"]), "mean", "std")


# Sequences and contexts


@query("q_fn16_revcomp", f"WITH {seqs_sql()} SELECT read_id, reverse(translate(seq, 'ACGTacgtNn', 'TGCAtgcaNn')) AS rc FROM seqs")
def fn16(spark, sf_dir):
    return seqs_of(spark, sf_dir).select("read_id", S.reverse_complement(F.col("seq")).alias("rc"))


@query("q_fn13_ambiguity", f"""WITH {seqs_sql('ACGTRY')} SELECT read_id, seq SIMILAR TO '.*[RY].*' AS has, translate(seq, 'YR', 'TA') AS bases,
  CASE WHEN y > r THEN '+' WHEN r > y THEN '-' ELSE '.' END AS strand FROM (SELECT *, length(seq) - length(replace(seq, 'Y', '')) AS y, length(seq) - length(replace(seq, 'R', '')) AS r FROM seqs)""")
def fn13(spark, sf_dir):
    s = F.col("seq")
    return seqs_of(spark, sf_dir, "ACGTRY").select("read_id", S.has_ambiguity(s).alias("has"), S.resolve_ambiguity(s).alias("bases"), S.strand_of(S.count_sign(s, "Y"), S.count_sign(s, "R")).alias("strand"))


MARK = "(pos * 7 + read_id) % 5 = 0"
COUNTS = f"""
WITH {seqs_sql()}, p AS (SELECT read_id, seq, unnest(range(2, length(seq) - 2)) AS pos FROM seqs),
q AS (SELECT substr(seq, CAST(pos - 1 AS INT), 5) AS context, CASE WHEN {MARK} THEN 1 ELSE 0 END AS hit FROM p WHERE substr(seq, CAST(pos + 1 AS INT), 1) = 'A'),
cc AS (SELECT context, sum(hit)::BIGINT AS hit, sum(1 - hit)::BIGINT AS nohit FROM q GROUP BY context)
"""


def counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contexts.context_counts(seqs_of(spark, sf_dir), k=2, marked=(F.col("pos") * 7 + F.col("read_id")) % 5 == 0)


@query("q_ag01_context_counts", COUNTS + "SELECT * FROM cc")
def ag01(spark, sf_dir):
    return counted(spark, sf_dir)


@query("q_ag03_rollup_k", COUNTS + "SELECT k, substr(context, 3 - k, 2 * k + 1) AS context, sum(hit)::BIGINT AS hit, sum(nohit)::BIGINT AS nohit, round(sum(hit)::DOUBLE / sum(hit + nohit), 6) AS ratio FROM cc, (SELECT unnest([1, 2]) AS k) GROUP BY 1, 2")
def ag03(spark, sf_dir):
    return rounded(contexts.trim_contexts(counted(spark, sf_dir), 2, [1, 2]), "ratio")


@query("q_ag04_dense_code", COUNTS + "SELECT *, dense_rank() OVER (ORDER BY context) - 1 AS encode FROM cc")
def ag04(spark, sf_dir):
    return contexts.dense_codes(counted(spark, sf_dir))


@query("q_fn19_positional_code", COUNTS + """SELECT context, (strpos('ACTG', substr(context, 1, 1)) - 1) * 64 + (strpos('ACTG', substr(context, 2, 1)) - 1) * 16
  + (strpos('ACTG', substr(context, 4, 1)) - 1) * 4 + strpos('ACTG', substr(context, 5, 1)) - 1 AS code FROM cc""")
def fn19(spark, sf_dir):
    return counted(spark, sf_dir).select("context", contexts.positional_code(F.col("context"), 2).alias("code"))


TABLES = COUNTS + """, a AS (SELECT context, hit::DOUBLE / (hit + nohit) AS p_acc FROM cc WHERE hit > 0), b AS (SELECT context, nohit::DOUBLE / (hit + nohit) * 0.1::DOUBLE AS p_prot FROM cc WHERE nohit > 0),
t AS (SELECT coalesce(a.context, b.context) AS context, coalesce(p_acc, 0) AS p_acc, coalesce(p_prot, 0) AS p_prot FROM a FULL JOIN b ON a.context = b.context)
"""


def tables_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = counted(spark, sf_dir)
    protected = c.where("nohit > 0").select("context", (F.col("nohit") * F.lit(0.1)).alias("hit"), (F.col("hit") + F.col("nohit") * F.lit(0.9)).alias("nohit"))
    return contexts.joined_tables(c.where("hit > 0"), protected)


@query("q_hmm13_emissions", TABLES + "SELECT context, round(p_acc, 6) AS p_acc, round(p_prot, 6) AS p_prot FROM t")
def hmm13(spark, sf_dir):
    return rounded(tables_of(spark, sf_dir), "p_acc", "p_prot")


@query("q_hmm16_llr", TABLES + """SELECT context, round(ln(greatest(p_prot, 1e-30)) - ln(greatest(p_acc, 1e-30)), 6) AS llr_hit,
  round(ln(greatest(1 - p_prot, 1e-30)) - ln(greatest(1 - p_acc, 1e-30)), 6) AS llr_miss FROM t""")
def hmm16(spark, sf_dir):
    return rounded(contexts.log_ratios(tables_of(spark, sf_dir)).select("context", "llr_hit", "llr_miss"), "llr_hit", "llr_miss")


@query("q_hmm17_uplift", TABLES + "SELECT context, round(1 - pow(1 - p_acc, 2.0), 6) AS p_acc, round(pow(p_prot, 2.0), 6) AS p_prot FROM t")
def hmm17(spark, sf_dir):
    return rounded(contexts.uplift(tables_of(spark, sf_dir), 2.0), "p_acc", "p_prot")


@query("q_ag08_weighted_line", f"""WITH {INTERVALS}, r AS (SELECT score AS x, (stop - start)::DOUBLE AS y, sqrt(1 + start) AS w FROM iv),
s AS (SELECT sum(w) AS w, sum(w * x) AS wx, sum(w * y) AS wy, sum(w * x * x) AS wxx, sum(w * x * y) AS wxy, sum(w * y * y) AS wyy, count(*) AS n FROM r),
l AS (SELECT *, (w * wxy - wx * wy) / (w * wxx - wx * wx) AS slope FROM s), i AS (SELECT *, (wy - slope * wx) / w AS intercept FROM l)
SELECT round(intercept, 4) AS intercept, round(slope, 6) AS slope, round(1 - (wyy - intercept * wy - slope * wxy) / (wyy - wy * wy / w), 6) AS r2, n FROM i""")
def ag08(spark, sf_dir):
    rows = intervals_of(spark, sf_dir).select(F.col("score").cast("double").alias("x"), (F.col("stop") - F.col("start")).cast("double").alias("y"), F.sqrt(1 + F.col("start")).alias("w"))
    return rounded(rounded(contexts.weighted_line(rows, "x", "y", "w"), "intercept", places=4), "slope", "r2")


@query("q_fn01_mm_roundtrip", f"WITH {OBS} SELECT read_id, row_number() OVER (PARTITION BY read_id ORDER BY pos) - 1 AS k, pos FROM obs WHERE hit = 1")
def fn01(spark, sf_dir):
    hits = obs_of(spark, sf_dir).where("hit = 1")
    w = Window.partitionBy("read_id").orderBy("pos")
    skips = hits.withColumn("skip", F.col("pos") - F.coalesce(F.lag("pos").over(w), F.lit(-1)) - 1)
    text = skips.groupBy("read_id").agg(F.concat(F.lit("A+a,"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "skip"))), lambda x: x["skip"].cast("string")), ","), F.lit(";")).alias("mm"))
    found = text.withColumn("at", S.mark_ordinals(S.parse_skips(F.col("mm")))).select("read_id", F.posexplode("at").alias("k", "pos"))
    return found.withColumn("k", F.col("k").cast("long"))


@query("q_fn25_unit_byte", "SELECT l_orderkey, l_linenumber, CAST(trunc(least(greatest(l_discount * 255, 0), 255)) AS INT) AS u8 FROM lineitem")
def fn25(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", S.unit_byte(F.col("l_discount")).alias("u8"))


# Reads, regions, samples

REASON = "CASE WHEN unmapped THEN 'unmapped' WHEN secondary THEN 'secondary_supplementary' WHEN mapq < 20 THEN 'low_mapq' WHEN length IS NULL OR length < 20000 THEN 'too_short' WHEN trained THEN 'training_excluded' END"


def reasoned(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    reason = reads.skip_reason(unmapped=c("unmapped"), secondary=c("secondary"), mapq=c("mapq"), length=c("length"), trained=c("trained"), min_length=20000)
    return reads_of(spark, sf_dir).withColumn("reason", reason)


@query("q_flt01_skip_reason", f"WITH {READS} SELECT read_id, {REASON} AS reason FROM reads")
def flt01(spark, sf_dir):
    return reasoned(spark, sf_dir).select("read_id", "reason")


@query("q_ag11_skip_counts", f"WITH {READS} SELECT {REASON} AS reason, count(*) AS n FROM reads GROUP BY 1")
def ag11(spark, sf_dir):
    return reasoned(spark, sf_dir).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("q_jn05_train_anti", f"WITH {READS} SELECT read_id FROM reads WHERE NOT trained")
def jn05(spark, sf_dir):
    trained = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey")
    orders = table(spark, sf_dir, "orders")
    return orders.join(trained, orders.o_custkey == trained.c_custkey, "left_anti").select(F.col("o_orderkey").alias("read_id"))


@query("q_src06_regions", f"WITH {CONTIGS} SELECT chrom, CAST(r // 4000 AS INT) AS region, r AS r_start, least(r + 4000, length) AS r_stop FROM (SELECT *, unnest(range(0, length, 4000)) AS r FROM contigs)")
def src06(spark, sf_dir):
    return reads.regions(contigs_of(spark, sf_dir), 4000)


@query("q_src07_main_chrom", "SELECT n_name, regexp_matches(regexp_replace(upper('chr' || n_nationkey), '^CHR', ''), '^([0-9]{1,2}[LR]?|[XYZWM]|MT|[IVX]{1,5})$') AS main FROM nation")
def src07(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_name", S.main_chromosome(F.concat(F.lit("chr"), F.col("n_nationkey").cast("string"))).alias("main"))


@query("q_jn17_region_assign", f"WITH {INTERVALS} SELECT CAST(start // 64 AS INT) AS region, count(*) AS n, sum(stop - start)::BIGINT AS bases FROM iv GROUP BY 1")
def jn17(spark, sf_dir):
    rows = intervals_of(spark, sf_dir).withColumn("region", reads.region_of(F.col("start"), 64))
    return rows.groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("stop") - F.col("start")).alias("bases"))


@query("q_st09_sample", "SELECT o_orderkey AS read_id FROM orders ORDER BY md5('5:' || o_orderkey), o_orderkey LIMIT 100")
def st09(spark, sf_dir):
    return reads.sample(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("read_id")), "read_id", 100, 5)


@query("q_src18_quota", "SELECT o_orderpriority, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5('6:' || o_orderkey), o_orderkey) AS k FROM orders) WHERE k <= 40")
def src18(spark, sf_dir):
    return reads.quota(table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderkey"), "o_orderpriority", "o_orderkey", 40, 6)


@query("q_ag15_representative", "SELECT o_custkey AS di, arg_max(o_orderkey, row(o_totalprice, -o_orderkey)) AS representative, count(*) AS n FROM orders GROUP BY 1")
def ag15(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("di"), F.col("o_orderkey").alias("id"), "o_totalprice")
    return duplicates.representatives(rows, "di", [F.col("o_totalprice")], "id")


CLUSTERS = r"""
WITH RECURSIVE w AS (SELECT doc_id, lang, regexp_extract_all(lower(text), '[^ \t\n\x0B\f\r]+') AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, lang, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS s FROM (SELECT *, unnest(range(1, len(ws) - 1)) AS i FROM w)),
n AS MATERIALIZED (SELECT doc_id, lang, count(*) AS n FROM sh GROUP BY 1, 2 HAVING count(*) >= 10),
k AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.lang = b.lang AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT a, b FROM k JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE c >= 0.8 * (x.n + y.n - c)),
r AS (SELECT doc_id AS id, doc_id AS o FROM n UNION SELECT r.id, l.b FROM r JOIN l ON l.a = r.o),
g AS (SELECT id, min(o) AS cluster FROM r GROUP BY id)
SELECT id, cluster, count(*) OVER (PARTITION BY cluster) AS size FROM g
"""


def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, lang, items): hashes of the distinct runs of three words of each document."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang", F.lower("text").alias("text"))
    kind = dict(docs.dtypes)["id"]

    def run(batches):
        for batch in batches:
            words = pc.split_pattern(pc.utf8_trim(pc.replace_substring_regex(pc.fill_null(batch.column(2), ""), r"[ \t\n\x0B\f\r]+", " "), " "), " ")
            flat = words.flatten().dictionary_encode()
            each = np.array([int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little") for w in flat.dictionary.to_pylist()], np.uint64)
            n = np.asarray(words.value_lengths(), np.int64)
            h, ends, lists = each[np.asarray(flat.indices)] if len(each) else np.zeros(0, np.uint64), np.cumsum(n), []
            for a, b in zip((ends - n).tolist(), ends.tolist()):
                x = h[a:b]
                lists.append(np.unique(mix64(mix64(mix64(x[:-2]) + x[1:-1]) + x[2:]) if len(x) > 2 else x[:0]).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), to_lists(lists, pa.int64())], names=["id", "lang", "items"])

    return map_batches(docs, run, f"id {kind}, lang string, items array<long>")


@query("q_ag12_minhash_clusters", CLUSTERS)
def ag12(spark, sf_dir):
    return duplicates.clusters(fingerprints(spark, sf_dir), group="lang")


@query("q_snk22_cluster_sizes", CLUSTERS.replace("SELECT id, cluster, count(*) OVER (PARTITION BY cluster) AS size FROM g", "SELECT size, count(*) AS n_clusters FROM (SELECT count(*) AS size FROM g GROUP BY cluster) GROUP BY size"))
def snk22(spark, sf_dir):
    found = duplicates.clusters(fingerprints(spark, sf_dir), group="lang")
    return found.groupBy("cluster").agg(F.count(F.lit(1)).alias("size")).groupBy("size").agg(F.count(F.lit(1)).alias("n_clusters"))


# Streams

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


EVENT_CODES = "SELECT event_id, CASE event_type WHEN 'click' THEN 0 WHEN 'purchase' THEN 1 WHEN 'view' THEN 3 WHEN 'signup' THEN 4 ELSE 5 END AS code FROM events WHERE event_type <> 'error'"


@query("x_stream_files", EVENT_CODES)
def stream_files(spark, sf_dir):
    code = F.when(F.col("event_type") == "click", 0).when(F.col("event_type") == "purchase", 1).when(F.col("event_type") == "view", 3).when(F.col("event_type") == "signup", 4).otherwise(5)
    return flow.drain(spark, sf_dir, "events.parquet", EVENTS, lambda e: e.where("event_type <> 'error'").select("event_id", code.alias("code")))


@query("x_window_tumbling", "SELECT time_bucket(INTERVAL 1 hour, ts) AS w_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling(spark, sf_dir):
    return rounded(flow.tumbling(table(spark, sf_dir, "events"), "1 hour"), "total", places=4)


@query("x_session", """WITH a AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 minute THEN 0 ELSE 1 END AS c FROM events),
b AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM a) SELECT user_id, min(ts) AS s_start, count(*) AS n FROM b GROUP BY user_id, s""")
def session(spark, sf_dir):
    rows = table(spark, sf_dir, "events").groupBy(F.session_window("ts", "30 minutes").alias("s"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return rows.select("user_id", F.col("s.start").alias("s_start"), "n")
