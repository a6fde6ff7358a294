"""More named queries beside their SQL: alignments, second pass, circles, confidence, tables and text sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from molspan.functions import alignment, chain
from molspan.functions import sequences as S
from molspan.operators import circular, contexts, extract, intervals, recall, segments
from molspan.session import cut
from molspan.sources import tables

from .bridge import INTERVALS, MODEL, OBS, coded_reads, seqs_sql, table
from .bridge import intervals as intervals_of
from .bridge import obs as obs_of
from .bridge import seqs as seqs_of
from .catalogue import COUNTS, FORWARD, MERGED, SCAN, TABLES, VITERBI, counted, query, rounded, scan, states_of, tables_of

# Alignments: the lines of an order are the operations of a read

OPS = """ops AS (SELECT l_orderkey AS read_id, l_linenumber AS k, CASE l_partkey % 5 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 4 THEN 4 ELSE 0 END AS op, CAST(l_quantity AS BIGINT) AS n FROM lineitem),
adv AS (SELECT *, CASE WHEN op IN (0, 1, 4, 7, 8) THEN n ELSE 0 END AS dq, CASE WHEN op IN (0, 2, 3, 7, 8) THEN n ELSE 0 END AS dr FROM ops),
blk AS (SELECT read_id, op, CAST(sum(dq) OVER w - dq AS BIGINT) AS q, CAST(sum(dr) OVER w - dr AS BIGINT) AS r, n FROM adv WINDOW w AS (PARTITION BY read_id ORDER BY k, op, n ROWS UNBOUNDED PRECEDING)),
al AS (SELECT read_id, q, r, n FROM blk WHERE op = 0 AND n > 0)
"""


def blocks_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("l_partkey") % 5
    op = F.when(kind.isin(1, 2, 4), kind).otherwise(0).cast("int")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("read_id"), F.struct(F.col("l_linenumber").alias("k"), op.alias("op"), F.col("l_quantity").cast("long").alias("n")).alias("x"))
    lists = rows.groupBy("read_id").agg(F.sort_array(F.collect_list("x")).alias("x"))
    return lists.select("read_id", alignment.aligned_blocks(F.transform("x", lambda x: F.struct(x["op"].alias("op"), x["n"].alias("n")))).alias("blocks"))


@query("q_fn06_blocks", f"WITH {OPS} SELECT * FROM al")
def fn06(spark, sf_dir):
    return blocks_of(spark, sf_dir).select("read_id", F.inline("blocks"))


@query("q_jn09_lookup", f"WITH {OPS} SELECT o.read_id, p.pos, r + p.pos - q AS ref FROM (SELECT DISTINCT read_id FROM ops) o CROSS JOIN (SELECT unnest([0, 7, 40, 90]) AS pos) p LEFT JOIN al ON al.read_id = o.read_id AND p.pos >= q AND p.pos < q + n")
def jn09(spark, sf_dir):
    rows = blocks_of(spark, sf_dir).withColumn("pos", F.explode(F.array(*[F.lit(x) for x in (0, 7, 40, 90)])))
    return rows.select("read_id", "pos", alignment.reference_of(F.col("blocks"), F.col("pos")).alias("ref"))


@query("q_fn33_reference_block", f"""WITH {OPS}, {INTERVALS}, i AS (SELECT read_id, score, start % 60 AS start, stop - start AS n FROM iv)
SELECT i.read_id, score, a.r + i.start - a.q AS r_start, b.r + i.start + i.n - 1 - b.q + 1 AS r_stop FROM i
JOIN al a ON a.read_id = i.read_id AND i.start >= a.q AND i.start < a.q + a.n JOIN al b ON b.read_id = i.read_id AND i.start + i.n - 1 >= b.q AND i.start + i.n - 1 < b.q + b.n""")
def fn33(spark, sf_dir):
    rows = intervals_of(spark, sf_dir).select("read_id", "score", (F.col("start") % 60).alias("start"), (F.col("stop") - F.col("start")).alias("n"))
    placed = rows.join(blocks_of(spark, sf_dir), "read_id").withColumn("b", alignment.reference_block(F.col("blocks"), F.col("start"), F.col("n"))).where("b IS NOT NULL")
    return placed.select("read_id", "score", F.col("b.start").alias("r_start"), F.col("b.stop").alias("r_stop"))


LETTER = "substr('ACGT', CAST(l_partkey % 4 + 1 AS INT), 1)"
MD = f"md AS (SELECT l_orderkey AS read_id, string_agg(CAST(l_quantity AS BIGINT) || {LETTER}, '' ORDER BY l_linenumber, CAST(l_quantity AS BIGINT) || {LETTER}) AS md FROM lineitem GROUP BY 1)"


def md_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(read_id, md): lines of an order as runs of matches, each with one substitution after it."""
    letter = F.substring(F.lit("ACGT"), (F.col("l_partkey") % 4 + 1).cast("int"), F.lit(1))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("read_id"), F.struct("l_linenumber", F.concat(F.col("l_quantity").cast("long").cast("string"), letter).alias("t")).alias("x"))
    return rows.groupBy("read_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["t"]), "").alias("md"))


@query("q_fn09_md_length", f"WITH {MD} SELECT md.read_id, md, n FROM md JOIN (SELECT l_orderkey AS read_id, CAST(sum(CAST(l_quantity AS BIGINT) + 1) AS BIGINT) AS n FROM lineitem GROUP BY 1) USING (read_id)")
def fn09(spark, sf_dir):
    return md_of(spark, sf_dir).select("read_id", "md", S.md_length(F.col("md")).alias("n"))


@query("q_fn10_substitutions", f"""SELECT l_orderkey AS read_id, CAST(sum(CAST(l_quantity AS BIGINT) + 1) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, CAST(l_quantity AS BIGINT) || {LETTER} ROWS UNBOUNDED PRECEDING) - 1 AS BIGINT) AS r, {LETTER} AS base FROM lineitem""")
def fn10(spark, sf_dir):
    return md_of(spark, sf_dir).select("read_id", F.inline(alignment.substitutions(F.col("md"))))


@query("q_fn11_stamp", f"WITH {seqs_sql()}, c AS (SELECT read_id, length(seq) AS n, unnest(string_split(seq, '')) AS c, generate_subscripts(string_split(seq, ''), 1) - 1 AS i FROM seqs) SELECT read_id, string_agg(CASE WHEN i % 7 = 3 THEN 'Y' ELSE c END, '' ORDER BY i) AS seq FROM c GROUP BY read_id")
def fn11(spark, sf_dir):
    whole = seqs_of(spark, sf_dir).where("seq IS NOT NULL")
    at = F.when(F.length("seq") > 0, F.sequence(F.lit(0).cast("bigint"), F.length("seq").cast("bigint") - 1)).otherwise(F.array().cast("array<bigint>"))
    every = F.filter(at, lambda i: i % 7 == 3)
    return whole.select("read_id", alignment.stamp(F.col("seq"), every, "Y").alias("seq"))


# Second pass: blocks of 32 bases are the footprints

TURNED = (
    SCAN.replace("FROM obs WINDOW", "FROM (SELECT * REPLACE (-step AS step), pos // 32 * 32 AS a FROM obs) WINDOW").replace("PARTITION BY read_id", "PARTITION BY read_id, a")
    .replace("SELECT x.read_id,", "SELECT x.read_id, x.a, x.hi + 1 AS far,").replace("ON x.read_id = y.read_id AND", "ON x.read_id = y.read_id AND x.a = y.a AND").replace("y.r >= 3.0", "y.r >= 4.0")
)


def footprints_of(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    seen = cut(obs_of(spark, sf_dir))
    block = (F.floor(F.col("pos") / 32) * 32).cast("long")
    return seen, seen.groupBy("read_id", block.alias("a")).agg((F.max("pos") + 1).alias("b"))


@query("q_iv11_split", TURNED + """, sp AS (SELECT read_id, pos // 32 * 32 AS a, max(pos) + 1 AS b FROM obs GROUP BY 1, 2),
g AS (SELECT sp.read_id, sp.a AS a, b, coalesce(lag(c.stop) OVER (PARTITION BY sp.read_id, sp.a ORDER BY c.start), sp.a) AS lo, coalesce(c.start, b) AS hi, c.stop FROM sp LEFT JOIN calls c ON c.read_id = sp.read_id AND c.a = sp.a)
SELECT read_id, lo AS a, hi AS b FROM g WHERE hi > lo UNION ALL SELECT read_id, max(stop), b FROM g WHERE stop IS NOT NULL GROUP BY read_id, a, b HAVING b > max(stop)""")
def iv11(spark, sf_dir):
    seen, spaces = footprints_of(spark, sf_dir)
    cuts = cut(recall.scan_within(seen, spaces, ["read_id"], turned=True, parts=recall.parts_for(seen), min_llr=4.0).select("read_id", "a", "b", "start", "stop"))
    return recall.split(spaces, cuts, ["read_id"])


IN_BLOCKS = SCAN.replace("FROM obs WINDOW", "FROM (SELECT *, pos // 32 * 32 AS a FROM obs) WINDOW").replace("PARTITION BY read_id", "PARTITION BY read_id, a").replace("coalesce(x.lh + 1, 0)", "coalesce(x.lh + 1, x.a)")
IN_BLOCKS = IN_BLOCKS.replace("SELECT x.read_id,", "SELECT x.read_id, x.a,").replace("ON x.read_id = y.read_id AND", "ON x.read_id = y.read_id AND x.a = y.a AND").replace("y.r >= 3.0 AND y.o - x.o + x.opp >= 3", "y.r >= 2.0 AND y.o - x.o + x.opp >= 2")
EDGE = "CASE WHEN {0} <= 0 THEN 255 WHEN {0} >= 30 THEN 0 ELSE CAST(round_even(255 * (1 - {0} / 30.0::DOUBLE), 0) AS INT) END"


@query("q_iv12_refine", IN_BLOCKS + f""", sp AS (SELECT read_id, pos // 32 * 32 AS a, max(pos) + 1 AS b FROM obs GROUP BY 1, 2),
co AS (SELECT read_id, a, min(start) AS s, max(stop) AS e, sum(llr) AS llr, arg_min(left_amb, start) AS l, arg_max(right_amb, start) AS r FROM calls GROUP BY 1, 2),
fi AS (SELECT sp.read_id, sp.a, b, coalesce(s, sp.a) AS start, coalesce(e, b) AS stop, s, llr, l, r FROM sp LEFT JOIN co ON co.read_id = sp.read_id AND co.a = sp.a)
SELECT read_id, a, b, CASE WHEN stop - start >= 8 THEN start END AS start, CASE WHEN stop - start >= 8 THEN stop END AS stop, CASE WHEN s IS NULL THEN 0 ELSE CAST(least(255, greatest(0, round_even(llr * 10, 0))) AS INT) END AS nq,
  CASE WHEN s IS NULL THEN 0 ELSE {EDGE.format('l')} END AS el, CASE WHEN s IS NULL THEN 0 ELSE {EDGE.format('r')} END AS er FROM fi""")
def iv12(spark, sf_dir):
    seen, spaces = footprints_of(spark, sf_dir)
    return recall.refine(spaces, seen, ["read_id"], least=8, parts=recall.parts_for(seen))


@query("q_iv13_phase_windows", f"""WITH {INTERVALS}, f AS (SELECT read_id, start AS a, stop AS b, CAST(round_even((stop - start) / 12.0::DOUBLE, 0) AS INT) AS n FROM iv WHERE stop - start >= 18),
e AS (SELECT DISTINCT read_id, a, b, n, unnest(range(1, n)) AS i FROM f WHERE n >= 2)
SELECT read_id, a, b, greatest(a, a + CAST(round_even(i * (b - a) / n::DOUBLE, 0) AS BIGINT) - 35) AS lo, least(b, a + CAST(round_even(i * (b - a) / n::DOUBLE, 0) AS BIGINT) + 35) AS hi FROM e""")
def iv13(spark, sf_dir):
    spaces = intervals_of(spark, sf_dir).select("read_id", F.col("start").alias("a"), F.col("stop").alias("b")).distinct()
    return recall.phase_windows(spaces, ["read_id"], 12.0)


@query("q_iv19_rederive", f"""WITH {INTERVALS},
m1 AS (SELECT *, max(stop) OVER (PARTITION BY read_id ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM iv),
m2 AS (SELECT *, sum(CASE WHEN far IS NULL OR start > far THEN 1 ELSE 0 END) OVER (PARTITION BY read_id ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS island FROM m1)
SELECT read_id, min(start) AS start, max(stop) AS stop FROM m2 GROUP BY read_id, island HAVING max(stop) - min(start) >= 20""")
def iv19(spark, sf_dir):
    rows = intervals_of(spark, sf_dir).select("read_id", "start", "stop", "kind")
    return recall.rederive(rows.where("kind = 'nuc'"), rows.where("kind = 'tf'"), ["read_id"], 20)


@query("q_iv24_drop_promoted", f"""WITH {INTERVALS} SELECT read_id, start, stop FROM iv n WHERE kind = 'nuc' AND (stop - start >= 25 OR NOT EXISTS (
  SELECT 1 FROM iv t WHERE t.kind = 'tf' AND t.stop - t.start >= 25 AND t.read_id = n.read_id AND t.start < n.stop AND t.stop > n.start))""")
def iv24(spark, sf_dir):
    rows = intervals_of(spark, sf_dir).select("read_id", "start", "stop", "kind")
    large = rows.where("kind = 'tf' AND stop - start >= 25").drop("kind")
    return recall.drop_under(rows.where("kind = 'nuc'").drop("kind"), large, ["read_id"], 25)


@query("q_jn08_quality", f"""WITH {INTERVALS}, o AS (SELECT read_id, start, stop - start AS n, max(score) AS nq FROM iv WHERE kind = 'nuc' AND start % 3 > 0 GROUP BY 1, 2, 3)
SELECT iv.read_id, iv.start, iv.stop, coalesce(nq, 0) AS nq FROM iv LEFT JOIN o ON o.read_id = iv.read_id AND o.start = iv.start AND o.n = iv.stop - iv.start WHERE kind = 'nuc'""")
def jn08(spark, sf_dir):
    rows = intervals_of(spark, sf_dir).where("kind = 'nuc'")
    old = rows.where("start % 3 > 0").withColumnRenamed("score", "nq")
    return intervals.quality_of(rows, old, ["read_id"]).select("read_id", "start", "stop", F.col("nq").cast("long").alias("nq"))


@query("q_jn12_scan_spaces", MERGED + f""", {OBS} SELECT m.read_id, m.start, m.stop, count(*) AS n, CAST(sum(hit) AS BIGINT) AS hits FROM merged m JOIN obs o ON o.read_id = m.read_id AND o.pos >= m.start AND o.pos < m.stop GROUP BY 1, 2, 3""")
def jn12(spark, sf_dir):
    spaces = intervals.merge(intervals_of(spark, sf_dir), ["read_id"])
    held = intervals.holding(obs_of(spark, sf_dir).select("read_id", "pos", "hit"), spaces, ["read_id"])
    return held.groupBy("read_id", "start", "stop").agg(F.count(F.lit(1)).alias("n"), F.sum("hit").alias("hits"))


# Circles of 400 bases

CIRCLE = f"{INTERVALS}, c AS (SELECT DISTINCT read_id, start % 400 AS s, stop - start AS n FROM iv WHERE stop > start)"
FREE = ", cov AS (SELECT DISTINCT read_id, (s + unnest(range(n))) % 400 AS pos FROM c), cut AS (SELECT m.read_id, min(p.pos) AS cut FROM (SELECT DISTINCT read_id FROM c) m CROSS JOIN (SELECT unnest(range(400)) AS pos) p ANTI JOIN cov ON cov.read_id = m.read_id AND cov.pos = p.pos GROUP BY 1)"


def circles(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = cut(intervals_of(spark, sf_dir).where("stop > start").select("read_id", (F.col("start") % 400).alias("start"), (F.col("stop") - F.col("start")).alias("n")).distinct())
    return rows, rows.select("read_id", F.lit(400).cast("long").alias("length")).distinct()


@query("q_ag25_first_uncovered", f"WITH {CIRCLE} {FREE} SELECT * FROM cut")
def ag25(spark, sf_dir):
    return circular.first_uncovered(*circles(spark, sf_dir), ["read_id"]).where("cut IS NOT NULL")


@query("q_iv20_project", f"""WITH {INTERVALS} SELECT DISTINCT read_id, CASE WHEN start >= 150 THEN start - 150 ELSE 0 END AS start, least(stop - start, 150) AS n FROM iv WHERE stop > start AND (start >= 150 AND start < 300 OR start < 150 AND stop > 300)""")
def iv20(spark, sf_dir):
    return circular.project_centre(intervals_of(spark, sf_dir).withColumn("length", F.lit(150).cast("long")), ["read_id"])


@query("q_iv23_circular_tiling", f"""WITH RECURSIVE {CIRCLE} {FREE}, rot AS (SELECT c.read_id, (s - coalesce(cut, 0) + 400) % 400 AS s, n, coalesce(cut, 0) AS cut FROM c LEFT JOIN cut ON cut.read_id = c.read_id),
p AS (SELECT read_id, cut, s AS start, least(s + n, 400) AS stop FROM rot UNION ALL SELECT read_id, cut, 0, s + n - 400 FROM rot WHERE s + n > 400),
o AS (SELECT *, row_number() OVER (PARTITION BY read_id ORDER BY start, stop DESC) AS k FROM p),
t AS (SELECT read_id, cut, k, start, stop, start AS s, CASE WHEN stop - start >= 10 THEN stop END AS last, stop - start >= 10 AS fits FROM o WHERE k = 1
  UNION ALL SELECT o.read_id, o.cut, o.k, o.start, o.stop, greatest(o.start, coalesce(t.last, o.start)), CASE WHEN o.stop - greatest(o.start, coalesce(t.last, o.start)) >= 10 THEN o.stop ELSE t.last END,
    o.stop - greatest(o.start, coalesce(t.last, o.start)) >= 10 FROM t JOIN o ON o.read_id = t.read_id AND o.k = t.k + 1),
nuc AS (SELECT read_id, cut, s, stop FROM t WHERE fits), b AS (SELECT DISTINCT read_id, cut FROM rot),
g AS (SELECT b.read_id, b.cut, coalesce(lag(stop) OVER (PARTITION BY b.read_id ORDER BY s), 0) AS lo, coalesce(s, 400) AS hi FROM b LEFT JOIN nuc ON nuc.read_id = b.read_id
  UNION ALL SELECT read_id, cut, max(stop), 400 FROM nuc GROUP BY 1, 2)
SELECT read_id, 'nuc' AS kind, (s + cut) % 400 AS start, stop - s AS n FROM nuc UNION ALL SELECT read_id, 'msp', (lo + cut) % 400, hi - lo FROM g WHERE hi - lo >= 5""")
def iv23(spark, sf_dir):
    return circular.tile_circle(*circles(spark, sf_dir), ["read_id"], least=10, gap=5)


@query("q_fn32_circular_parts", f"""WITH {INTERVALS}, c AS (SELECT read_id, score, start % 50 AS s, least(stop - start, 50) AS n FROM iv),
p AS (SELECT read_id, score, 0 AS first, s AS start, least(n, 50 - s) AS n FROM c UNION ALL SELECT read_id, score, 1, 0, n - (50 - s) FROM c WHERE n > 50 - s)
SELECT read_id, score, start, n, CAST(row_number() OVER (PARTITION BY read_id, score ORDER BY start, first DESC, n) AS INT) AS part, CAST(count(*) OVER (PARTITION BY read_id, score) AS INT) AS parts,
  CAST(sum(n) OVER (PARTITION BY read_id, score) AS BIGINT) AS whole FROM p""")
def fn32(spark, sf_dir):
    rows = intervals_of(spark, sf_dir).select("read_id", "score", "start", (F.col("stop") - F.col("start")).alias("n"))
    return intervals.circular_pieces(rows, F.lit(50).cast("long"), ["read_id", "score"])


# Confidence of the chain

POSTERIOR = FORWARD + "SELECT al.read_id, al.pos, 1 / (1 + exp(a0 + b0 - a1 - b1)) AS p FROM al JOIN be ON al.read_id = be.read_id AND al.pos = be.pos"
CONFIDENT = f"SELECT s.read_id, s.pos, s.state, CASE WHEN s.state = 1 THEN p ELSE 1 - p END AS confidence FROM ({VITERBI} SELECT read_id, pos, state FROM st) s JOIN ({POSTERIOR}) q ON q.read_id = s.read_id AND q.pos = s.pos"


@query("q_hmm05_confidence", f"SELECT read_id, pos, state, round(confidence, 6) AS confidence FROM ({CONFIDENT})")
def hmm05(spark, sf_dir):
    return rounded(confident(spark, sf_dir), "confidence")


def confident(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chain.run_chain(coded_reads(spark, sf_dir), MODEL, want="confidence")
    rows = found.select("read_id", F.posexplode(F.arrays_zip("states", "confidence")).alias("pos", "x"))
    return rows.select("read_id", F.col("pos").cast("long").alias("pos"), F.col("x.states").cast("int").alias("state"), F.col("x.confidence").alias("confidence"))


@query("q_iv03_scored_footprints", f"""WITH ch AS (SELECT *, CASE WHEN state = lag(state) OVER (PARTITION BY read_id ORDER BY pos) THEN 0 ELSE 1 END AS c FROM ({CONFIDENT})),
rn AS (SELECT *, sum(c) OVER (PARTITION BY read_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS run FROM ch)
SELECT read_id, min(pos) AS start, max(pos) + 1 AS stop, round(avg(confidence), 5) AS score FROM rn WHERE state = 0 GROUP BY read_id, run""")
def iv03(spark, sf_dir):
    return rounded(segments.footprints(confident(spark, sf_dir), ["read_id"], score=F.col("confidence")), "score", places=5)


@query("q_snk13_posterior_text", f"SELECT read_id, to_base64(unhex(string_agg(printf('%02x', CAST(trunc(least(greatest((1 - p) * 255, 0), 255)) AS INT)), '' ORDER BY pos))) AS posteriors FROM ({POSTERIOR}) GROUP BY read_id")
def snk13(spark, sf_dir):
    found = chain.run_chain(coded_reads(spark, sf_dir), MODEL, want="posterior")
    return found.select("read_id", S.bytes_text(F.transform("posterior", lambda p: S.unit_byte(1 - p))).alias("posteriors"))


@query("q_ag24_model_summary", TABLES + """SELECT state, count(*) AS n, round(min(p), 6) AS least, round(max(p), 6) AS greatest, round(avg(p), 6) AS mean, round(stddev_pop(p), 6) AS std
  FROM (SELECT 0 AS state, p_prot AS p FROM t UNION ALL SELECT 1, p_acc FROM t) GROUP BY state""")
def ag24(spark, sf_dir):
    return rounded(contexts.rate_summary(tables_of(spark, sf_dir)), "least", "greatest", "mean", "std")


# Tables of contexts


@query("q_ag02_weighted_counts", f"""WITH {seqs_sql()}, p AS (SELECT read_id, seq, unnest(range(2, length(seq) - 2)) AS pos FROM seqs),
q AS (SELECT substr(seq, CAST(pos - 1 AS INT), 5) AS context, (pos % 8) / 8.0::DOUBLE AS w, (pos * 7 + read_id) % 5 = 0 AS hit FROM p WHERE substr(seq, CAST(pos + 1 AS INT), 1) = 'A')
SELECT context, round(sum(CASE WHEN hit THEN w ELSE 0 END), 6) AS hit, round(sum(CASE WHEN hit THEN 0 ELSE w END), 6) AS nohit FROM q GROUP BY context""")
def ag02(spark, sf_dir):
    found = contexts.context_counts(seqs_of(spark, sf_dir), k=2, marked=(F.col("pos") * 7 + F.col("read_id")) % 5 == 0, weight=(F.col("pos") % 8) / 8)
    return rounded(found, "hit", "nohit")


@query("q_ag06_accessibility", COUNTS + "SELECT context, nohit AS accessible_bp, hit + nohit AS total_bp, round(nohit / (hit + nohit)::DOUBLE, 6) AS p_accessible FROM cc")
def ag06(spark, sf_dir):
    return rounded(contexts.accessibility(counted(spark, sf_dir)), "p_accessible")


@query("q_jn03_rates", COUNTS + ", r AS (SELECT context, hit / (hit + nohit)::DOUBLE AS rate, hit + nohit AS n FROM cc WHERE hit + nohit >= 20) SELECT r.context, round(rate, 6) AS rate, round(nohit / (cc.hit + cc.nohit)::DOUBLE, 6) AS p_accessible, n FROM r JOIN cc ON cc.context = r.context")
def jn03(spark, sf_dir):
    c = counted(spark, sf_dir)
    return rounded(contexts.supported_rates(c, contexts.accessibility(c), 20), "rate", "p_accessible")


@query("q_jn04_filled", COUNTS + ", e AS (SELECT dense_rank() OVER (ORDER BY context) * 2 - 1 AS code, hit, nohit FROM cc) SELECT g.code, CAST(coalesce(hit, 0) AS BIGINT) AS hit, CAST(coalesce(nohit, 0) AS BIGINT) AS nohit FROM (SELECT unnest(range(257)) AS code) g LEFT JOIN e ON e.code = g.code")
def jn04(spark, sf_dir):
    coded = contexts.dense_codes(counted(spark, sf_dir)).select((F.col("encode") * 2 + 1).alias("code"), "hit", "nohit")
    return contexts.filled(coded, "code", 257)


@query("q_jn11_steps", TABLES + f""", pp AS (SELECT read_id, seq, unnest(range(2, length(seq) - 2)) AS pos FROM seqs), qq AS (SELECT read_id, pos, substr(seq, CAST(pos - 1 AS INT), 5) AS context, (pos * 7 + read_id) % 5 = 0 AS hit FROM pp WHERE substr(seq, CAST(pos + 1 AS INT), 1) = 'A')
SELECT read_id, count(*) AS n, round(sum(CASE WHEN hit THEN ln(greatest(p_prot, 1e-30)) - ln(greatest(p_acc, 1e-30)) ELSE ln(greatest(1 - p_prot, 1e-30)) - ln(greatest(1 - p_acc, 1e-30)) END), 4) AS total FROM qq JOIN t ON t.context = qq.context GROUP BY read_id""")
def jn11(spark, sf_dir):
    rates = contexts.log_ratios(tables_of(spark, sf_dir)).select("context", "llr_hit", "llr_miss")
    bases = contexts.centres(seqs_of(spark, sf_dir), k=2).select("read_id", "context", ((F.col("pos") * 7 + F.col("read_id")) % 5 == 0).alias("hit"))
    step = F.when(F.col("hit"), F.col("llr_hit")).otherwise(F.col("llr_miss"))
    met = bases.join(F.broadcast(rates), "context")  # 4 ** 2k contexts at most
    return rounded(met.groupBy("read_id").agg(F.count(F.lit(1)).alias("n"), F.sum(step).alias("total")), "total", places=4)


# Reports and text sinks


@query("q_ag14_duplication", "SELECT count(*) AS clusters, CAST(sum(n) AS BIGINT) AS members, count(*) FILTER (n = 1) AS singletons, max(n) AS largest, round(100.0::DOUBLE * (1 - count(*) / sum(n)), 6) AS duplicate_percent FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)")
def ag14(spark, sf_dir):
    n = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    share = 100.0 * (1 - F.count(F.lit(1)) / F.sum("n"))
    return rounded(n.agg(F.count(F.lit(1)).alias("clusters"), F.sum("n").alias("members"), F.count_if(F.col("n") == 1).alias("singletons"), F.max("n").alias("largest"), share.alias("duplicate_percent")), "duplicate_percent")


@query("q_ag18_call_sums", SCAN + "SELECT read_id, count(*) AS n, sum(llr) AS llr, CAST(sum(opps) AS BIGINT) AS opps, max(stop - start) AS longest FROM calls GROUP BY read_id")
def ag18(spark, sf_dir):
    return segments.call_sums(scan(spark, sf_dir), ["read_id"])


@query("q_wn03_gaps", f"SELECT read_id, start, stop, lead(start) OVER (PARTITION BY read_id ORDER BY start) - stop AS gap FROM ({VITERBI} SELECT read_id, start, stop FROM runs WHERE state = 0)")
def wn03(spark, sf_dir):
    return intervals.gaps_to_next(segments.footprints(states_of(spark, sf_dir), ["read_id"]), ["read_id"])


@query("q_jn18_annotation_bytes", f"""WITH {INTERVALS}, o AS (SELECT read_id, kind, score, read_id % 2 = 1 AS rev, CASE WHEN read_id % 2 = 1 THEN 600 - stop ELSE start END AS start, stop - start AS n, start AS s0, row_number() OVER (PARTITION BY read_id ORDER BY kind, start, stop, score) - 1 AS k FROM iv)
SELECT read_id, CAST(k AS INT) AS k, kind, CAST(start AS INT) AS start, CAST(n AS INT) AS n, CASE WHEN kind = 'nuc' THEN score || '' WHEN rev THEN score || ',7,' || (s0 % 256) ELSE score || ',' || (s0 % 256) || ',7' END AS quals, kind || '_' || k AS name FROM o""")
def jn18(spark, sf_dir):
    item = F.struct("start", "stop", "score")
    lists = intervals_of(spark, sf_dir).groupBy("read_id").agg(*[F.sort_array(F.collect_list(F.when(F.col("kind") == k, item))).alias(k) for k in ("nuc", "tf")])
    token = lambda k: F.transform(k, lambda x: F.struct(x["start"].alias("start"), (x["stop"] - x["start"]).alias("n")))
    quality = F.concat(F.transform("nuc", lambda x: x["score"].cast("int")), F.flatten(F.transform("tf", lambda x: F.array(x["score"].cast("int"), (x["start"] % 256).cast("int"), F.lit(7)))))
    names = F.array_join(F.concat(F.transform("nuc", lambda x, i: F.concat(F.lit("nuc_"), i.cast("string"))), F.transform("tf", lambda x, i: F.concat(F.lit("tf_"), (i + F.size("nuc")).cast("string")))), ",")
    rows = lists.select("read_id", S.annotation_text(F.lit(600), [("nuc.Q", token("nuc")), ("tf.QQQ", token("tf"))]).alias("ma"), quality.alias("ma_aq"), names.alias("an"), (F.col("read_id") % 2 == 1).alias("is_reverse"))
    return extract.annotation_rows(rows).withColumn("quals", F.array_join(F.col("quals").cast("array<string>"), ","))


@query("q_iv26_analysed_span", f"""WITH {INTERVALS} SELECT read_id, coalesce(min(start) FILTER (score > 20), 0) AS lo, coalesce(max(stop) FILTER (score > 20), 777) AS hi FROM iv GROUP BY read_id""")
def iv26(spark, sf_dir):
    kept = lambda kind, v: F.collect_list(F.when((F.col("kind") == kind) & (F.col("score") > 20), v))
    rows = intervals_of(spark, sf_dir).withColumn("n", F.col("stop") - F.col("start")).groupBy("read_id").agg(*[kept(k, F.struct("start", "n")).alias(k) for k in ("nuc", "tf")])
    part = lambda k, f: F.transform(k, lambda x: x[f])
    return rows.withColumn("s", intervals.analysed_span(F.lit(777), *[(part(k, "start"), part(k, "n")) for k in ("nuc", "tf")])).select("read_id", "s.lo", "s.hi")


TAGGED = f"""WITH {INTERVALS}, x AS (SELECT read_id, CASE WHEN kind = 'tf' THEN 'tf' WHEN score > 30 THEN 'msp' ELSE 'nuc' END AS kind, start, stop - start AS n, score FROM iv),
g AS (SELECT read_id, string_agg(start, ',' ORDER BY start, n, score) FILTER (kind = 'nuc') AS ns, string_agg(n, ',' ORDER BY start, n, score) FILTER (kind = 'nuc') AS nl,
  string_agg(start, ',' ORDER BY start, n) FILTER (kind = 'msp') AS a_s, string_agg(n, ',' ORDER BY start, n) FILTER (kind = 'msp') AS al,
  string_agg((start + 1) || '-' || n, ',' ORDER BY start, n) FILTER (kind = 'nuc') AS mn, string_agg((start + 1) || '-' || n, ',' ORDER BY start, n) FILTER (kind = 'msp') AS mm, string_agg((start + 1) || '-' || n, ',' ORDER BY start, n) FILTER (kind = 'tf') AS mt,
  string_agg(score, ',' ORDER BY start, n, score) FILTER (kind = 'nuc') AS qn, string_agg(score || ',' || (start % 256) || ',7', ',' ORDER BY start, n, score) FILTER (kind = 'tf') AS qt FROM x GROUP BY read_id)
SELECT read_id, coalesce(ns, '') AS ns, coalesce(nl, '') AS nl, coalesce(a_s, '') AS a_s, coalesce(al, '') AS al, concat_ws(';', '600', 'nuc.Q:' || mn, 'msp.:' || mm, 'tf.QQQ:' || mt) AS ma,
  CASE WHEN qn IS NOT NULL OR qt IS NOT NULL THEN concat_ws(',', qn, qt) END AS aq FROM g"""


@query("q_iv28_tags", TAGGED)
def iv28(spark, sf_dir):
    rows = intervals_of(spark, sf_dir)
    bound, other = rows.where("kind = 'tf'"), rows.where("kind = 'nuc'")
    bound = bound.select("read_id", "start", "stop", F.col("score").alias("tq"), (F.col("start") % 256).alias("el"), F.lit(7).alias("er"))
    nucs, msps = other.where("score <= 30").select("read_id", "start", "stop", F.col("score").alias("nq")), other.where("score > 30").select("read_id", "start", "stop")
    found = tables.tags(nucs, msps, bound, rows.select("read_id", F.lit(600).alias("length")).distinct(), ["read_id"])
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    return found.select("read_id", text("ns").alias("ns"), text("nl").alias("nl"), text("as").alias("a_s"), text("al").alias("al"), "ma", text("aq").alias("aq"))


LINES = f"""SELECT s.read_id, s.read_id || chr(9) || 'chr1' || chr(9) || '0' || chr(9) || n || chr(9) || '+' || chr(9) || posteriors || chr(9) || coalesce(starts, '') || chr(9) || coalesce(sizes, '') AS line
FROM (SELECT read_id, count(*) AS n, to_base64(unhex(string_agg(printf('%02x', CAST(trunc(least(greatest(p * 255, 0), 255)) AS INT)), '' ORDER BY pos))) AS posteriors FROM ({POSTERIOR}) GROUP BY read_id) s
LEFT JOIN (SELECT read_id, string_agg(start, ',' ORDER BY start) AS starts, string_agg(stop - start, ',' ORDER BY start) AS sizes FROM ({VITERBI} SELECT read_id, start, stop FROM runs WHERE state = 0) GROUP BY read_id) f ON f.read_id = s.read_id"""


@query("q_snk14_posterior_lines", LINES)
def snk14(spark, sf_dir):
    runs = segments.runs(states_of(spark, sf_dir), ["read_id"]).where("state = 0")
    prints = runs.groupBy("read_id").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("footprints"))
    found = chain.run_chain(coded_reads(spark, sf_dir), MODEL, want="posterior").join(prints, "read_id", "left")
    held = F.coalesce("footprints", F.array().cast("array<struct<start:bigint,stop:bigint>>"))
    fields = [F.col("read_id"), F.lit("chr1"), F.lit(0), F.size("posterior"), F.lit("+")]
    return found.select("read_id", tables.posterior_line(posterior=F.col("posterior"), footprints=held, fields=fields).alias("line"))


@query("q_snk12_score_rows", f"WITH {INTERVALS} SELECT read_id, CAST(row_number() OVER (PARTITION BY read_id ORDER BY start, stop, score) - 1 AS INT) AS footprint, start, stop, score FROM iv")
def snk12(spark, sf_dir):
    rows = intervals_of(spark, sf_dir).groupBy("read_id").agg(F.sort_array(F.collect_list(F.struct("start", "stop", "score"))).alias("footprints"))
    return tables.footprint_rows(rows, ["read_id"])


@query("q_wn11_spacing", f"WITH {INTERVALS}, g AS (SELECT read_id, lead((start + stop) / 2) OVER (PARTITION BY read_id ORDER BY start, stop) - (start + stop) / 2 AS gap FROM iv) SELECT read_id, gap FROM g WHERE gap BETWEEN 120 AND 260")
def wn11(spark, sf_dir):
    return intervals.spacing(intervals_of(spark, sf_dir), ["read_id"])


@query("q_hmm18_adjusted", COUNTS + "SELECT context, round(least(1.0::DOUBLE, hit / (hit + nohit)::DOUBLE * 2.5), 6) AS p_acc, round(least(1.0::DOUBLE, nohit / (hit + nohit)::DOUBLE * 2.5), 6) AS p_prot FROM cc")
def hmm18(spark, sf_dir):
    c = counted(spark, sf_dir)
    swapped = c.select("context", F.col("nohit").alias("hit"), F.col("hit").alias("nohit"))
    return rounded(contexts.joined_tables(c, swapped, adjust=2.5), "p_acc", "p_prot")
