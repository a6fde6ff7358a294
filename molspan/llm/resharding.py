"""Resharding by minimum-cost flow: the fewest bytes move from old shards to new ones."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut

#: Rows of a block, about. A block is what moves from one shard to another.
BLOCK_ROWS = 1_000
#: Shards on a side, at most: their sizes and transfers are the driver's.
SHARDS = 4_096
#: Blocks whose bytes are summed in one window.
RUN = 4_096


class Flow:
    """Successive shortest paths with potentials, on a graph of some dozens of shards."""

    def __init__(self, nodes: int) -> None:
        self.out: list[list[int]] = [[] for _ in range(nodes)]
        self.to: list[int] = []
        self.room: list[int] = []
        self.cost: list[int] = []

    def edge(self, a: int, b: int, room: int, cost: int) -> int:
        for x, y, r, c in ((a, b, room, cost), (b, a, 0, -cost)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.room.append(r)
            self.cost.append(c)
        return len(self.to) - 2

    def solve(self, source: int, sink: int) -> None:
        n = len(self.out)
        height = [0] * n
        while True:
            far, by = [float("inf")] * n, [-1] * n
            far[source], heap = 0, [(0, source)]
            while heap:
                d, x = heapq.heappop(heap)
                if d > far[x]:
                    continue
                for e in self.out[x]:
                    if self.room[e] and (new := d + self.cost[e] + height[x] - height[self.to[e]]) < far[self.to[e]]:
                        far[self.to[e]], by[self.to[e]] = new, e
                        heapq.heappush(heap, (new, self.to[e]))
            if by[sink] < 0:
                return
            height = [h + f if f < float("inf") else h for h, f in zip(height, far)]
            path, x = [], sink
            while x != source:
                path.append(by[x])
                x = self.to[by[x] ^ 1]
            push = min(self.room[e] for e in path)
            for e in path:
                self.room[e] -= push
                self.room[e ^ 1] += push


def transfers(old: dict[int, int], capacity: list[int]) -> list[tuple[int, int, int]]:
    """(old shard, new shard, bytes) of a flow that moves the fewest bytes.

    old: bytes by old shard; capacity: bytes of each new shard. A byte that stays in the
    shard of the same number costs 0. Any other costs 1, wherever it goes, so all of those
    pass one node between the old and the new shards, and the graph has no edge for each
    pair. What leaves that node is dealt to what enters it in the order of the shards.
    Raises ValueError if capacity is short, or for more than SHARDS shards on a side.
    """
    if max(len(old), len(capacity)) > SHARDS:
        raise ValueError(f"{len(old)} old and {len(capacity)} new shards; at most {SHARDS}")
    if sum(old.values()) > sum(capacity):
        raise ValueError(f"{sum(old.values())} bytes don't fit a capacity of {sum(capacity)}")
    names = sorted(old)
    left, right = 2, 2 + len(names)
    between = right + len(capacity)
    net = Flow(between + 1)
    stay, leave = {}, {}
    for i, name in enumerate(names):
        net.edge(0, left + i, old[name], 0)
        if 0 <= name < len(capacity):
            stay[name] = net.edge(left + i, right + name, old[name], 0)
        leave[name] = net.edge(left + i, between, old[name], 1)
    enter = []
    for j, room in enumerate(capacity):
        enter.append(net.edge(between, right + j, room, 0))
        net.edge(right + j, 1, room, 0)
    net.solve(0, 1)
    moved = lambda e: net.room[e ^ 1]
    plan = [(name, name, moved(e)) for name, e in stay.items() if moved(e)]
    wanted = [[j, moved(e)] for j, e in enumerate(enter) if moved(e)]
    for name in names:
        n = moved(leave[name])
        while n:
            part = min(n, wanted[0][1])
            plan.append((name, wanted[0][0], part))
            n -= part
            wanted[0][1] -= part
            if not wanted[0][1]:
                wanted.pop(0)
    return sorted(plan)


def even_capacity(total: int, shards: int) -> list[int]:
    return [total // shards + (j < total % shards) for j in range(shards)]


def old_by_hash(column: Column, shards: int) -> Column:
    """The old layout where none is stored: one shard by hash of a column, such as the source."""
    return F.pmod(F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")), F.lit(shards)).cast("int")


def running(blocks: DataFrame) -> DataFrame:
    """Adds hi, the bytes up to and with each block of its old shard, by sums over runs of RUN blocks and within each."""
    run = F.floor(F.col("block") / RUN)
    inside = Window.partitionBy("old_shard", "run").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("old_shard").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("run", run)
    runs = blocks.groupBy("old_shard", "run").agg(F.sum("bytes").alias("all")).withColumn("before", F.coalesce(F.sum("all").over(before), F.lit(0))).drop("all")
    return blocks.withColumn("here", F.sum("bytes").over(inside)).join(runs, ["old_shard", "run"]).withColumn("hi", F.col("before") + F.col("here")).drop("run", "here", "before")


def reshard(rows: DataFrame, *, shards: int, capacity: list[int] | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Adds ``shard`` and ``slot`` to rows (doc_id, size, old_shard, ...).

    capacity: bytes of each new shard, by default total / shards; ValueError if it is short
    of all bytes, or not ``shards`` long. The flow is solved on the driver, from one number
    a shard, for SHARDS shards on a side at most (else ValueError). Its transfers are cut
    points on a line of each old shard's blocks (rows by a hash, about block_rows of them).
    Blocks between two cuts move, or stay, whole. A block with cuts inside is split by
    filling each part with its rows, largest first, while they fit, and the rest by what is
    missing most; so shards come near their capacities to within a few small rows.

    slot: 0, 1, ... without gaps in each shard, by block and then doc_id.

    Rows are numbered first, so null and repeated ids are rows like any other, spread over
    blocks. A null size is 0. Blocks of no bytes stay, or go to shard 0 if there is no such
    new shard. Equal texts are rows like any other too: nothing keeps them together. Empty
    input: no rows. old_shard may hold any integers; null counts as -1. Columns named block,
    shard or slot are replaced, __row may not be there; other columns are carried along.
    """
    rows = rows.drop("block", "shard", "slot").withColumns({"old_shard": F.coalesce("old_shard", F.lit(-1)).cast("int"), "size": F.coalesce("size", F.lit(0)).cast("long")})
    rows = cut(rows.withColumn("__row", F.monotonically_increasing_id()))
    sums = rows.groupBy("old_shard").agg(F.sum("size"), F.count(F.lit(1))).limit(SHARDS + 1).collect()
    old = {r[0]: (r[1], r[2]) for r in sums}
    total = sum(x for x, _ in old.values())
    capacity = capacity or even_capacity(total, shards)
    if len(capacity) != shards:
        raise ValueError(f"{len(capacity)} capacities for {shards} shards")
    plan = transfers({k: v for k, (v, _) in old.items()}, capacity)
    lines, at = [], {}
    for name, j, moved in sorted(plan, key=lambda x: (x[0], x[1] != x[0], x[1])):  # what stays comes first
        lines.append((name, at.get(name, 0), at.get(name, 0) + moved, j))
        at[name] = at.get(name, 0) + moved

    spark = rows.sparkSession
    sized = spark.createDataFrame([(k, max(4, -(-n // block_rows))) for k, (_, n) in old.items()], "old_shard int, blocks int")  # SHARDS rows at most
    rows = rows.join(F.broadcast(sized), "old_shard").withColumn("block", F.pmod(F.xxhash64("doc_id", "__row"), F.col("blocks")).cast("int")).drop("blocks")
    blocks = running(rows.groupBy("old_shard", "block").agg(F.sum("size").alias("bytes"))).withColumn("lo", F.col("hi") - F.col("bytes"))
    line = spark.createDataFrame(lines, "old_shard int, `from` long, `to` long, shard int")
    # at most one line for each old and new shard together, so it is small by itself
    met = blocks.where("bytes > 0").join(F.broadcast(line), "old_shard").where((F.col("from") < F.col("hi")) & (F.col("to") > F.col("lo")))
    part = F.struct(F.col("from"), "shard", (F.least("to", "hi") - F.greatest("from", "lo")).alias("room"))
    parts = cut(met.groupBy("old_shard", "block").agg(F.sort_array(F.collect_list(part)).alias("parts")))
    home = F.when((F.col("old_shard") >= 0) & (F.col("old_shard") < shards), F.col("old_shard")).otherwise(F.lit(0))
    empty = blocks.where("bytes = 0").select("old_shard", "block", home.alias("shard"))
    whole = parts.where(F.size("parts") == 1).select("old_shard", "block", F.col("parts")[0]["shard"].alias("shard")).unionByName(empty)
    kept = rows.columns
    moved = rows.join(whole, ["old_shard", "block"]).select(*kept, "shard")
    schema = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes) + ", shard int"

    def fill(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values(["size", "doc_id", "__row"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        split = block.pop("parts").iloc[0]
        room = np.array([p["room"] for p in split], dtype=np.int64)
        to = np.array([p["shard"] for p in split], dtype=np.int32)
        chosen = np.empty(len(block), np.int32)
        for i, size in enumerate(block["size"].to_numpy()):
            k = int(room.argmax())
            chosen[i] = to[k]
            room[k] -= size
        return block.assign(shard=chosen)

    straddling = rows.join(parts.where(F.size("parts") > 1), ["old_shard", "block"])
    split = straddling.select(*kept, "parts").groupBy("old_shard", "block").applyInPandas(fill, schema)
    done = cut(moved.unionByName(split))
    groups = done.groupBy("shard", "old_shard", "block").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("shard").orderBy("old_shard", "block").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select("shard", "old_shard", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    here = Window.partitionBy("shard", "old_shard", "block").orderBy("doc_id", "size", "__row")
    ranked = done.withColumn("rank", F.row_number().over(here))
    out = ranked.join(groups, ["shard", "old_shard", "block"])
    return out.withColumn("slot", (F.col("base") + F.col("rank") - 1).cast("long")).drop("base", "rank", "__row")


def stored(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a layout (shard=N folders) with old_shard, and ``place`` (file and row), which tells rows apart."""
    rows = spark.read.option("basePath", path).parquet(path)
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    return rows.withColumn("place", place).withColumnRenamed("shard", "old_shard").withColumn("old_shard", F.col("old_shard").cast("int"))


def rewrite(spark: SparkSession, path: str, placed: DataFrame) -> list[int]:
    """Brings a layout at ``path`` to what ``placed`` (reshard()'s rows with place) says; returns the shards written anew.

    Only shards that rows leave or come to are written; all others' files stay as they are.
    Rows are told apart by place, so repeated and null ids are safe. New files are written
    beside the layout first, all of them; then each affected shard's folder is moved away and
    the new one moved in (a shard that all rows left has none), and the old ones go at the
    end. If that is broken off, ``path``/_old and ``path``/_new, which Spark's readers pass by,
    have what is missing. placed must hold every row of the affected shards.
    """
    plan = cut(placed.select("place", "old_shard", "shard"))
    moving = plan.where("shard <> old_shard")
    changed = sorted(r[0] for r in moving.select(F.explode(F.array("shard", "old_shard")).alias("s")).distinct().limit(2 * SHARDS).collect())
    if not changed:
        return []
    rows = stored(spark, path).where(F.col("old_shard").isin(changed))
    if plan.where(F.col("old_shard").isin(changed)).count() != rows.count():
        raise ValueError("the plan doesn't hold each row of the shards that it changes")
    columns = [c for c in rows.columns if c not in ("place", "old_shard")]
    new = rows.join(plan.drop("old_shard"), "place").select(*columns, "shard")
    new.write.mode("overwrite").partitionBy("shard").parquet(f"{path}/_new")
    jvm = spark._jvm.org.apache.hadoop.fs
    files = jvm.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(jvm.Path(f"{path}/_old"))
    for s in changed:
        now, old, next_ = (jvm.Path(f"{path}{x}/shard={s}") for x in ("", "/_old", "/_new"))
        if files.exists(now) and not files.rename(now, old):
            raise OSError(f"can't move {now}")
        if files.exists(next_) and not files.rename(next_, now):
            raise OSError(f"can't move {next_}")
    for rest in ("_old", "_new"):
        files.delete(jvm.Path(f"{path}/{rest}"), True)
    return changed


def sizes(docs: DataFrame, old_shard: Column, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Narrow rows of docs: doc_id, size (UTF-8 bytes of the text, null: none, plus 16), text_crc32, old_shard."""
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    return docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), old_shard.alias("old_shard"))


def op6(spark, sf_dir: str) -> DataFrame:
    """Registered query: ``documents``, stored by hash of the source, dealt to 40 even shards.

    It gives the plan; there is no stored layout whose files rewrite() could change.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    placed = reshard(sizes(docs, old_by_hash(F.col("source"), 40)), shards=40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard")
