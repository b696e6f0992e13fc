"""Exact top-k by inner product: distributed histogram selection."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import settle

#: Vectors and queries in a block, and bins of a histogram.
ROWS, QUERIES, BINS = 4096, 512, 2048
#: Blocks of queries and of vectors that meet in one group: a task holds the former and reads the latter one by one.
ASKED, READ = 4, 32
#: Scores stay below.
LIMIT = 2**62


def _blocks(id_: str, size: int):
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Up to `size` integer vectors as one row; vectors of different lengths go to different blocks."""
        for batch in batches:
            by: dict[int, list[int]] = {}
            for i, n in enumerate(batch.column("v").value_lengths().to_pylist()):
                by.setdefault(n or 0, []).append(i)
            for dim, rows in by.items():
                for k in range(0, len(rows), size):
                    part = batch.take(pa.array(rows[k : k + size]))
                    m = np.asarray(part.column("v").flatten(), np.int64)
                    yield pa.record_batch(
                        [pa.array([dim], pa.int32()), pa.array([part.column(id_).to_pylist()], pa.list_(pa.int64())), pa.array([m.tobytes()], pa.binary())],
                        names=["dim", "ids", "m"],
                    )

    return blocks


BLOCK = "dim int, ids array<long>, m binary"


def scores(q: np.ndarray, v: np.ndarray, ok: np.ndarray | bool = True) -> np.ndarray:
    """All integer inner products that count, exactly: in doubles where these hold them, else in 64-bit integers, else number by number; one
    of LIMIT or more is an error."""
    reach = q.shape[1] * float(np.abs(q.astype(float)).max()) * float(np.abs(v.astype(float)).max()) if q.size and v.size else 0.0
    if reach < 2**53:
        return (q.astype(float) @ v.astype(float).T).astype(np.int64)
    if reach < LIMIT:
        return q @ v.T
    exact = np.where(ok, q.astype(object) @ v.astype(object).T, 0)
    if max(abs(x) for x in exact.flat) >= LIMIT:
        raise OverflowError("an inner product of 2**62 or more")
    return exact.astype(np.int64)


class Asked:
    """The queries of a group in a task, stacked by length of vector, with what a pass knows of each."""

    def __init__(self, held: list[dict]):
        self.key = {d: np.concatenate([h["key"] for h in held if h["dim"] == d]) for d in {h["dim"] for h in held}}
        self.ids, self.low, self.step = ({d: np.concatenate([h[c] for h in held if h["dim"] == d]) for d in self.key} for c in ("ids", "low", "step"))
        self.m = {d: np.concatenate([h["m"] for h in held if h["dim"] == d]) for d in self.key}

    def against(self, block: dict) -> tuple[np.ndarray, np.ndarray] | None:
        """Scores of the queries of a block's length with its vectors, and which count: a query's own id does not."""
        d = block["dim"]
        if d not in self.key:
            return None
        ok = self.ids[d][:, None] != block["ids"][None, :]
        return scores(self.m[d], block["m"], ok), ok


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, dict]]:
    """(group, block): rows come by group, its queries first."""
    for batch in batches:
        for r in batch.to_pylist():
            n, d = len(r["ids"]), r["dim"]
            block = {"dim": d, "ids": np.array(r["ids"], np.int64), "m": np.frombuffer(r["m"], np.int64).reshape(n, d)}
            if r["block"] is not None:
                block |= {"key": r["block"] * QUERIES + np.arange(n), "low": np.array(r["low"] or np.zeros(n), np.int64), "step": np.array(r["step"] or np.zeros(n), np.int64)}
            yield (r["qg"], r["vg"]), block


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, Asked, dict | None]]:
    """(whether the group ends, its queries, the next block of vectors)."""
    group, held, asked = None, [], None
    for own, block in _unpacked(batches):
        if own != group:
            if asked is not None:
                yield True, asked, None
            group, held, asked = own, [], None
        if "key" in block:
            held.append(block)
        else:
            asked = asked or Asked(held)
            yield False, asked, block
    if asked is not None:
        yield True, asked, None


def _histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts by bin of each query's scores from its low up, the last bin holding all beyond: added up over a group before they leave."""
    total: dict[int, np.ndarray] = {}
    for ends, asked, block in _grouped(batches):
        if ends:
            for d, n in total.items():
                at = np.flatnonzero(n)
                yield pa.record_batch([pa.array(asked.key[d][at // (BINS + 1)]), pa.array(at % (BINS + 1), pa.int32()), pa.array(n[at])], names=["key", "bin", "n"])
            total = {}
        elif len(asked.m) and (got := asked.against(block)):
            (s, ok), d = got, block["dim"]
            low, step = asked.low[d][:, None], asked.step[d][:, None]
            ok &= s >= low
            bin_ = np.minimum((s.view(np.uint64) - low.view(np.uint64)) // step.view(np.uint64), np.uint64(BINS)).astype(np.int64)
            n = np.bincount((np.arange(len(s))[:, None] * (BINS + 1) + bin_)[ok], minlength=len(s) * (BINS + 1))
            total[d] = total[d] + n if d in total else n


def _select(k: int):
    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Scores from the kth value up; of a block's ties at that value the k smallest ids, as no others can be needed."""
        for ends, asked, block in _grouped(batches):
            if ends or not (got := asked.against(block)):
                continue
            (s, ok), d = got, block["dim"]
            kth = asked.low[d][:, None]
            above, tie = ok & (s > kth), ok & (s == kth)
            order = np.argsort(block["ids"], kind="stable")
            rank = np.cumsum(tie[:, order], axis=1)
            tie[:, order] &= rank <= k
            a, b = np.nonzero(above | tie)
            yield pa.record_batch([pa.array(asked.key[d][a]), pa.array(asked.ids[d][a]), pa.array(block["ids"][b]), pa.array(s[a, b])], names=["key", "query_id", "vec_id", "score"])

    return select


def _norms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            n = len(r["ids"])
            m = np.frombuffer(r["m"], np.int64).reshape(n, r["dim"]).astype(float)
            i = np.arange(n)
            yield pa.record_batch([pa.array(r["block"] * QUERIES + i), pa.array(np.full(n, r["block"])), pa.array(i), pa.array(np.full(n, r["dim"])), pa.array(np.sqrt((m * m).sum(1)))], names=["key", "block", "i", "dim", "norm"])


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, scale: int = 1024, id_: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest integer inner products over all vectors but its own id,
    ties to the smaller id. Components become floor(scale * x).

    Blocks of queries and of vectors are dealt into groups, each pair of which is one key of a single shuffle: a task holds a few blocks of
    queries and reads its vectors block by block. A pass scores everything and adds one histogram a query and task up over the
    cluster, from bounds that the norms give; the bin that holds the kth value is divided again until it holds no more than what is
    needed or is one value wide, then the scores from there up are ranked.

    Vectors that are null or hold null or non-finite components take no part, nor does a null id; a query meets vectors of its own length
    only, however long; an empty vector scores 0 with others; with fewer candidates than k, all are returned; repeated ids count as
    rows of their own, as candidates and as queries (equal query rows are one). A component beyond 64 bits or a score of 2**62 or more
    ends the job with an error. Extra columns are ignored; no rows give no rows."""

    def cleaned(df: DataFrame) -> DataFrame:
        scaled = F.transform(F.col(column), lambda x: F.lit(float(scale)) * x.cast("double"))
        fine = F.col(column).isNotNull() & F.col(id_).isNotNull() & F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        whole = F.transform("v", lambda x: F.when(F.abs(x) < 2.0**63, F.floor(x).cast("long")).otherwise(F.raise_error(F.lit("a component does not fit 64 bits")).cast("long")))
        return df.select(id_, column).filter(F.coalesce(fine, F.lit(False))).select(F.col(id_).cast("long").alias(id_), scaled.alias("v")).withColumn("v", whole)

    spark = vectors.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows, asked_ = cleaned(vectors), cleaned(queries).distinct()
    v = settle(rows.mapInArrow(_blocks(id_, ROWS), BLOCK).withColumn("block", F.monotonically_increasing_id()), "rows")
    q = settle(asked_.repartition(max(1, parts // 4), id_).mapInArrow(_blocks(id_, QUERIES), BLOCK).withColumn("block", F.monotonically_increasing_id()), "queries")
    # blocks are numbered by partition with gaps; a few numbers a block say which groups there are
    n_q, n_v = (max(1, -(-x.count() // each)) for x, each in ((q, ASKED), (v, READ)))

    def group(n: int, block: str = "block") -> Column:
        return F.pmod(F.xxhash64(block), F.lit(n)).cast("int")

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    def met(state: DataFrame | None) -> DataFrame:
        """Queries, with what is known of them, and vectors by pair of groups."""
        none = F.lit(None).cast("array<long>")
        own = q.withColumns({"low": none, "step": none}) if state is None else q.join(state, "block")
        own = own.withColumn("qg", group(n_q)).select("qg", every(n_v).alias("vg"), "block", "dim", "ids", "m", "low", "step")
        theirs = v.withColumn("vg", group(n_v)).select(every(n_q).alias("qg"), "vg", F.lit(None).cast("long").alias("block"), "dim", "ids", "m", none.alias("low"), none.alias("step"))
        return own.unionByName(theirs).repartition(max(1, min(n_q * n_v, 4 * parts)), "qg", "vg").sortWithinPartitions("qg", "vg", F.asc_nulls_last("block"))

    # Cauchy-Schwarz bounds a query's scores; a little more covers rounding
    longest = rows.groupBy(F.size("v").alias("dim")).agg(F.sqrt(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))).alias("longest"))
    reach = F.least(F.col("norm") * F.col("longest") * (1 + 1e-9) + 2, F.lit(float(LIMIT))).cast("long")
    norms = q.mapInArrow(_norms, "key long, block long, i long, dim long, norm double").join(longest, "dim")
    # a query's kth value is looked for from `low` up in bins of `step`
    state = settle(norms.select("key", "block", "i", (-reach).alias("low"), (F.floor(reach / (BINS // 2)) + 1).alias("step"), F.lit(False).alias("done")), "state")

    def packed() -> DataFrame:
        x = F.array_sort(F.collect_list(F.struct("i", "low", "step")))
        return settle(state.groupBy("block").agg(x.alias("x")).select("block", F.col("x.low").alias("low"), F.col("x.step").alias("step")), "packed")

    while state.filter("not done").limit(1).count():
        counts = met(packed()).mapInArrow(_histogram, "key long, bin int, n long").groupBy("key", "bin").agg(F.sum("n").alias("n"))
        own = W.partitionBy("key")
        upto = counts.withColumns({"upto": F.sum("n").over(own.orderBy(F.desc("bin"))), "all": F.sum("n").over(own)})
        # with fewer values than needed it is the least one's bin
        found = upto.filter(F.col("upto") >= F.least(F.lit(k), "all")).groupBy("key").agg(F.max(F.struct(F.col("bin").cast("long").alias("bin"), "upto")).alias("x")).select("key", "x.*")
        half = F.floor(F.col("bin") / 2)
        low = F.col("low") + half * F.col("step") + (F.col("bin") - half) * F.col("step")
        ends = F.col("bin").isNull() | (F.col("upto") <= k) | (F.col("step") == 1)
        at, fixed = state.join(found, "key", "left"), F.col("done") | F.col("bin").isNull()
        state = settle(at.select("key", "block", "i", F.when(fixed, F.col("low")).otherwise(low).alias("low"), F.when(fixed | ends, F.col("step")).otherwise(F.ceil(F.col("step") / BINS)).alias("step"), (fixed | ends).alias("done")), "state")
    got = met(packed()).mapInArrow(_select(k), "key long, query_id long, vec_id long, score long")
    by = W.partitionBy("key").orderBy(F.desc("score"), "vec_id")
    return got.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
