"""Near-duplicates: fast similarity sketching, banding, exact verification, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Words, chunks, mix, runs, settle

#: Coordinates of a sketch, and rows in a band: at similarity 0.85 a pair shares none of the 32 bands with probability 6e-11.
SIZE, ROWS = 128, 4
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingles(words: Words, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of each distinct shingle, sorted; a text of fewer words is one shingle."""
    h, n = words.hashes, len(words.doc)
    begin, end = words.begin[:-1], words.begin[1:]
    full = np.flatnonzero(np.arange(n) + width <= end[words.doc]) if n else np.zeros(0, np.int64)
    short = np.flatnonzero((end > begin) & (end - begin < width))
    d = np.concatenate([words.doc[full], short])
    x = np.concatenate([runs(h, full, full + width, 1), runs(h, begin[short], end[short], 1)])
    order = np.lexsort((x, d))
    d, x = d[order], x[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (x[1:] != x[:-1])
    return d[new], x[new]


def sketch(d: np.ndarray, x: np.ndarray, n_docs: int, size: int = SIZE) -> np.ndarray:
    """Fast similarity sketches, one row a text. In round i < size each shingle falls into a hashed bin with value
    i + fraction, in round size + j all fall into bin j; bins keep the least value. A text leaves when all its bins
    are filled: later rounds hold larger values only. A text without shingles keeps EMPTY."""
    out = np.full(n_docs * size, EMPTY)
    shift = np.uint64(64 - size.bit_length() + 1)
    for i in range(2 * size):
        if not len(d):
            break
        r = mix(x, 100 + i)
        bin_ = (r >> shift).astype(np.int64) if i < size else i - size
        np.minimum.at(out, d * size + bin_, np.uint64(i << 55) | (mix(r, 7) >> np.uint64(9)))
        open_ = (out.reshape(n_docs, size) == EMPTY).any(1)[d]
        d, x = d[open_], x[open_]
    return out.reshape(n_docs, size)


def bands(sketches: np.ndarray, rows: int = ROWS) -> np.ndarray:
    n, size = sketches.shape
    h = np.zeros((n, size // rows), np.uint64)
    for r in range(rows):
        h = mix(h ^ sketches[:, r::rows][:, : size // rows], 300 + r)
    return h


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


SLIM = "doc_id long, text_hash long, c1 long, c2 long, n_shingles long, bands array<long>"


def _slim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, buf, off in chunks(batch):
            words = Words(buf, off, lower=True)
            d, x = shingles(words)
            b = bands(sketch(d, x, part.num_rows))
            h, begin, end = words.hashes, words.begin[:-1], words.begin[1:]
            offsets = pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * b.shape[1])
            yield pa.record_batch(
                [part.column(0), part.column(1), _signed(runs(h, begin, end, 1)), _signed(runs(h, begin, end, 2)), pa.array(np.bincount(d, minlength=part.num_rows)), pa.ListArray.from_arrays(offsets, _signed(b.ravel()))],
                names=["doc_id", "text_hash", "c1", "c2", "n_shingles", "bands"],
            )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, buf, off in chunks(batch):
            d, x = shingles(Words(buf, off, lower=True))
            at = np.searchsorted(d, np.arange(part.num_rows + 1)).astype(np.int32)
            yield pa.record_batch([part.column(0), pa.ListArray.from_arrays(pa.array(at), _signed(x))], names=["id", "items"])


def _verify(percent: int):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by centre, the centre's own set first."""
        centre, own = None, np.zeros(0, np.int64)
        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            at, items, got = batch.column("items").offsets.to_numpy(), batch.column("items").values.to_numpy(), []
            for k in range(batch.num_rows):
                x = np.sort(items[at[k] : at[k + 1]])
                if b[k] is None:
                    centre, own = a[k], x
                elif a[k] == centre and len(own):
                    both = int((own[np.minimum(np.searchsorted(own, x), len(own) - 1)] == x).sum())
                    if 100 * both >= percent * (len(own) + len(x) - both):
                        got.append((centre, b[k]))
            yield pa.record_batch([pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.int64())], names=["a", "b"])

    return verify


def confirm(pairs: DataFrame, sets: DataFrame, percent: int, each: int = 250) -> DataFrame:
    """The pairs (a, b) whose full sets are similar. The pairs of one a are salted into parts of about so many rows."""
    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / each).cast("int").alias("parts"))
    salted = pairs.join(parts, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("salt"))
    member = salted.join(sets.withColumnRenamed("id", "b"), "b").select("a", "salt", "b", "items")
    centre = parts.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt")).join(sets.withColumnRenamed("id", "a"), "a").select("a", "salt", F.lit(None).cast("long").alias("b"), "items")
    rows = centre.unionByName(member).repartition(n, "a", "salt").sortWithinPartitions("a", "salt", F.asc_nulls_first("b"))
    return rows.mapInArrow(_verify(percent), "a long, b long")


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): the least id that each linked id reaches. Least labels travel along links and jump to their
    own label's label; each round is written to the shared folder."""
    both = settle(links.select(F.col(a).alias("x"), F.col(b).alias("y")).unionByName(links.select(F.col(b).alias("x"), F.col(a).alias("y"))).distinct(), "links")
    label = settle(both.groupBy(F.col("x").alias("id")).agg(F.least(F.col("id"), F.min("y")).alias("component")), "labels")
    while True:
        near = both.join(label, both.y == label.id).groupBy(F.col("x").alias("id")).agg(F.min("component").alias("least"))
        step = label.join(near, "id").select("id", F.col("component").alias("was"), F.least("component", "least").alias("component"))
        up = label.select(F.col("id").alias("component"), F.col("component").alias("up"))
        new = settle(step.join(up, "component", "left").select("id", "was", F.least("component", "up").alias("component")), "labels")
        label = new.select("id", "component")
        if not new.filter("component != was").limit(1).count():
            return label


#: Texts in a block, of which two meet in a task.
BLOCK = 256


def _cross(percent: int):
    def judge(c: list[int], items: list[np.ndarray], ids: list[int], side: list[int], same: bool) -> list[tuple[int, int]]:
        component, n = np.array(c), np.array([len(x) for x in items])
        if (component == component[0]).all():
            return []
        owner, flat = np.repeat(np.arange(len(items)), n), np.concatenate(items)
        _, column, count = np.unique(flat, return_inverse=True, return_counts=True)
        shared = count[column] > 1
        owner, column = owner[shared], (np.cumsum(count > 1) - 1)[column[shared]]
        both = np.zeros((len(items), len(items)), np.float32)
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        step = 4096
        for k in range(0, int(column[-1]) + 1 if len(column) else 0, step):
            x, y = np.searchsorted(column, [k, k + step])
            m = np.zeros((len(items), step), np.float32)
            m[owner[x:y], column[x:y] - k] = 1
            both += m @ m.T
        linked = (100 * both >= percent * (n[:, None] + n[None, :] - both)) & (component[:, None] != component[None, :]) & (np.arange(len(items))[:, None] < np.arange(len(items))[None, :])
        if not same:
            linked &= np.array(side)[:, None] != np.array(side)[None, :]
        return [(ids[i], ids[j]) for i, j in zip(*np.nonzero(linked), strict=True)]

    def cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by pair of blocks."""
        key, held = None, ([], [], [], [])

        def done() -> pa.RecordBatch:
            got = judge(*held, key[1] == key[2]) if held[0] else []
            for x in held:
                x.clear()
            return pa.record_batch([pa.array([g[i] for g in got], pa.int64()) for i in (0, 1)], names=["a", "b"])

        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in ("cluster", "p", "q")), strict=True)
            at, items = batch.column("items").offsets.to_numpy(), batch.column("items").values.to_numpy()
            rest = zip(*(batch.column(c).to_pylist() for c in ("component", "id", "block")), strict=True)
            for k, (own, (c, id_, block)) in enumerate(zip(keys, rest, strict=True)):
                if own != key and held[0]:
                    yield done()
                key = own
                for x, v in zip(held, (c, items[at[k] : at[k + 1]].copy(), id_, block), strict=True):
                    x.append(v)
        if held[0]:
            yield done()

    return cross


def across(near: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between different components among texts that share buckets. near: (least, rep, component), least being the first text of
    a bucket. Buckets that share texts are clusters; a cluster is dealt into blocks, and all pairs of blocks meet, so that a task
    holds two blocks however large a cluster is, and only links leave it."""
    cluster = components(near.filter("least != rep"), "least", "rep")
    texts = near.select(F.col("rep").alias("id"), "component").distinct().join(cluster.withColumnRenamed("component", "cluster"), "id")
    blocks = texts.groupBy("cluster").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = texts.join(blocks, "cluster").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    held = dealt.join(sets, "id").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = held.select("cluster", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "id", "component", "block", "items")
    n = int(near.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "cluster", "p", "q").sortWithinPartitions("cluster", "p", "q").mapInArrow(_cross(percent), "a long, b long")


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """Every row with n_shingles, component_id and kept: documents are linked where 100 * intersection >= percent * union
    of their sets of distinct 5-word shingles, words lower-cased in A-Z; component_id is the smallest doc_id reachable.

    Texts of equal words are one class, of which one text is sketched further. Bands name candidates: the members of a bucket are confirmed
    on full sets against its first, then its last member; where a bucket still joins different components, its texts are checked
    against one another in blocks, so that no link found by the bands is lost. A null or wordless text is empty and linked with
    nothing; a null doc_id takes no part (component_id null, kept). Rows that share a doc_id are texts of their own: equal ones share
    their fate, others have each its own links. Very long texts are read whole. An empty table gives no rows; extra columns are ignored."""
    docs = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    row = ["doc_id", "text_hash"]
    slim = settle(docs.mapInArrow(_slim, SLIM), "slim")
    active = slim.filter("n_shingles > 0 and doc_id is not null")
    firsts = active.groupBy("c1", "c2").agg(F.min(F.struct(*row)).alias("first")).select("c1", "c2", "first.*")
    classes = settle(firsts.withColumn("node", F.monotonically_increasing_id()), "classes")
    reps = active.join(classes, ["c1", "c2", *row]).dropDuplicates(["c1", "c2", *row])
    spread = reps.select(F.col("node").alias("rep"), F.posexplode("bands").alias("band", "hash"))
    shared = spread.groupBy("band", "hash").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).filter("low != high").select("band", "hash")
    members = settle(spread.join(shared, ["band", "hash"]).select("band", "hash", "rep"), "members")
    involved = members.select(F.col("rep").alias("node")).distinct().join(classes, "node").select("node", *row)
    sets = settle(docs.join(involved, row).dropDuplicates(row).select("node", "text").mapInArrow(_sets, "id long, items array<long>"), "sets", "none")
    alone = sets.select("id", F.explode("items").alias("item")).groupBy("item").agg(F.count("*").alias("n"), F.min("id").alias("id")).filter("n = 1").groupBy("id").agg(F.count("*").alias("u"))
    size = settle(sets.select("id", F.size("items").alias("n")).join(alone, "id", "left").select("id", "n", F.coalesce("u", F.lit(0)).alias("u")).filter(f"100 * (n - u) >= {percent} * n"), "sizes")

    def sized(x: str) -> DataFrame:
        return size.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("u").alias(f"u{x}"))

    def possible() -> Column:
        """u shingles of a text stand in no other text: they bound what two texts can share, and the least union."""
        share = F.least(F.col("na") - F.col("ua"), F.col("nb") - F.col("ub"))
        return 100 * share >= percent * F.greatest(F.col("na") + F.col("ub"), F.col("nb") + F.col("ua"))

    members = settle(members.join(size.select(F.col("id").alias("rep")), "rep"), "able")
    ends = members.groupBy("band", "hash").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).filter("low != high")
    both = members.join(ends, ["band", "hash"])
    stars = both.select(F.col("low").alias("a"), F.col("rep").alias("b")).filter("a != b").unionByName(both.filter("rep != low").select(F.col("high").alias("a"), F.col("rep").alias("b")).filter("a != b")).distinct()
    stars = settle(stars.join(sized("a"), "a").join(sized("b"), "b").filter(possible()).select("a", "b"), "stars")
    links = settle(confirm(stars, sets, percent), "links")
    label = components(links)
    placed = members.join(label.withColumnRenamed("id", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    mixed = placed.groupBy("band", "hash").agg(F.min("component").alias("c0"), F.max("component").alias("c1"), F.min("rep").alias("least")).filter("c0 != c1").select("band", "hash", "least")
    near = settle(placed.join(mixed, ["band", "hash"]).select("least", "rep", "component").distinct(), "mixed")
    if near.limit(1).count():
        label = components(links.unionByName(across(near, sets, percent)))
    linked = label.withColumnRenamed("id", "node").join(classes, "node").select("node", "component", "doc_id")
    least = linked.groupBy("component").agg(F.min("doc_id").alias("least"))
    named = linked.join(least, "component").select("node", "least")
    placed = classes.join(named, "node", "left").select("c1", "c2", F.coalesce("least", "doc_id").alias("component_id"))
    out = slim.drop("bands", "text_hash").join(placed, ["c1", "c2"], "left")
    least = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", least.alias("component_id"), F.coalesce(F.col("doc_id") == least, F.lit(True)).alias("kept"))
