"""Substring dedup: super-k-mers of words go to the bucket of their minimiser, where sorted windows are counted."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import CHUNK, Words, chunks, fanout, mix, runs, settle, text_bytes

#: Words of the runs among which a window's minimiser is the least hash, and of those among which its second one is.
SEED, SECOND = 4, 8
#: Bytes of packed strings that a map task holds before it sends them off, and that a bucket holds on average.
FLUSH, BUCKET = 24 << 20, 16 << 20
#: A bucket with so many times the average is heavy: its windows are dealt over all buckets by both minimisers.
HEAVY = 3


def _least(h: np.ndarray, window: np.ndarray, width: int, seed: int) -> np.ndarray:
    """The least hash of the runs of `seed` words in each window."""
    seed = min(seed, width)
    least = runs(h, np.arange(len(h) - seed + 1), np.arange(seed, len(h) + 1), 1)
    span, done = width - seed + 1, 1
    while done < span:  # least over `done` places doubles to `span`
        step = min(done, span - done)
        least = np.minimum(least[: len(least) - step], least[step:])
        done += step
    return least[window]


def super_kmers(words: Words, width: int, buckets: int, heavy: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """(first word, end word, bucket, hashes of all words) of each run of consecutive windows with one minimiser; in heavy buckets with one
    second minimiser besides. Equal windows always share a bucket."""
    h, n = words.hashes, len(words.doc)
    window = np.flatnonzero(np.arange(n) + width <= words.begin[1:][words.doc]) if n else np.zeros(0, np.int64)
    if not len(window):
        return window, window, window, h
    m = _least(h, window, width, SEED)
    key = mix(m, 5)
    if heavy is not None and (again := np.flatnonzero(heavy[(key % np.uint64(buckets)).astype(np.int64)])).size:
        key[again] = mix(key[again] ^ _least(h, window[again], width, SECOND), 6)
    new = np.ones(len(window), bool)
    new[1:] = (key[1:] != key[:-1]) | (words.doc[window[1:]] != words.doc[window[:-1]])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(window)) - 1
    return window[first], window[last] + width, (key[first] % np.uint64(buckets)).astype(np.int64), h


def _weigh(width: int, buckets: int):
    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Bytes by bucket, as a task has met them."""
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, buf, off in chunks(batch):
                words = Words(buf, off)
                a, b, bucket, _ = super_kmers(words, width, buckets)
                np.add.at(total, bucket, words.at[b] - words.at[a])
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at, pa.int32()), pa.array(total[at])], names=["bucket", "bytes"])

    return weigh


def _pack(width: int, buckets: int, heavy: bytes):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per bucket one compressed blob of the distinct super-k-mers that a task has held, with their counts."""
        held: dict[int, dict[bytes, int]] = {}
        size, press = 0, zstandard.ZstdCompressor(level=3)
        marked = np.unpackbits(np.frombuffer(heavy, np.uint8), count=buckets).astype(bool)

        def flush() -> pa.RecordBatch:
            blobs = []
            for strings in held.values():
                head = np.array([len(strings), *map(len, strings), *strings.values()], np.uint32)
                blobs.append(press.compress(head.tobytes() + b"".join(strings)))
            out = pa.record_batch([pa.array(list(held), pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "blob"])
            held.clear()
            return out

        for batch in batches:
            for _, buf, off in chunks(batch):
                words = Words(buf, off)
                a, b, bucket, _ = super_kmers(words, width, buckets, marked)
                text = words.bytes.tobytes()
                for x, y, k in zip(words.at[a].tolist(), words.at[b].tolist(), bucket.tolist(), strict=True):
                    own = held.get(k)
                    if own is None:
                        own = held[k] = {}
                    s = text[x:y]
                    seen = own.get(s, 0)
                    own[s] = seen + 1
                    if not seen:
                        size += y - x
                if size > FLUSH:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    return pack


def _identity(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return runs(h, start, end, 1), runs(h, start, end, 2)


def _order(w1: np.ndarray, w2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of pairs of numbers, and which differ in it from the one before."""
    order = np.lexsort((w2, w1))
    s1, s2 = w1[order], w2[order]
    new = np.ones(len(order), bool)
    new[1:] = (s1[1:] != s1[:-1]) | (s2[1:] != s2[:-1])
    return order, new


def ranks(parts: list[tuple[np.ndarray, np.ndarray]], start: np.ndarray, width: int) -> np.ndarray:
    """A number for the words of each window, equal for equal windows alone: words are numbered, then runs of twice the length by the
    numbers of their halves."""
    known: dict[bytes, int] = {}
    now = np.array([known.setdefault(w, len(known)) for bytes_, _ in parts for w in bytes_.tobytes().split(b" ")[:-1]], np.int64)
    out, size, done = np.zeros(len(now), np.int64), 1, 0

    def joined(a: np.ndarray, b: np.ndarray, by: int) -> np.ndarray:
        right = np.append(b[by:], np.full(min(by, len(b)), -1))
        return np.unique(a * (int(b.max(initial=0)) + 2) + right + 1, return_inverse=True)[1]

    while size <= width:
        if width & size:
            out, done = joined(out, now, done), done + size
        now, size = joined(now, now, size), 2 * size
    return out[start].astype(np.uint64)


def same(words: np.ndarray, parts: list[tuple[np.ndarray, np.ndarray]], start: np.ndarray, new: np.ndarray, width: int) -> bool:
    """Whether windows that fingerprints call equal are: word by word, the hash of a word being of one word only. words: hashes of all words;
    parts: their bytes, each with one space, and sizes; start: first words of the windows in order; new: which differ from the one before."""
    again = np.flatnonzero(~new)
    if not len(again):
        return True
    x, y = start[again - 1], start[again]
    if not all((words[x + j] == words[y + j]).all() for j in range(width)):
        return False
    need = np.zeros(len(words) + 1, np.int64)  # words of such windows
    for at in (x, y):
        np.add.at(need, at, 1)
        np.add.at(need, at + width, -1)
    need = np.cumsum(need[:-1]) > 0
    known, done = {}, 0
    for bytes_, size in parts:
        some = np.flatnonzero(need[done : done + len(size)])
        _, first = np.unique(words[done + some], return_index=True)
        some_first = some[first]
        # within a part all words of a hash equal its first one, across parts the firsts do
        at = np.append(0, np.cumsum(size))
        own = some_first[np.searchsorted(words[done + some_first], words[done + some])]
        if not (size[some] == size[own]).all():
            return False
        n = size[some]
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        if not (bytes_[np.repeat(at[some], n) + inner] == bytes_[np.repeat(at[own], n) + inner]).all():
            return False
        raw = bytes_.tobytes()
        for k, a, b in zip(words[done + some_first].tolist(), at[some_first].tolist(), at[some_first + 1].tolist(), strict=True):
            if known.setdefault(k, raw[a:b]) != raw[a:b]:
                return False
        done += len(size)
    return True


def _count(width: int):
    def judge(blobs: list[bytes]) -> pa.RecordBatch:
        press = zstandard.ZstdDecompressor()
        total: dict[bytes, int] = {}
        for blob in blobs:
            raw = press.decompress(blob)
            n = int(np.frombuffer(raw, np.uint32, 1)[0])
            head = np.frombuffer(raw, np.uint32, 2 * n, 4)
            ends = 4 + 8 * n + np.cumsum(head[:n].astype(np.int64))
            for x, y, c in zip((ends - head[:n]).tolist(), ends.tolist(), head[n:].tolist(), strict=True):
                s = raw[x:y]
                total[s] = total.get(s, 0) + c
        strings, weight = list(total), np.fromiter(total.values(), np.int64, len(total))
        off = np.zeros(len(strings) + 1, np.int64)
        np.cumsum([len(s) for s in strings], out=off[1:])
        total.clear()
        keys, h_all, begin_all, word_all, byte_all, place, n_words, done = [], [], [], [], [], [], 0, 0
        while done < len(strings):  # hashes part by part
            stop = max(done + 1, int(np.searchsorted(off, off[done] + CHUNK, "right")) - 1)
            words = Words(np.frombuffer(b"".join(strings[done:stop]), np.uint8), off[done : stop + 1] - off[done])
            h, begin = words.hashes, words.begin
            ok = np.arange(len(h)) + width <= begin[1:][words.doc]
            start = np.flatnonzero(ok)
            keys.append((*_identity(h, start, start + width), words.doc[start] + done))
            h_all.append(np.stack(_identity(h, begin[:-1], begin[1:])))
            begin_all.append(np.bincount(words.doc[start], minlength=stop - done))
            place.append(start + n_words)
            word_all.append(h)
            byte_all.append((words.bytes, np.diff(words.at)))
            n_words += len(h)
            done = stop
        strings.clear()
        w1, w2, owner = (np.concatenate([k[i] for k in keys]) for i in range(3))
        id1, id2 = np.concatenate(h_all, axis=1)
        place = np.concatenate(place)
        order, new = _order(w1, w2)
        if not same(np.concatenate(word_all), byte_all, place[order], new, width):
            order, new = _order(ranks(byte_all, place, width), w2 & np.uint64(0))
        group = np.cumsum(new) - 1
        often = np.bincount(group, weights=weight[owner[order]]) > 1
        repeated = np.zeros(len(order), bool)
        repeated[order] = often[group]
        at = np.zeros(len(id1) + 1, np.int64)
        np.cumsum(np.concatenate(begin_all), out=at[1:])
        some = np.flatnonzero(np.add.reduceat(repeated, at[:-1]) > 0) if len(id1) else []
        return pa.record_batch(
            [pa.array(id1[some].view(np.int64)), pa.array(id2[some].view(np.int64)), pa.array([np.packbits(repeated[at[i] : at[i + 1]]).tobytes() for i in some], pa.binary())],
            names=["k1", "k2", "bits"],
        )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, blobs = None, []
        for batch in batches:
            for bucket, blob in zip(batch.column("bucket").to_pylist(), batch.column("blob").to_pylist(), strict=True):
                if bucket != now and blobs:
                    yield judge(blobs)
                    blobs = []
                now = bucket
                blobs.append(blob)
        if blobs:
            yield judge(blobs)

    return count


def _places(width: int, buckets: int, heavy: bytes):
    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked = np.unpackbits(np.frombuffer(heavy, np.uint8), count=buckets).astype(bool)
        for batch in batches:
            for part, buf, off in chunks(batch):
                words = Words(buf, off)
                a, b, _, h = super_kmers(words, width, buckets, marked)
                k1, k2 = _identity(h, a, b)
                doc = pa.array(words.doc[a])
                yield pa.record_batch(
                    [pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), part.column(0).take(doc), part.column(1).take(doc), pa.array(a - words.begin[words.doc[a]], pa.int64()), pa.array(b - a - width + 1, pa.int32())],
                    names=["k1", "k2", "doc_id", "text_hash", "first", "n"],
                )

    return places


def _cut(width: int, with_text: bool):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = 0
        for batch in batches:
            done = 0
            spans = batch.column(batch.schema.get_field_index("spans"))
            for part, buf, off in chunks(batch):
                words = Words(buf, off)
                cover = np.zeros(len(words.doc) + 1, np.int64)
                for i in range(part.num_rows):
                    for s in spans[done + i].as_py() or []:
                        hit = words.begin[i] + s["first"] + np.flatnonzero(np.unpackbits(np.frombuffer(s["bits"], np.uint8), count=s["n"]))
                        np.add.at(cover, hit, 1)
                        np.add.at(cover, hit + width, -1)
                kept = np.cumsum(cover[:-1]) == 0
                size = np.diff(words.at)
                text = words.bytes[np.repeat(kept, size)].tobytes()
                end = np.append(0, np.cumsum(np.where(kept, size, 0)))[words.begin]
                texts = [text[x : y - 1] if y > x else b"" for x, y in zip(end[:-1].tolist(), end[1:].tolist(), strict=True)]
                n = np.diff(words.begin)
                left = np.append(0, np.cumsum(kept))[words.begin]
                columns = [part.column(0), pa.array(n, pa.int64()), pa.array(n - np.diff(left), pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())]
                names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
                if with_text:
                    columns.append(pa.array(texts, pa.binary()).cast(pa.string()))
                    names.append("kept_text")
                yield pa.record_batch(columns, names=names)
                done += part.num_rows

    return cut


def remove_repeats(docs: DataFrame, width: int = 35, with_text: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256[, kept_text]): each text without the words covered by a window of `width`
    words that also starts anywhere else, the same text included, judged on the input.

    Consecutive windows that share a minimiser travel as one packed string to its bucket. A first pass weighs the buckets; windows of
    heavy ones are told apart by a second minimiser besides and dealt over all buckets, so that no common phrase fills one task. Equal strings of
    a map task travel once, with their count, so that copies by the million cost each bucket one string a task. A bucket sorts the
    128-bit fingerprints of its windows, holds the words of those that are equal against one another, and returns, for each string that
    holds a repeated window, a bit a window; texts look their own strings up. A null text has no words; texts shorter than a window lose
    nothing, very long ones are read whole; a row with a null or repeated doc_id counts as a text of its own, and equal rows get equal
    results. No rows give no rows; extra columns are ignored."""
    docs = docs.select("doc_id", "text")
    bytes_ = text_bytes(docs)
    buckets = max(1, fanout(docs, 3 * bytes_, BUCKET))
    weights = docs.select("text").mapInArrow(_weigh(width, buckets), "bucket int, bytes long").groupBy("bucket").agg(F.sum("bytes").alias("bytes"))
    # at most total / (HEAVY * BUCKET) numbers; a bit a bucket goes to the tasks
    heavy_ = np.zeros(buckets, bool)
    heavy_[[r[0] for r in weights.filter(F.col("bytes") > HEAVY * BUCKET).select("bucket").collect()]] = True
    heavy = np.packbits(heavy_).tobytes()
    blobs = docs.select("text").mapInArrow(_pack(width, buckets, heavy), "bucket int, blob binary")
    found = settle(blobs.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(_count(width), "k1 long, k2 long, bits binary"), "windows")
    keyed = docs.withColumn("text_hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    places = keyed.select("doc_id", "text_hash", "text").mapInArrow(_places(width, buckets, heavy), "k1 long, k2 long, doc_id long, text_hash long, first long, n int")
    hits = places.join(found, ["k1", "k2"]).select("doc_id", "text_hash", F.struct("first", "n", "bits").alias("span"))
    # equal rows of one id have the same spans: a set holds them once
    spans = settle(hits.groupBy("doc_id", "text_hash").agg(F.collect_set("span").alias("spans")), "spans")
    s = spans.select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"), "spans")
    joined = keyed.join(s, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("hash")), "left").select("doc_id", "text", "spans")
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    return joined.mapInArrow(_cut(width, with_text), schema)
