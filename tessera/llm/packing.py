"""Packing of token sequences by Karmarkar-Karp multiway differencing."""

from __future__ import annotations

import heapq
import json
import os
import re
import zlib
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import chunks, settle

#: Tails that are packed together, on average.
GROUP = 256
#: Words whose ids a task remembers.
MEMORY = 700_000


first = itemgetter(0)


#: Bytes of UTF-8 that stand in no text of white space, printable ASCII and Latin-1 letters; C3 leads the latter, 97 and B7 after it are signs.
OTHER = np.ones(256, bool)
OTHER[[*range(0x09, 0x0E), *range(0x20, 0x7F), *range(0x80, 0xC0), 0xC3]] = False
OTHER[[0x97, 0xB7]] = True
#: Bytes of letters, digits and white space.
BLANK = np.zeros(256, bool)
BLANK[[*range(0x09, 0x0E), 0x20]] = True
FINE = BLANK | np.array([c > 127 or chr(c).isalnum() for c in range(256)])


def marks(buf: np.ndarray, off: np.ndarray) -> tuple[list[bool], list[bool]]:
    """Of each text: whether it has other bytes or the start of a special token, and whether a stop or comma follows something else than a
    letter, digit or space, or has no space after it."""
    def texts(at: np.ndarray) -> list[bool]:
        out = np.zeros(len(off) - 1, bool)
        out[np.searchsorted(off, at, "right") - 1] = True
        return out.tolist()

    if not len(buf):
        return [False] * (len(off) - 1), [False] * (len(off) - 1)
    edge = np.zeros(len(buf) + 1, bool)
    edge[off] = True
    open_ = np.flatnonzero(buf[:-1] == ord("<"))
    special = open_[(buf[open_ + 1] == ord("|")) & ~edge[open_ + 1]]
    stop = np.flatnonzero((buf == ord(".")) | (buf == ord(",")))
    odd = ~(FINE[buf[stop - 1]] | edge[stop]) | ~(edge[stop + 1] | BLANK[buf[np.minimum(stop + 1, len(buf) - 1)]])
    return texts(np.append(np.flatnonzero(OTHER[buf]), special)), texts(stop[odd])


class Tokens:
    """Ids of texts as little-endian 32-bit bytes. No token spans white space or two of the tokenizer's own pieces (letters, one digit, other
    characters), so texts of ASCII and Latin-1 letters are lower-cased and looked up word by word, new words piece by piece. The merges
    of new pieces come from the same file's model, without the steps before it, which change nothing about such a piece;
    any other text goes to the tokenizer whole."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, models, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        model = json.loads(self.tokenizer.to_str())["model"]
        # without the library's own cache, which costs more than it saves on pieces that are all new
        self.merges = Tokenizer(models.BPE(vocab=model["vocab"], merges=[tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]], end_of_word_suffix=model["end_of_word_suffix"], cache_capacity=0))
        self.merges.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        # byte-level models spell each byte as a character: printable ones as themselves, the nth other one as 256 + n; of the
        # lower-case letters of Latin-1 only these bytes are such
        shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
        rest = [b for b in range(256) if b not in shown]
        self.spell = [(chr(b), chr(256 + rest.index(b))) for b in (0x9F, 0xA0, 0xAD)]
        self.split = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|[^a-z0-9\xdf-\xf6\xf8-\xff]+").findall
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.words: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, parts: list[str]) -> None:
        """Ids of new pieces: encoded many at a time and told apart by the tokens that end a piece."""
        for k in range(0, len(parts), 512):
            some = parts[k : k + 512]
            text = " ".join(some)
            text = text.encode().decode("latin-1")
            for byte, c in self.spell:
                text = text.replace(byte, c)
            ids = np.array(self.merges.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            cut = np.flatnonzero(self.ends[ids]) + 1
            if len(cut) == len(some) and cut[-1] == len(ids):
                raw, at = ids.tobytes(), [0, *(4 * cut).tolist()]
                self.parts.update((w, raw[x:y]) for w, x, y in zip(some, at[:-1], at[1:], strict=True))
            else:
                self.parts.update(zip(some, self._whole(some), strict=True))

    def __call__(self, texts: list[str]) -> list[bytes]:
        raw = [t.encode() for t in texts]
        return self.flat(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))

    def flat(self, buf: np.ndarray, off: np.ndarray) -> list[bytes]:
        """Ids of the texts buf[off[i]:off[i+1]]. With every stop and comma of a text between a letter and a space, these are words of their
        own, as they are pieces of their own."""
        words, parts = self.words, self.parts
        raw, other, odd = buf.tobytes(), *marks(buf, off)
        texts = [raw[x:y].decode() for x, y in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
        if len(words) > MEMORY:
            words.clear()
        if len(parts) > MEMORY:
            parts.clear()
        plain = [None if o else t.lower().split() if d else t.lower().replace(".", " .").replace(",", " ,").split() for t, o, d in zip(texts, other, odd, strict=True)]
        new = list(set().union(*filter(None, plain)).difference(words))
        split = list(map(self.split, new))
        self._learn(list(set().union(*split).difference(parts)))
        get = parts.__getitem__
        words.update(zip(new, [b"".join(map(get, own)) for own in split], strict=True))
        get = words.__getitem__
        whole = iter(self._whole([t for t, own in zip(texts, plain, strict=True) if own is None]))
        return [next(whole) if own is None else b"".join(map(get, own)) for own in plain]


#: Of this worker, over its tasks.
_tokens: dict[str, Tokens] = {}


def _pieces(path: str, end_id: int, size: int):
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if path not in _tokens:
            _tokens[path] = Tokens(path)
        tokens, last = _tokens[path], np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for part, buf, off in chunks(batch):
                rows: list[tuple] = []
                for id_, ids in zip(part.column(0).to_pylist(), tokens.flat(buf, off), strict=True):
                    ids += last
                    rows += [(id_, at // 4, len(cut := ids[at : at + 4 * size]) // 4, zlib.crc32(cut), len(ids) // 4) for at in range(0, len(ids), 4 * size)]
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return pieces


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """Karmarkar-Karp for k parts: item numbers by part. Each item starts as a partial partition of its own; again and again the two with the
    widest spread are merged, the largest part of one onto the smallest of the other."""
    heap = [(-s, i, (s,), (i,)) for i, s in enumerate(sizes)]  # sums in descending order, zeros left out; parts as nested pairs
    heapq.heapify(heap)
    fresh = len(sizes)
    while len(heap) > 1:
        _, _, a, pa_ = heapq.heappop(heap)
        _, _, b, pb = heapq.heappop(heap)
        if len(a) + len(b) <= k:
            rows = [*zip(a, pa_, strict=True), *zip(b, pb, strict=True)]
        else:
            free = k - len(b)
            # descending a against ascending b: a's largest k - len(b) parts meet b's zeros
            rows = list(zip(a[:free], pa_[:free], strict=True))
            up, pup = b[::-1], pb[::-1]
            for j in range(len(b)):
                i = free + j
                rows.append((a[i] + up[j], (pa_[i], pup[j])) if i < len(a) else (up[j], pup[j]))
        rows.sort(key=first, reverse=True)
        sums, parts = tuple(r[0] for r in rows), tuple(r[1] for r in rows)
        spread = sums[0] - (sums[-1] if len(sums) == k else 0)
        heapq.heappush(heap, (-spread, fresh, sums, parts))
        fresh += 1
    out: list[list[int]] = []
    for tree in heap[0][3] if heap else ():
        items, stack = [], [tree]
        while stack:
            x = stack.pop()
            if isinstance(x, tuple):
                stack += x
            else:
                items.append(x)
        out.append(sorted(items))
    return out


def windows(sizes: list[int], capacity: int) -> list[list[int]]:
    """The fewest parts by differencing that all hold at most `capacity`: their number rises while one is exceeded."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        parts = differencing(sizes, k)
        worst = max((sum(sizes[i] for i in p) for p in parts), default=0)
        if worst <= capacity:
            return parts
        k += 1


def _place(capacity: int):
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by group; a sequence's id is its group's number and its number therein."""
        import pandas as pd

        def done(group: pd.DataFrame) -> pa.RecordBatch:
            group = group.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], kind="stable").reset_index(drop=True)
            sizes = group["length"].to_list()
            full = sum(s == capacity for s in sizes)
            seq, offset = np.arange(len(sizes)), np.zeros(len(sizes), np.int64)
            for n, items in enumerate(windows(sizes[full:], capacity) if len(sizes) > full else []):
                at = 0
                for i in items:
                    seq[full + i], offset[full + i] = full + n, at
                    at += sizes[full + i]
            group["sequence_id"] = group["batch"].to_numpy(np.int64) * 2**32 + seq
            group["offset"] = offset
            return pa.RecordBatch.from_pandas(group.drop(columns="batch"), schema=OUT, preserve_index=False)

        held: list[pd.DataFrame] = []
        for batch in batches:
            frame = batch.to_pandas(types_mapper={pa.int64(): pd.Int64Dtype()}.get)
            for _, part in frame.groupby("batch", sort=True):
                if held and held[-1]["batch"].iloc[0] != part["batch"].iloc[0]:
                    yield done(pd.concat(held))
                    held = []
                held.append(part)
        if held:
            yield done(pd.concat(held))

    return place


OUT = pa.schema([(c, pa.int64()) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])


def pack(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 2) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of each piece. A text's ids and the end id are cut into runs of
    `capacity`, which are sequences by themselves, and a tail; tails are dealt into groups by a hash of their row, each of which is packed into
    as few near-equal sequences as differencing finds.

    A null or empty text is the end id alone; equal rows are packed like others, each its own piece, in whatever group its row falls; a null
    doc_id stays null; a very long text is cut like any other.
    No rows give no rows; extra columns are ignored. Texts never travel: pieces do."""
    cut = settle(docs.select("doc_id", "text").mapInArrow(_pieces(tokenizer, end_id, capacity), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"), "pieces")
    tails = cut.filter(F.col("length") < capacity).count()
    n = max(1, -(-tails // GROUP))
    # by a number of the row, so that equal rows do not share a group; the pieces are written, so the number stays
    dealt = cut.withColumn("batch", F.pmod(F.xxhash64(F.monotonically_increasing_id(), "doc_id", "start"), F.lit(n)))
    parts = max(1, min(n, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    return dealt.repartition(parts, "batch").sortWithinPartitions("batch").mapInArrow(_place(capacity), ", ".join(f"{f.name} long" for f in OUT))
