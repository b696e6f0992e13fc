"""Token counts under a unigram model, by dynamic programming along a trie of pre-tokens."""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.common import chunks

#: Pre-tokens whose counts a worker remembers, and bytes of text whose new pre-tokens share a trie.
MEMORY, SHARE = 1_000_000, 8 << 20
#: What stands before each pre-token.
MARK = "▁"


def zipf_model(path: str) -> dict[str, float]:
    """Log-probabilities for the pieces of a sentencepiece file in the order of their merges: the nth has weight 1 / n, as the file itself
    holds ranks and no probabilities; control, unknown and byte pieces are left out."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
    total = math.log(sum(1 / (i + 1) for i in range(len(pieces))))
    return {p: -math.log(i + 1) - total for i, p in enumerate(pieces)}


class Counter:
    """Tokens of the best segmentation: highest sum of log-probabilities, then fewest tokens. A character that no piece holds
    costs `unknown` and counts as its UTF-8 bytes."""

    def __init__(self, model: dict[str, float]):
        self.model = model
        self.unknown = min(model.values(), default=0.0) - 10
        lengths: dict[str, set[int]] = {}
        for p in model:
            lengths.setdefault(p[-1], set()).add(len(p))
        self.lengths = {c: sorted(n) for c, n in lengths.items()}

    def counts(self, words: Iterable[str]) -> Iterator[tuple[str, int]]:
        """The trie is walked in sorted order with the path from its root as a stack: the scores of a prefix are computed once for
        all words that share it, and a word's count is stored where it ends."""
        model, lengths, unknown, none = self.model, self.lengths, self.unknown, ()
        best, tokens, last = [0.0], [0], ""
        for word in sorted(words):
            text = MARK + word
            same, most = 0, min(len(text), len(last))
            while same < most and text[same] == last[same]:
                same += 1
            del best[same + 1 :], tokens[same + 1 :]
            for end in range(same + 1, len(text) + 1):
                c = text[end - 1]
                top, n = best[end - 1] + unknown, tokens[end - 1] + len(c.encode())
                for size in lengths.get(c, none):
                    if size > end:
                        break
                    score = model.get(text[end - size : end])
                    if score is not None:
                        score += best[end - size]
                        if score > top or score == top and tokens[end - size] < n:
                            top, n = score, tokens[end - size] + 1
                best.append(top)
                tokens.append(n)
            last = text
            yield word, tokens[-1]


#: Of this worker, over its tasks.
_known: dict[int, dict[str, int]] = {}


def _count(model: dict[str, float]):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(model)
        known = _known.setdefault(hash(frozenset(model.items())), {})
        for batch in batches:
            for part, buf, off in chunks(batch, size=SHARE):
                if len(known) > MEMORY:
                    known.clear()
                raw = buf.tobytes()
                texts = [split(raw[x:y].decode()) for x, y in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
                known.update(counter.counts(set().union(*texts).difference(known)))
                get = known.__getitem__
                yield pa.record_batch([part.column(0), pa.array(map(len, texts), pa.int64()), pa.array([sum(map(get, t)) for t in texts], pa.int64())], names=["doc_id", "n_pretokens", "n_tokens"])

    return count


def split(text: str) -> list[str]:
    """Pre-tokens: the words between spaces and the controls 09 to 0D."""
    if text.isascii() and not any(c in text for c in "\x1c\x1d\x1e\x1f"):
        return text.split()
    return re.findall("[^ \t-\r]+", text)


def token_counts(docs: DataFrame, model: dict[str, float]) -> DataFrame:
    """(doc_id, n_pretokens, n_tokens) of each row's whole text. Nothing is shuffled: each worker keeps the counts of the pre-tokens it
    has met. A null or empty text has none; null and repeated ids stay rows of their own; no rows give no rows; extra columns are
    ignored."""
    return docs.select("doc_id", "text").mapInArrow(_count(model), "doc_id long, n_pretokens long, n_tokens long")
