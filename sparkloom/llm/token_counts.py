"""Token counts of whole texts by rank-synchronous array merging.

Texts are cut into pre-tokens that no piece of the vocabulary can cross. Distinct pre-tokens
of a batch are held as one ragged numpy array of symbol ids; in every round each sequence
merges its lowest-rank adjacent pair (leftmost on ties), all sequences at once, until none
has a pair left; the surviving symbols are counted.

Defined cases: null or empty text has 0 tokens and 0 bytes; a text of white space only is
one pre-token; a pre-token of more than ``LONG`` symbols is merged by a heap instead
(the same merges, O(n log n)); repeated rows each get their count; other columns are ignored.
"""

from __future__ import annotations

import heapq
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SpanHash, pieces, read_table, utf8

#: Symbols of a pre-token above which rounds over the whole sequence cost too much.
LONG = 256
#: Pre-tokens whose counts a worker remembers; the memo is emptied when full.
MEMO = 500_000
NO_RANK = np.int64(1) << 40


def read_pieces(path: str) -> list[tuple[str, float, int]]:
    """(piece, score, type) of a sentencepiece model file, in id order.

    The file is a protocol buffer; field 1 repeats {1: piece, 2: float score, 3: type}.
    """

    def varint(b: bytes, i: int) -> tuple[int, int]:
        n = shift = 0
        while True:
            n |= (b[i] & 127) << shift
            shift, i = shift + 7, i + 1
            if b[i - 1] < 128:
                return n, i

    def fields(b: bytes) -> Iterator[tuple[int, object]]:
        i = 0
        while i < len(b):
            key, i = varint(b, i)
            if key & 7 == 0:
                value, i = varint(b, i)
            elif key & 7 == 2:
                n, i = varint(b, i)
                value, i = b[i : i + n], i + n
            else:
                n = 8 if key & 7 == 1 else 4
                value, i = b[i : i + n], i + n
            yield key >> 3, value

    with open(path, "rb") as f:
        whole = f.read()
    out = []
    for number, value in fields(whole):
        if number == 1:
            x = dict(fields(value))
            out.append((x[1].decode(), struct.unpack("<f", x[2])[0] if 2 in x else 0.0, x.get(3, 1)))
    return out


class Merger:
    """Counts of pieces by merging, for a vocabulary with byte fallback and a dummy prefix."""

    def __init__(self, vocabulary: list[tuple[str, float, int]]) -> None:
        normal = {p: s for p, s, kind in vocabulary if kind in (1, 4, 5)}
        letters = sorted({c for p in normal for c in p})
        self.symbol = {p: i for i, p in enumerate(dict.fromkeys([*letters, *normal]))}
        self.size = len(self.symbol) + 1  # one more: a character of no piece
        rank = {s: i for i, s in enumerate(sorted(set(normal.values()), reverse=True))}
        pairs = {}
        for p, s in normal.items():
            for i in range(1, len(p)):
                a, b = self.symbol.get(p[:i]), self.symbol.get(p[i:])
                if a is not None and b is not None:
                    pairs[a * self.size + b] = (rank[s], self.symbol[p])
        self.key = np.array(sorted(pairs), np.int64)
        self.rank = np.array([pairs[k][0] for k in self.key.tolist()], np.int64)
        self.made = np.array([pairs[k][1] for k in self.key.tolist()], np.int64)
        self.pairs = pairs
        self.lone = np.ones(self.size, np.int64)
        self.lone[[self.symbol[c] for c in letters if c not in normal]] = 0  # tokens of an unmerged letter: its bytes
        self.byte_len = {self.symbol[c]: len(c.encode()) for c in letters if c not in normal}
        for k, n in self.byte_len.items():
            self.lone[k] = n
        if any("▁" in p.lstrip("▁") for p in normal):
            raise ValueError("pieces with inner white space would cross pre-tokens")
        #: ASCII bytes in no piece; each is a token of its own and nothing merges over it.
        self.breaker = np.zeros(256, bool)
        for b in range(128):
            if chr(b) not in self.symbol and b != 0x20:
                self.breaker[b] = True

    def count(self, texts: list[str]) -> np.ndarray:
        """Tokens of each pre-token; a space stands for the white space symbol."""
        none = self.size - 1
        out = np.zeros(len(texts), np.int64)
        ragged, lengths, where = [], [], []
        for i, text in enumerate(texts):
            ids = [self.symbol.get(c, none) for c in text.replace(" ", "▁")]
            extra = sum(len(c.encode()) - 1 for c, k in zip(text, ids) if k == none) if none in ids else 0
            out[i] += extra
            if len(ids) > LONG:
                out[i] += self._heap(ids)
            elif ids:
                ragged.extend(ids)
                lengths.append(len(ids))
                where.append(i)
        self._rounds(np.array(ragged, np.int64), np.array(lengths, np.int64), np.array(where, np.int64), out)
        return out

    def _rounds(self, ids: np.ndarray, lengths: np.ndarray, where: np.ndarray, out: np.ndarray) -> None:
        while len(lengths):
            starts = np.cumsum(lengths) - lengths
            keys = np.full(len(ids), -1, np.int64)
            keys[:-1] = ids[:-1] * self.size + ids[1:]
            keys[starts + lengths - 1] = -1
            at = np.minimum(np.searchsorted(self.key, keys), len(self.key) - 1)
            known = self.key[at] == keys
            order = np.where(known, self.rank[at], NO_RANK) * (1 << 20) + (np.arange(len(ids)) - np.repeat(starts, lengths))
            best = np.minimum.reduceat(order, starts)
            live = best < NO_RANK << 20
            if not live.all():
                done = ~live
                tokens = np.add.reduceat(self.lone[ids], starts)
                out[where[done]] += tokens[done]
            if not live.any():
                return
            position = starts + (best & ((1 << 20) - 1))
            position = position[live]
            ids[position] = self.made[at[position]]
            keep = np.repeat(live, lengths)
            keep[position + 1] = False
            ids = ids[keep]
            lengths, where = lengths[live] - 1, where[live]

    def _heap(self, ids: list[int]) -> int:
        n = len(ids)
        ids, after, before = list(ids), [*range(1, n), -1], [-1, *range(n - 1)]
        heap = []

        def offer(i: int) -> None:
            j = after[i] if i >= 0 else -1
            if j >= 0 and (found := self.pairs.get(ids[i] * self.size + ids[j])):
                heapq.heappush(heap, (found[0], i, ids[i], j, ids[j], found[1]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, a, j, b, made = heapq.heappop(heap)
            if ids[i] != a or ids[j] != b or after[i] != j:
                continue
            ids[i], ids[j], after[i] = made, -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            offer(before[i])
            offer(i)
        return int(sum(self.lone[k] for k in ids if k >= 0))


class Counter:
    """Counts tokens of Arrow string columns, remembering distinct pre-tokens."""

    def __init__(self, merger: Merger) -> None:
        self.merger, self.hash, self.memo = merger, SpanHash(), {}

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        n_bytes = np.diff(utf8(column)[1])
        data, offsets = utf8(pc.replace_substring(column, "▁", " "))
        tokens = np.zeros(len(n_bytes), np.int64)
        for row, part, ends in pieces(data, offsets):
            tokens[row : row + len(ends) - 1] = self._part(part, ends)
        return n_bytes, tokens

    def _part(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        rows = np.flatnonzero(np.diff(offsets))
        out = np.zeros(len(offsets) - 1, np.int64)
        if not len(rows):
            return out
        text = np.insert(data, offsets[rows], 0x20)  # the prefix of every text
        lead = offsets[rows] + np.arange(len(rows))
        space, alone = text == 0x20, self.merger.breaker[text]
        first = alone.copy()
        first[1:] |= (space[1:] & ~space[:-1]) | alone[:-1]
        first[lead] = True
        starts = np.flatnonzero(first)
        ends = np.append(starts[1:], len(text))
        _, index, back = np.unique(self.hash(text, starts, ends), return_index=True, return_inverse=True)
        raw = text.tobytes()
        words = [raw[a:b] for a, b in zip(starts[index].tolist(), ends[index].tolist())]
        memo = self.memo
        if len(memo) > MEMO:
            memo.clear()
        new = [w for w in words if w not in memo]
        for i in range(0, len(new), 50_000):
            part = new[i : i + 50_000]
            memo.update(zip(part, self.merger.count([w.decode() for w in part]).tolist()))
        each = np.array([memo[w] for w in words], np.int64)[back]
        out[rows] = np.add.reduceat(each, np.searchsorted(starts, lead))
        return out


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None, limit: int = 4096) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every whole text.

    ``model``: path of the vocabulary file on the executors; None asks the installed
    ``public_tokenizers`` there for ``piece_bpe_32k.model``.
    """

    def run(batches):
        path = model
        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("piece_bpe_32k.model")
        counter = Counter(Merger(read_pieces(str(path))))
        for batch in batches:
            n_bytes, tokens = counter(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(tokens, pa.int64()), pa.array(tokens > limit)], ["id", "n_bytes", "n_tokens", "over_limit"])

    ids = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = ids.schema["id"].dataType.simpleString()
    return ids.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("id", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read_table(spark, sf_dir, "documents"))
