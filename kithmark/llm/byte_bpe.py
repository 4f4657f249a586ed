"""Byte-level BPE encoding and decoding by a rank file, without the library.

A text is cut by a pattern into pre-tokens. Within one, the pair of neighbours whose joined bytes have the least
rank merges first, the leftmost of equals. The queue of pairs is a hierarchical bitmap: a bit for each merge rank that has
pairs, and a bit above for each word of 64 bits that isn't zero. A rank's bucket holds
the positions of its pairs in a linked list of the pre-token's parts; finding the first set bit from the top down
gives the least rank in as many steps as there are levels, and positions whose pair has changed since are stale and
skipped. Pre-tokens don't touch each other, so one queue serves all new ones of some megabytes of text, and a bucket's merges are made at once. So a pre-token of n bytes takes time in proportion to n (a sort of each bucket apart), however long it is.

Where a merge opens a pair of lesser rank, which the merges made at once could pass over, that pre-token is done again by itself, merge by merge. What a short pre-token gives is kept in the worker and found again by its text.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Pre-tokens that a worker keeps at most in each of two generations, and their longest.
KEPT, LONGEST = 200_000, 64
#: Characters of text whose pre-tokens are looked at together; a longer text is alone.
TOGETHER = 4_000_000

#: Letters and numbers of the regex module's Unicode tables that the tokenizer library's older tables (Unicode 16) don't have.
NEWER = (
    "\u0558\u058b\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce\ua7cf\ua7d2\ua7d4\ua7dd\ua7e2\ua7f1\uab6c\uab6d\U000107bb-\U000107bf\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee"
    "\U00011b0a\U00011db0-\U00011ddb\U00011de0-\U00011de9\U00011df1\U0001246f\U00012475-\U0001247f\U00012550-\U00012686\U00016ea0-\U00016eb8\U00016ebb-\U00016ed3\U00016ff2-\U00016ff6\U000187f8-\U000187ff"
    "\U00018cd6-\U00018cda\U00018d09-\U00018d20\U00018d80-\U00018df2\U00018e00-\U00019191\U000191a0-\U000191d2\U0001b123-\U0001b128\U0001b168\U0001d6a6\U0001df1f-\U0001df24\U0001df2b-\U0001df81"
    "\U0001df90-\U0001df96\U0001dfcd-\U0001dfff\U0001e6c0-\U0001e6de\U0001e6e0-\U0001e6e2\U0001e6e4\U0001e6e5\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4\U0001e6fe\U0001e6ff\U0002b73a-\U0002b73f\U0002b81e"
    "\U0002cea2-\U0002cead\U000323b0-\U00033479\U0003d000-\U0003fc3f"
)


_BITS = [1 << k for k in range(64)]


class RankQueue:
    """Positions by rank, least rank first: a bucket for each rank, a bit for each bucket in words of 64, and a bit for each word that isn't zero.

    The upper bits are one integer of as many bits as there are words; its own digits are a further level.
    """

    __slots__ = ("buckets", "top", "words")

    def __init__(self):
        self.buckets: dict[int, list] = {}
        self.words: dict[int, int] = {}
        self.top = 0

    def push(self, rank: int, position) -> None:
        buckets = self.buckets
        if rank in buckets:
            buckets[rank].append(position)
            return
        buckets[rank] = [position]
        at, words = rank >> 6, self.words
        if at in words:
            words[at] |= _BITS[rank & 63]
        else:
            words[at] = _BITS[rank & 63]
            self.top |= 1 << at

    def pop(self) -> tuple[int, list]:
        """(least rank, what was pushed for it), taken out. Only while `top` isn't zero."""
        top = self.top
        first = top & -top
        at = first.bit_length() - 1
        word = self.words[at]
        bit = word & -word
        if word == bit:
            del self.words[at]
            self.top = top ^ first
        else:
            self.words[at] = word ^ bit
        rank = at << 6 | bit.bit_length() - 1
        return rank, self.buckets.pop(rank)


def cutter(pattern: str) -> Callable[[str], list[str]]:
    """text -> its pre-tokens. The pattern may use \\p{L}, \\p{N} and [^\\s\\p{L}\\p{N}]; other classes mean what the regex module says."""
    whole = regex.compile(pattern)
    newer, late = re.compile(f"[{NEWER}]"), re.compile(f"[{NEWER[0]}-\U0010ffff]")  # the latter is one range, so it is quick to rule out
    other = r"[^\s\p{L}\p{N}]"
    narrow = pattern.replace(other, "\0").replace(r"\p{L}", rf"(?:(?![{NEWER}])\p{{L}})").replace(r"\p{N}", rf"(?:(?![{NEWER}])\p{{N}})").replace("\0", rf"(?:{other}|[{NEWER}])")
    narrow = regex.compile(narrow)
    plain = pattern.replace(other, r"[^\sA-Za-z0-9]").replace(r"\p{L}", "[A-Za-z]").replace(r"\p{N}", "[0-9]")
    plain = re.compile(plain, re.ASCII).findall if r"\p" not in plain else whole.findall

    def cut(text: str) -> list[str]:
        if text.isascii():
            return plain(text)
        return (narrow if late.search(text) and newer.search(text) else whole).findall(text)

    return cut


class ByteBpe:
    def __init__(self, ranks: bytes, pattern: str):
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in ranks.splitlines() if line)}
        if missing := [b for b in range(256) if bytes([b]) not in self.ranks]:
            raise ValueError(f"the rank file lacks bytes {missing}")
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.cut = cutter(pattern)
        self.pairs = {token[0] << 8 | token[1]: rank for token, rank in self.ranks.items() if len(token) == 2}
        # All pairs of tokens whose bytes are a token, by (left, right).
        joins = [(self.ranks[token[:k]] << 32 | self.ranks[token[k:]], rank) for token, rank in self.ranks.items() for k in range(1, len(token)) if token[:k] in self.ranks and token[k:] in self.ranks]
        self.join_keys, self.join_ranks = np.array(sorted(joins) or [(-1, -1)], np.int64).T.copy()
        self.of_byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        self.kept: dict[str, tuple[str, bytes]] = {}
        self.older: dict[str, tuple[str, bytes]] = {}

    def merge(self, raw: bytes) -> list[int]:
        """Ids of a pre-token's bytes."""
        whole = self.ranks.get(raw)
        if whole is not None:
            return [whole]
        n, rank_of, queue = len(raw), self.ranks.get, RankQueue()
        push, bytes_of = queue.push, self.pairs
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank_at = [bytes_of.get(raw[i] << 8 | raw[i + 1], -1) for i in range(n - 1)]  # of the pair that begins there; -1 if none does
        rank_at.append(-1)
        for i, rank in enumerate(rank_at):
            if rank >= 0:
                push(rank, i)
        while queue.top:
            rank, bucket = queue.pop()
            bucket.sort()
            for k, i in enumerate(bucket):
                if rank_at[i] != rank:  # stale: merged, or its neighbour is another by now
                    continue
                j = after[i]
                end = after[i] = after[j]
                rank_at[j] = -1
                if end < n:
                    before[end] = i
                    new = rank_at[i] = rank_of(raw[i : after[end]], -1)
                    if new >= 0:
                        push(new, i)
                else:
                    new = rank_at[i] = -1
                b, other = before[i], -1
                if b >= 0:
                    other = rank_of(raw[b:end], -1)
                    if other != rank_at[b]:
                        rank_at[b] = other
                        if other >= 0:
                            push(other, b)
                if 0 <= new < rank or 0 <= other < rank:
                    for rest in bucket[k + 1 :]:  # a lesser rank comes first, in vocabularies that allow it
                        if rank_at[rest] == rank:
                            push(rank, rest)
                    break
        ids, i = [], 0
        while i < n:
            ids.append(self.ranks[raw[i : after[i]]])
            i = after[i]
        return ids

    def _ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of the joined bytes of two tokens each, -1 where they are none."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.join_keys, key), len(self.join_keys) - 1)
        return np.where(self.join_keys[at] == key, self.join_ranks[at], -1)

    def merge_all(self, raws: list[bytes]) -> list[list[int]]:
        """Ids of each pre-token's bytes, all by one queue of arrays of positions in the joined bytes."""
        sizes = np.array([len(raw) for raw in raws], np.int64)
        ends = np.cumsum(sizes)
        n = int(ends[-1]) if len(raws) else 0
        token = self.of_byte[np.frombuffer(b"".join(raws), np.uint8)]
        start, end = np.repeat(ends - sizes, sizes), np.repeat(ends, sizes)
        after, before = np.arange(1, n + 1), np.arange(-1, n)
        rank_at = np.full(n + 1, -1)  # of the pair that begins there; -1 if none does
        inner = np.flatnonzero(after < end)
        rank_at[inner] = self._ranks_of(token[inner], token[inner + 1])
        queue, again = RankQueue(), []

        def push(at: np.ndarray) -> None:
            at = at[rank_at[at] >= 0]
            at = at[np.argsort(rank_at[at], kind="stable")]
            ranks = rank_at[at]
            cut = np.flatnonzero(np.diff(ranks)) + 1
            for rank, some in zip(ranks[np.append(0, cut)].tolist() if len(at) else [], np.split(at, cut), strict=False):
                queue.push(rank, some)

        push(inner)
        while queue.top:
            rank, bucket = queue.pop()
            at = np.unique(np.concatenate(bucket)) if len(bucket) > 1 else bucket[0]
            at = at[rank_at[at] == rank]  # others are stale: merged, or their neighbour is another by now
            if not len(at):
                continue
            over = rank_at[after[at]] == rank  # its right part begins a pair of the same rank: the left one takes it
            if over.any():
                keep, taken = np.ones(len(at), bool), -1
                for k in np.flatnonzero(over | np.append(False, over[:-1])).tolist():
                    if at[k] == taken:
                        keep[k] = False
                    else:
                        taken = after[at[k]]
                at = at[keep]
            right = after[at]
            follows = after[right]
            if len(at) > 1:  # pairs that are there only until the next of these merges
                near = np.flatnonzero((follows[:-1] == at[1:]) & (follows[:-1] < end[at[:-1]]))
                between = self._ranks_of(np.full(len(near), rank), token[at[near + 1]])
                again.append(start[at[near]][(between >= 0) & (between < rank)])
            after[at] = follows
            before[follows] = at
            token[at], token[right], rank_at[right] = rank, -1, -1
            prior = before[at]
            prior = prior[prior >= start[at]]
            rank_at[at] = -1
            new = np.concatenate((at[follows < end[at]], prior))
            rank_at[new] = opened = self._ranks_of(token[new], token[after[new]])
            again.append(start[new][(opened >= 0) & (opened < rank)])
            push(new)
        left = np.flatnonzero(token >= 0)
        bounds = np.searchsorted(left, ends).tolist()
        ids = token[left].tolist()
        out = [ids[a:b] for a, b in zip([0, *bounds], bounds, strict=False)]
        for k in np.searchsorted(ends, np.unique(np.concatenate(again)), "right").tolist() if again else []:
            out[k] = self.merge(raws[k])
        return out

    def encode(self, text: str) -> list[int]:
        return [i for ids in self._ids([piece.encode("utf-8", "surrogatepass") for piece in self.cut(text)]) for i in ids]

    def _ids(self, raws: list[bytes]) -> list[list[int]]:
        """Ids of each pre-token's bytes: its own rank if it is a token, else what merges leave."""
        whole = [self.ranks.get(raw) for raw in raws]
        merged = iter(self.merge_all([raw for raw, rank in zip(raws, whole, strict=True) if rank is None]))
        return [next(merged) if rank is None else [rank] for rank in whole]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def _keep(self, pieces: list[str]) -> dict[str, tuple[str, bytes]]:
        """New pre-tokens' ids joined by commas, and the bytes that they decode to. Short ones are kept by generation: when the newer one is full it becomes the older."""
        got = {}
        for piece, ids in zip(pieces, self._ids([piece.encode("utf-8", "surrogatepass") for piece in pieces]), strict=True):
            got[piece] = ",".join(map(str, ids)), self.decode(ids)
        if len(self.kept) + len(got) > KEPT:
            self.older, self.kept = self.kept, {}
        self.kept.update((piece, x) for piece, x in got.items() if len(piece) <= LONGEST)
        return got

    def digests(self, texts: list[str]) -> list[tuple[int, str, bytes]]:
        """For each text the number of ids, the ids joined by commas, the bytes decoded from them."""
        out, some, size = [], [], 0
        for text in texts:
            some.append(text)
            size += len(text)
            if size >= TOGETHER:
                out += self._digests(some)
                some, size = [], 0
        return out + self._digests(some)

    def _digests(self, texts: list[str]) -> list[tuple[int, str, bytes]]:
        cuts = [self.cut(text) for text in texts]
        every = set().union(*cuts)
        known = {piece: x for piece in every if (x := self.kept.get(piece) or self.older.get(piece)) is not None}
        known |= self._keep([piece for piece in every if piece not in known])
        out = []
        for cut in cuts:
            parts = [known[piece] for piece in cut]
            ids = ",".join([p[0] for p in parts])
            out.append((ids.count(",") + 1 if parts else 0, ids, b"".join([p[1] for p in parts])))
        return out


@lru_cache(maxsize=1)
def codec_of(ranks: bytes, pattern: str) -> ByteBpe:
    """One codec for a worker process: what it keeps serves all tasks that the process runs."""
    return ByteBpe(ranks, pattern)


def vocabulary(spark: SparkSession, path: str | None, pattern: str | None):
    """(rank file's bytes, pattern), read once on the driver and sent to the executors (below a megabyte for 50,000 ranks)."""
    if path is None or pattern is None:
        import public_tokenizers

        path, pattern = path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), pattern or public_tokenizers.PATTERN
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast((f.read(), pattern))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def encode_documents(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, ids_sha256 (of the decimal ids joined by commas), decoded_sha256 (of the bytes they decode to).

    Null text is empty: no ids, digests of the empty string. Whole texts are encoded. A null doc_id and
    repeated rows each get their row; an empty table gives none; other columns are ignored, so none can clash.
    """
    data = vocabulary(docs.sparkSession, path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, sha = codec_of(*data.value), lambda b: hashlib.sha256(b).hexdigest()
        for batch in batches:
            sizes, ids, decoded = [], [], []
            for n, joined, raw in codec.digests(batch.column("text").to_pylist()):
                sizes.append(n), ids.append(sha(joined.encode())), decoded.append(sha(raw))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _texts(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_ids(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id and ids, an array of int; null text has none. Rows as in encode_documents()."""
    data = vocabulary(docs.sparkSession, path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(*data.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([codec.encode(t.as_py()) for t in batch.column("text")], pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return _texts(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode_ids(encoded: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id and raw, the bytes of (doc_id, ids); null ids give none. An id that the rank file lacks is an error."""
    data = vocabulary(encoded.sparkSession, path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(*data.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([codec.decode(i or []) for i in batch.column("ids").to_pylist()], pa.binary())], names=["doc_id", "raw"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, raw binary")


def op13(spark, sf_dir: str) -> DataFrame:
    return encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
