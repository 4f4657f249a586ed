"""SentencePiece encoding that keeps offsets, and decoding, without the library.

Normalisation walks the text by the longest prefix that the model's compiled character map knows
and notes for each character of the normal form which original bytes it came from. The normal form is cut
before each run of space marks that follows another character; where no piece of the vocabulary has
such a mark inside (checked), no merge can cross a cut. Nor can one between two characters that no piece has
side by side. So the merges of what lies between cuts are found once and kept; of many texts at once the
different words are found first and all their merges made together, one of each part at a time.
Each piece is then projected through the alignment onto a span of original bytes.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from array import array
from collections.abc import Iterator
from functools import cached_property, lru_cache
from itertools import accumulate
from operator import add

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Words whose ids a worker keeps at most in each of two generations, and as many parts of words.
KEPT = 160_000
#: Bytes of text whose words meet at once, one text at least.
TOGETHER = 1 << 20
#: Words whose ids are laid out as texts at once, one text at least.
WORDS = 1 << 14
#: Characters of a part from which its merges are made by a heap.
LONG = 256


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            n = varint() if kind == 2 else 4 if kind == 5 else 8
            yield tag >> 3, data[at : at + n]
            at += n


def charsmap(blob: bytes) -> dict[bytes, bytes]:
    """The compiled character map as prefix -> replacement: a double-array trie's size, its units, then the replacements."""
    if not blob:
        return {}
    size = struct.unpack_from("<I", blob)[0]
    units, pool, found = struct.unpack_from(f"<{size // 4}I", blob, 4), blob[4 + size :], {}

    def child(node: int) -> int:
        unit = units[node]
        return node ^ ((unit >> 10) << ((unit & (1 << 9)) >> 6))

    todo = [(child(0), b"")]
    while todo:
        base, prefix = todo.pop()
        for byte in range(1, 256):
            node = base ^ byte
            if node < len(units) and units[node] & 0x800000FF == byte:
                key = prefix + bytes([byte])
                if units[node] >> 8 & 1:
                    at = units[child(node)] & 0x7FFFFFFF
                    found[key] = pool[at : pool.index(b"\0", at)]
                todo.append((child(node), key))
    return found


class Codec:
    """Encoder and decoder of one model file of the BPE kind."""

    def __init__(self, data: bytes):
        self.pieces, self.dummy, self.squeeze, self.escape, table = [], True, True, True, b""
        for number, value in _fields(data):
            if number == 1:
                own = dict(_fields(value))
                self.pieces.append((own[1].decode(), struct.unpack("<f", own.get(2, b"\0\0\0\0"))[0], own.get(3, NORMAL)))
            elif number == 2:
                if dict(_fields(value)).get(3, 1) != 2:
                    raise ValueError("only BPE models are known here")
            elif number == 3:
                own = dict(_fields(value))
                table, self.dummy, self.squeeze, self.escape = own.get(2, b""), bool(own.get(3, 1)), bool(own.get(4, 1)), bool(own.get(5, 1))
        kinds = {k for _, _, k in self.pieces}
        if kinds & {USER, UNUSED} or any(MARK in p.lstrip(MARK) for p, _, k in self.pieces if k == NORMAL):
            raise ValueError("models with user-defined or unused pieces, or with space marks inside a piece, are not known here")
        self.rank, self.none = {p: -score for p, score, k in self.pieces if k == NORMAL}, float("inf")
        self.ids = {p: i for i, (p, _, k) in enumerate(self.pieces) if k == NORMAL}
        self.bytes = {int(p[1:-1], 16): i for i, (p, _, k) in enumerate(self.pieces) if k == BYTE}
        self.unknown = next(i for i, (_, _, k) in enumerate(self.pieces) if k == UNKNOWN)
        self.map = {k.decode("utf-8", "surrogateescape"): v.decode() for k, v in charsmap(table).items()}
        longest = sorted(self.map, key=len, reverse=True)
        self.known = re.compile("|".join(map(re.escape, longest))) if longest else None
        self.unit = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
        #: Ranks of characters that some piece has side by side; infinite where the two are no piece.
        self.beside = {p[i : i + 2]: self.rank.get(p[i : i + 2], self.none) for p in self.ids for i in range(len(p) - 1)}
        self.decimal = [str(i) for i in range(len(self.pieces))]
        #: What an id decodes to, in UTF-8. Other pieces begin and end with whole characters, so a run of bytes decodes the same among them.
        self.raws = [bytes([int(p[1:-1], 16)]) if k == BYTE else " ⁇ ".encode() if k == UNKNOWN else b"" if k == CONTROL else p.replace(MARK, " ").encode() for p, _, k in self.pieces]
        self.plain = self.dummy and self.escape and not self.squeeze and not self.map and len(self.bytes) == 256
        #: A piece's id and the bytes it stands for where a mark stands for one space, as 32-bit numbers.
        self.rows = {p: array("i", [i, len(p.replace(MARK, " ").encode("utf-8", "surrogateescape"))]).tobytes() for p, i in self.ids.items()}
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def normalize(self, text: str) -> tuple[str, list[tuple[int, int]]]:
        """The normal form, and for each of its characters the span of original bytes that it stands for."""
        out, spans, at, i = [], [], 0, 0
        if not self.known:  # each character stands for itself
            ends = list(accumulate([1] * len(text) if text.isascii() else [len(c.encode("utf-8", "surrogateescape")) for c in text]))
            out, spans, i = list(text.replace(" ", MARK) if self.escape else text), list(zip([0, *ends], ends, strict=False)), len(text)
        while i < len(text):
            m = self.known.match(text, i) if self.known else None
            old = m[0] if m else text[i]
            n = len(old.encode("utf-8", "surrogateescape"))
            for c in self.map[old] if m else old:
                out.append(MARK if c == " " and self.escape else c)
                spans.append((at, at + n))
            at, i = at + n, i + len(old)
        if self.squeeze:
            space, kept = MARK if self.escape else " ", []
            for k, c in enumerate(out):
                if c != space or (kept and out[kept[-1]] != space):
                    kept.append(k)
            while kept and out[kept[-1]] == space:
                kept.pop()
            out, spans = [out[k] for k in kept], [spans[k] for k in kept]
        if self.dummy and out:
            out.insert(0, MARK if self.escape else " ")
            spans.insert(0, (spans[0][0], spans[0][0]))
        return "".join(out), spans

    def normal_form(self, text: str) -> str:
        """normalize() without spans: quick where the map is empty."""
        if self.known or self.squeeze or not self.escape:
            return self.normalize(text)[0]
        text = text.replace(" ", MARK)
        return MARK + text if self.dummy and text else text

    def merge(self, unit: str) -> list[str]:
        """The unit's symbols after merging the best-scored neighbours, leftmost first, until no pair is a piece."""
        return [s for part, ranks in self._cut(unit) for s in self._merge(part, ranks)]

    def cut(self, unit: str) -> list[str]:
        """The unit cut between characters that no piece has side by side."""
        return [part for part, _ in self._cut(unit)]

    def _cut(self, unit: str) -> list[tuple[str, list[float]]]:
        """cut(), each part with the ranks of its neighbouring characters."""
        ranks = list(map(self.beside.get, map(add, unit, unit[1:])))
        if None not in ranks:
            return [(unit, ranks)]
        at = [0, *(k for k, r in enumerate(ranks, 1) if r is None), len(unit)]
        return [(unit[a:b], ranks[a : b - 1]) for a, b in zip(at, at[1:], strict=False)]

    def _merge(self, unit: str, pairs: list[float] | None = None) -> list[str]:
        """Symbols of a part. pairs, which it uses up: the ranks of its neighbouring characters, if known."""
        if len(unit) > LONG:
            return self._merge_long(unit)
        symbols, rank, none = list(unit), self.rank.get, self.none
        if pairs is None:
            pairs = [rank(a + b, none) for a, b in zip(unit, unit[1:], strict=False)]
        while pairs and (best := min(pairs)) < none:
            at = pairs.index(best)
            both = symbols[at] = symbols[at] + symbols.pop(at + 1)
            del pairs[at]
            if at < len(pairs):
                pairs[at] = rank(both + symbols[at + 1], none)
            if at:
                pairs[at - 1] = rank(symbols[at - 1] + both, none)
        return symbols

    def _merge_long(self, unit: str) -> list[str]:
        """The same with a heap, for units whose pairs take long to scan."""
        symbols, rank = list(unit), self.rank
        after, before = list(range(1, len(symbols) + 1)), list(range(-1, len(symbols) - 1))
        heap = []

        def offer(a: int) -> None:
            b = after[a]
            if b < len(symbols) and (r := rank.get(symbols[a] + symbols[b])) is not None:
                heapq.heappush(heap, (r, a, b, symbols[a] + symbols[b]))

        for a in range(len(symbols) - 1):
            offer(a)
        while heap:
            _, a, b, both = heapq.heappop(heap)
            if symbols[a] is None or after[a] != b or symbols[a] + (symbols[b] or "\0") != both:
                continue
            symbols[a], symbols[b], after[a] = both, None, after[b]
            if after[b] < len(symbols):
                before[after[b]] = a
            offer(a)
            if before[a] >= 0:
                offer(before[a])
        return [s for s in symbols if s is not None]

    def unit_ids(self, unit: str) -> tuple[list[int], list[int]]:
        """Ids of a unit, and for each the number of characters it ends (0 for all but a character's last byte)."""
        ids, ends = [], []
        for s in self.merge(unit):
            if (i := self.ids.get(s)) is not None:
                ids.append(i)
                ends.append(len(s))
            elif self.bytes:
                raw = s.encode("utf-8", "surrogateescape")
                ids += [self.bytes[x] for x in raw]
                ends += [0] * (len(raw) - 1) + [len(s)]
            else:
                ids.append(self.unknown)
                ends.append(len(s))
        return ids, ends

    def encode(self, text: str) -> list[int]:
        return [i for unit in self.unit.findall(self.normal_form(text)) for i in self.unit_ids(unit)[0]]

    def encode_spans(self, text: str) -> list[tuple[int, int, int]]:
        """(id, start, end) of each piece: the original bytes it stands for; bytes of one character share its span."""
        form, spans = self.normalize(text)
        out, at = [], 0
        for unit in self.unit.findall(form):
            ids, ends = self.unit_ids(unit)
            for k, i in enumerate(ids):
                n = ends[k] or next(x for x in ends[k:] if x)
                out.append((i, spans[at][0], spans[at + n - 1][1]))
                at += ends[k]
        return out

    def _decode(self, ids: list[int]) -> str:
        """Text of ids, space marks as spaces; runs of byte pieces as UTF-8."""
        return b"".join(map(self.raws.__getitem__, ids)).decode("utf-8", "replace")

    def decode(self, ids: list[int]) -> str:
        text = self._decode(ids)
        return text[1:] if self.dummy and text.startswith(" ") else text

    def aligned(self, text: str) -> tuple[list[int], np.ndarray]:
        """Ids and, for each, the span of original bytes: equal to encode_spans(), kept by word."""
        if self.plain and MARK not in text and "  " not in text and text[:1] not in ("", " ") and text[-1] != " ":
            kept = self.words  # every unit is a word with one mark before it; the first mark is the dummy
            rows = np.frombuffer(b"".join([kept.get(w) or self._word(w) for w in text.split(" ")]), np.int32)
            ids, size = rows[::2], rows[1::2]
            ends = np.cumsum(size, dtype=np.int64) - 1  # the dummy stands for no byte
            starts = np.maximum(ends - size, 0)
            if not size.all():  # all bytes of a character share its span
                whole = np.flatnonzero(size)
                at = whole[np.searchsorted(whole, np.arange(len(size)))]
                starts, ends = starts[at], ends[at]
            return ids.tolist(), np.column_stack((starts, ends))
        pieces = self.encode_spans(text)
        return [i for i, _, _ in pieces], np.array([x[1:] for x in pieces], np.int64).reshape(-1, 2)

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of ids, the ids joined by commas, the text decoded from them."""
        return self.digest_spans(text)[:3]

    def digest_spans(self, text: str) -> tuple[int, str, str, bytes]:
        """digest() and the pieces' spans: start and end of each as little-endian 64-bit numbers."""
        ids, spans = self.aligned(text)
        return len(ids), ",".join(map(self.decimal.__getitem__, ids)), self.decode(ids), spans.astype("<i8").tobytes()

    @cached_property
    def tables(self) -> Tables:
        return Tables(self)

    def digest_texts(self, texts: pa.Array) -> Iterator[tuple[int, bytes, bytes, bytes]]:
        """digest_spans() of each text, all in UTF-8."""
        size = np.cumsum(np.concatenate(([0], pc.binary_length(texts).to_numpy(zero_copy_only=False))))
        a = 0
        while a < len(texts):
            b = max(a + 1, int(np.searchsorted(size, size[a] + TOGETHER, "right")) - 1)
            yield from self._digest_together(texts.slice(a, b - a))
            a = b

    def _digest_together(self, texts: pa.Array) -> Iterator[tuple[int, bytes, bytes, bytes]]:
        # here a mark is a space: texts with marks of their own are walked, and so are all by other models
        own = pc.match_substring(texts, MARK).to_numpy(zero_copy_only=False) if self.plain else np.ones(len(texts), bool)
        empty = pc.equal(texts, "").to_numpy(zero_copy_only=False)
        if self.plain:
            some = self.tables.digest_texts(texts.filter(pa.array(~own & ~empty)))
        for k in range(len(texts)):
            if empty[k]:
                yield 0, b"", b"", b""
            elif own[k]:
                n, ids, decoded, spans = self.digest_spans(texts[k].as_py())
                yield n, ids.encode(), decoded.encode(), spans
            else:
                yield next(some)

    def _word(self, word: str) -> bytes:
        """What _part() gives of a word's parts. Kept by generation: when the newer one is full it becomes the older."""
        got = self.older.get(word)
        if got is None:
            kept, parts = self.parts, self._cut(MARK + word)
            if len(parts) == 1:  # kept as a word
                got = self._part(*parts[0])
            else:
                got = b"".join([kept.get(part) or self._kept_part(part, ranks) for part, ranks in parts])
        if len(word) <= 64:
            if len(self.words) >= KEPT:
                self.older = dict(self.words)
                self.words.clear()
            self.words[word] = got
        return got

    def _part(self, part: str, ranks: list[float]) -> bytes:
        """A part's ids, each with the number of original bytes that it ends (0 for all but a character's last byte), as 32-bit numbers."""
        rows, row = [], self.rows.get
        for s in self._merge(part, ranks):
            if (got := row(s)) is None:  # a character that is no piece: its bytes
                raw = s.encode("utf-8", "surrogateescape")
                got = array("i", [x for b in raw[:-1] for x in (self.bytes[b], 0)] + [self.bytes[raw[-1]], 1 if s == MARK else len(raw)]).tobytes()
            rows.append(got)
        return b"".join(rows)

    def _kept_part(self, part: str, ranks: list[float]) -> bytes:
        got = self._part(part, ranks)
        if len(part) <= 64:
            if len(self.parts) >= KEPT:
                self.parts.clear()
            self.parts[part] = got
        return got


class Tables:
    """A codec as arrays, to encode many texts at once. Symbols are numbers: a piece's id, then characters that are no piece, last all unknown ones."""

    def __init__(self, codec: Codec):
        self.codec, self.n = codec, len(codec.pieces)
        number = dict(codec.ids)
        for c in sorted({c for p in codec.ids for c in p} - number.keys()):
            number[c] = self.n + len(number) - len(codec.ids)
        self.number, self.base = number, self.n + len(number) - len(codec.ids) + 1
        self.of_char = np.full(0x110000, self.base - 1, np.int32)
        for c, k in number.items():
            if len(c) == 1:
                self.of_char[ord(c)] = k
        pairs = {number[p[k]] * self.base + number[p[k + 1]]: -1 for p in codec.ids for k in range(len(p) - 1)}
        pairs |= {number[p[:k]] * self.base + number[p[k:]]: i for p, i in codec.ids.items() for k in range(1, len(p)) if p[:k] in number and p[k:] in number}
        pairs[self.base**2] = -2  # behind all pairs
        self.pairs = np.array(sorted(pairs), np.int64)
        #: What two symbols merge to; -1: nothing, but some piece has them side by side.
        self.merged = np.array([pairs[x] for x in self.pairs.tolist()], np.int32)
        places = {r: k for k, r in enumerate(sorted(set(codec.rank.values())))}
        self.none = len(places)
        #: A piece's place in the order of merges; the last two are those of -2 and -1.
        self.rank = np.full(self.n + 2, self.none, np.int64)
        for p, i in codec.ids.items():
            self.rank[i] = places[codec.rank[p]]
        self.of_byte = np.array([codec.bytes[k] for k in range(256)], np.int32)
        self.decimal = pa.array([f"{d},".encode() for d in codec.decimal], pa.large_binary())
        self.raws = pa.array(codec.raws, pa.large_binary())

    def _meet(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """What pairs of symbols merge to, -1 or, where no piece has them side by side, -2."""
        pair = left * np.int64(self.base) + right
        at = np.searchsorted(self.pairs, pair)
        return np.where(self.pairs[at] == pair, self.merged[at], np.int32(-2))

    def merge(self, symbols: np.ndarray, ends: np.ndarray, text: str) -> np.ndarray:
        """For each character of units of text that end at `ends`: the symbol that begins there after all merges, or -1."""
        out, n = np.full(len(symbols), -1, np.int32), len(symbols)
        to = np.full(n, -2, np.int32)
        to[:-1] = self._meet(symbols[:-1], symbols[1:])
        to[ends - 1] = -2
        cuts = np.flatnonzero(to == -2) + 1
        size = np.diff(cuts, prepend=0)
        if (long := np.flatnonzero(size > LONG)).size:
            for k in long:
                at = cuts[k] - size[k]
                for s in self.codec._merge_long(text[at : cuts[k]]):
                    out[at] = self.number.get(s, self.base - 1)
                    at += len(s)
            to[np.repeat(size > LONG, size)] = -3
        at = np.flatnonzero(to != -3)
        size, symbols, to = size[size <= LONG], symbols[at], to[at]
        while len(size):
            starts = np.cumsum(size) - size
            best = np.minimum.reduceat(self.rank[to] << 32 | np.arange(len(to)), starts)
            live = best >> 32 < self.none
            keep = np.repeat(live, size)
            out[at[~keep]] = symbols[~keep]
            where, gone = best[live] & 0xFFFFFFFF, np.cumsum(np.where(live, 1, size))[live] - 1
            symbols[where] = to[where]
            keep[where + 1] = False
            at, symbols, to, size = at[keep], symbols[keep], to[keep], size[live] - 1
            where -= gone
            ends = np.cumsum(size)
            has = where + 1 < ends
            to[where] = -1
            a = where[has]
            to[a] = self._meet(symbols[a], symbols[a + 1])
            a = where[where > ends - size] - 1
            to[a] = self._meet(symbols[a], symbols[a + 1])
        return out

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of words, each after a mark; the original bytes each id ends (0 for all but a character's last byte); ids of each word."""
        text = MARK + MARK.join(words)
        chars = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        found = self.merge(self.of_char[chars], ends, text)
        at = np.flatnonzero(found >= 0)
        ids = found[at]
        raw = 1 + (chars >= 0x80).astype(np.int64) + (chars >= 0x800) + (chars >= 0x10000)
        size = np.add.reduceat(np.where(chars == ord(MARK), 1, raw), at)
        bounds = np.searchsorted(at, ends)
        if (ids >= self.n).any():  # characters that are no piece: their bytes
            times = np.where(ids < self.n, 1, raw[at])
            last = np.cumsum(times)
            from_byte = np.repeat(ids >= self.n, times)
            place = np.repeat((np.cumsum(raw) - raw)[at] - last + times, times) + np.arange(last[-1])
            ids, whole = np.repeat(ids, times), size
            ids[from_byte] = self.of_byte[np.frombuffer(text.encode(), np.uint8)[place[from_byte]]]
            size = np.zeros(len(ids), np.int64)
            size[last - 1] = whole
            bounds = last[bounds - 1]
        return ids, size, np.diff(bounds, prepend=0)

    def digest_texts(self, texts: pa.Array) -> Iterator[tuple[int, bytes, bytes, bytes]]:
        """Codec.digest_spans() of texts that are not empty and have no marks, in UTF-8."""
        if not len(texts):
            return
        # of a run of spaces the first one cuts, the others stay with what follows, as do all before the first word
        runs = pc.or_(pc.match_substring(texts, "  "), pc.starts_with(texts, " "))
        if pc.any(runs).as_py():
            texts = pc.if_else(runs, pc.replace_substring_regex(pc.replace_substring(texts, " ", MARK), f"([^{MARK}]){MARK}", r"\1 "), texts)
        split = pc.split_pattern(texts, " ")
        words = split.flatten().dictionary_encode()
        ids, size, counts = self.encode_words(words.dictionary.to_pylist())
        code, first, last, a, k = words.indices.to_numpy(), np.cumsum(counts) - counts, np.cumsum(pc.list_value_length(split).to_numpy()), 0, 0
        while k < len(last):  # of some texts at a time what their words say
            to = max(k + 1, int(np.searchsorted(last, a + WORDS, "right")))
            some = code[a : last[to - 1]]
            many = counts[some]
            ends = np.cumsum(many)
            take = np.repeat(first[some] - ends + many, many) + np.arange(ends[-1])
            yield from self._digests(ids[take], size[take], np.concatenate(([0], ends[last[k:to] - a - 1])))
            a, k = last[to - 1], to

    def _digests(self, ids: np.ndarray, size: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, bytes, bytes, bytes]]:
        """digest_texts() from the ids of texts one after another, the original bytes each id ends, and where texts begin and end."""
        ends, per = np.cumsum(size), np.diff(bounds)
        ends -= np.repeat(np.concatenate(([0], ends[bounds[1:-1] - 1])) + 1, per)  # the dummy stands for no byte
        starts = np.maximum(ends - size, 0)
        if not size.all():  # all bytes of a character share its span
            whole = np.flatnonzero(size)
            at = whole[np.searchsorted(whole, np.arange(len(size)))]
            starts, ends = starts[at], ends[at]
        spans = memoryview(np.column_stack((starts, ends)).astype("<i8", copy=False)).cast("B")
        joined, decoded = (self._joined(table, ids, bounds) for table in (self.decimal, self.raws))
        for k, n in enumerate(per.tolist()):
            text = str(next(decoded), "utf-8", "replace")
            yield n, next(joined)[:-1], text.removeprefix(" ").encode(), spans[16 * bounds[k] : 16 * bounds[k + 1]]

    @staticmethod
    def _joined(table: pa.Array, ids: np.ndarray, bounds: np.ndarray) -> Iterator[memoryview]:
        """What the table has for the ids of each text, joined."""
        got = table.take(pa.array(ids))
        _, places, data = got.buffers()
        at, data = np.frombuffer(places, np.int64)[bounds].tolist(), memoryview(data)
        for a, b in zip(at, at[1:], strict=False):
            yield data[a:b]


@lru_cache(maxsize=1)
def codec_of(data: bytes) -> Codec:
    """One codec for a worker process: what it keeps serves all tasks that the process runs."""
    return Codec(data)


ENCODED = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
WITH_SPANS = f"{ENCODED}, spans_sha256 string"


def model_of(spark: SparkSession, path: str):
    """The model's bytes, read once on the driver and sent to the executors (half a megabyte for 32,000 pieces)."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encode_documents(docs: DataFrame, model: str, spans: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, ids_sha256, decoded_sha256; with `spans`, spans_sha256 (of digest_spans()) as well.

    Null text is empty: no ids, digests of the empty string. Whole texts are encoded. A null doc_id and
    repeated rows each get their row; an empty table gives none; other columns are ignored.
    """
    data = model_of(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, sha = codec_of(data.value), lambda b: hashlib.sha256(b).hexdigest()
        for batch in batches:
            sizes, ids, decoded, places = [], [], [], []
            for n, i, d, p in codec.digest_texts(batch.column("text")):
                sizes.append(n), ids.append(sha(i)), decoded.append(sha(d)), places.append(sha(p))
            columns = {"doc_id": batch.column("doc_id"), "n_tokens": pa.array(sizes, pa.int64())} | {k: pa.array(v, pa.string()) for k, v in (("ids_sha256", ids), ("decoded_sha256", decoded), ("spans_sha256", places))}
            if not spans:
                del columns["spans_sha256"]
            yield pa.RecordBatch.from_pydict(columns)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, WITH_SPANS if spans else ENCODED)


def encode_pieces(docs: DataFrame, model: str) -> DataFrame:
    """doc_id and pieces: array of (id, start, end), the original UTF-8 bytes of each piece; null text has none."""
    data = model_of(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(data.value)
        kind = pa.list_(pa.struct([("id", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            got = [[{"id": i, "start": a, "end": b} for i, a, b in codec.encode_spans(t)] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(got, kind)], names=["doc_id", "pieces"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "doc_id long, pieces array<struct<id:int,start:bigint,end:bigint>>")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op9(spark, sf_dir: str) -> DataFrame:
    return encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_model(), spans=True)
