"""Packing of documents into fixed-length training sequences by minimum bin slack.

Every task packs the documents it reads, window by window, so nothing is shuffled. The full
lengths of a document (1024 tokens each by default) are sequences of their own; its tail
waits in a window of tails. A sequence takes the largest waiting tail and then the multiset of
waiting lengths that fills it closest to capacity: a bitset holds the sums that can be
reached with the lengths seen so far, one more length with its count at a time, and going
back through the bitsets gives how many tails of each length are taken. Where no multiset
fills a sequence, one tail is cut to fill it. What is left at the end of a task is shorter than
one sequence and is cut into sequences of a power of two, which need no padding.
"""

from __future__ import annotations

import base64
import zlib
from array import array
from collections import defaultdict
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tidewatch.llm.common import small_batches

#: Tails that wait in one window; more tails give fewer cuts and cost memory (4 KB each).
WINDOW = 4096
#: Least length of runs of white space that are cut out before the encoder, whose pattern fails on very long ones.
BLANKS = 100_000
BLANK_RUN = regex.compile(r"(?<!\s)\s{%d,}+" % BLANKS)
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def best_fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """Multiset of the given lengths (with counts) whose sum is the largest up to ``capacity``.

    Lengths enter from the largest to the smallest and the search ends when the capacity is
    reached. Returns counts by length; empty if no length fits.
    """
    goal, limit = 1 << capacity, (1 << (capacity + 1)) - 1
    reach, steps = 1, []
    for length in sorted((x for x in counts if 0 < x <= capacity), reverse=True):
        left, share = counts[length], 1
        while left:  # counts in binary shares: 1, 2, 4, ...
            take = min(share, left)
            if length * take > capacity:
                break
            wider = reach | (reach << (length * take)) & limit
            if wider != reach:
                steps.append((length, take, reach))
                reach = wider
            left -= take
            share *= 2
        if reach & goal:
            break
    total = reach.bit_length() - 1
    chosen: dict[int, int] = defaultdict(int)
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            chosen[length] += take
            total -= length * take
    return dict(chosen)


class Packer:
    """Packs the documents of one task; rows come out as tuples of ``SCHEMA``.

    Sequence ids start at ``first_id`` and count up. A document without tokens has no piece.
    """

    def __init__(self, first_id: int, size: int = 1024, window: int = WINDOW):
        self.size, self.window, self.next_id = size, window, first_id
        self.tails: dict[int, list[tuple[int, int, int, bytes]]] = defaultdict(list)
        self.waiting = 0

    def _sequence(self, pieces: list[tuple[int, int, int, bytes]]) -> Iterator[tuple]:
        offset = 0
        for doc, start, total, ids in pieces:
            n = len(ids) // 4
            yield doc, start, n, zlib.crc32(ids), total, self.next_id, offset
            offset += n
        self.next_id += 1

    def _wait(self, piece: tuple[int, int, int, bytes]) -> None:
        self.tails[len(piece[3]) // 4].append(piece)
        self.waiting += 1

    def _take(self, length: int) -> tuple[int, int, int, bytes]:
        piece = self.tails[length].pop()
        if not self.tails[length]:
            del self.tails[length]
        self.waiting -= 1
        return piece

    def _cut(self, piece: tuple[int, int, int, bytes], n: int) -> tuple[tuple, tuple]:
        doc, start, total, ids = piece
        return (doc, start, total, ids[:4 * n]), (doc, start + n, total, ids[4 * n:])

    def add(self, doc: int, ids: bytes) -> Iterator[tuple]:
        total, step = len(ids) // 4, 4 * self.size
        full = total // self.size * step
        for at in range(0, full, step):
            yield from self._sequence([(doc, at // 4, total, ids[at:at + step])])
        if full < len(ids):
            self._wait((doc, full // 4, total, ids[full:]))
            if self.waiting >= self.window:
                yield from self._drain(self.window // 4)

    def _drain(self, keep: int) -> Iterator[tuple]:
        """Fill sequences until ``keep`` tails or less than one sequence of tokens are left."""
        tokens = sum(n * len(x) for n, x in self.tails.items())
        while tokens >= self.size and self.waiting > keep:
            largest = max(self.tails)
            pieces = [self._take(largest)]
            slack = self.size - largest
            chosen = best_fill({n: len(x) for n, x in self.tails.items()}, slack)
            for length, count in chosen.items():
                pieces += [self._take(length) for _ in range(count)]
                slack -= length * count
            if slack:
                part, rest = self._cut(self._take(min(n for n in self.tails if n > slack)), slack)
                pieces.append(part)
                self._wait(rest)
            tokens -= self.size
            yield from self._sequence(pieces)

    def end(self) -> Iterator[tuple]:
        yield from self._drain(0)
        left = sum(n * len(x) for n, x in self.tails.items())
        while left:
            room = 1 << left.bit_length() - 1
            left -= room
            pieces = []
            while room:
                length = max((n for n in self.tails if n <= room), default=0) or min(self.tails)
                piece = self._take(length)
                if length > room:
                    piece, rest = self._cut(piece, room)
                    self._wait(rest)
                room -= len(piece[3]) // 4
                pieces.append(piece)
            yield from self._sequence(pieces)


def rank_encoder(path: str, specials: dict[str, int] | None = None) -> Callable[[], Callable[[list[str | None]], list[bytes]]]:
    """Encoder of a byte-level vocabulary given as ranks; ``specials`` are cut out of the text first."""
    def make() -> Callable[[list[str | None]], list[bytes]]:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        bpe = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=specials or {})
        following = tuple(specials or {})

        def part(text: str) -> bytes:
            return bpe.encode_to_numpy(text, allowed_special="all").astype("<u4").tobytes() if text else b""

        def whole(text: str) -> bytes:
            if len(text) < BLANKS:
                return part(text)
            out, at = [], 0
            for m in BLANK_RUN.finditer(text):
                # the pattern's rule: all blanks up to the end of a section, all but the last one before other text
                end = m.end() if m.end() == len(text) or text.startswith(following, m.end()) else m.end() - 1
                out += [part(text[at:m.start()]), array("I", bpe._encode_single_piece(text[m.start():end])).tobytes()]
                at = end
            return b"".join([*out, part(text[at:])])

        return lambda texts: [whole(x) if x else b"" for x in texts]

    return make


def pack(docs: DataFrame, encoder: Callable[[], Callable[[list[str | None]], list[bytes]]], size: int = 1024, window: int = WINDOW,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Cut and pack the tokens of every document, a closing id 0 included, into sequences.

    ``encoder`` is called once per task and returns a function from texts to ids (4
    little-endian bytes each). Returns one row per piece: its document, start and length
    there, the crc32 of its ids, the document's tokens, its sequence and offset there. A null
    or empty text is the closing id alone; repeated rows are packed each; an empty table gives
    an empty result; further columns are not read. Sequence ids are unique, not consecutive.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, encode = Packer(TaskContext.get().partitionId() << 40, size, window), None

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * 7)], names=[x.split()[0] for x in SCHEMA.split(", ")])

        for batch in batches:
            encode = encode or encoder()
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows: list[tuple] = []
                for doc, ids in zip(part.column(0).to_pylist(), encode(part.column(1).to_pylist())):
                    rows += packer.add(doc, ids + b"\0\0\0\0")
                yield out(rows)
        yield out(list(packer.end()))

    return small_batches(docs).select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, SCHEMA)
