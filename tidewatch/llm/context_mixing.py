"""Language-model scores by online logistic context mixing.

A text is a sequence of tokens: its words and one end. A word is spelled as its bytes and a blank, the
end as a line feed; words of ``PIECE`` bytes or more are spelled in pieces of that length. Every bit of
a spelling is predicted by several contexts: the last one to five bytes, hashed into tables of fixed
size, and the whole spelling so far, whose exact counts are a tree over all distinct spellings of the
corpus and grow with it. Each context gives the logarithm of the odds of its counts. A gate, the place
of the bit in its byte and how often the spelling so far was seen, picks the weights that mix them. The
weights are learned online over all spellings of the training texts, each predicted by counts without
itself. An adaptive map, learned along, refines the mixed probability by the bits seen of the byte.

A spelling is predicted from itself alone, so each distinct one is predicted once, however often it
occurs. The spellings are sorted and cut into ranges; what the ranges know of the branches that reach
across their edges is a short list of sums. A text's score adds up its tokens: the most frequent ones are
looked up in a table of fixed size, the others meet their texts in buckets of hashes.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm import runs
from tidewatch.llm.common import fold, materialize, small_batches

#: Bytes of a piece of a long word; levels of the tree (a bit each), with the closing blank.
PIECE = 32
LEVELS = 8 * (PIECE + 1)
#: ASCII white space separates words, A-Z count as a-z, the end of a text.
SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
BLANK, END, LONG = 32, b"\n", b"\t"
#: Bytes of the hashed contexts and bits of their tables.
ORDERS, TABLE_BITS = (1, 2, 3, 5), (16, 18, 20, 20)
#: Distinct spellings of a range, and most ranges, whose edges are broadcast; beyond them ranges grow.
RANGE_ROWS, RANGES = 300_000, 4_096
#: Parts of a table that are summed side by side.
PARTS = 16
#: Inputs of the mixer, counts at which the confidence in the spelling so far changes, and gates for a place in the byte.
INPUTS, CONFIDENCE = len(ORDERS) + 2, np.array([0.5, 2.5, 11.5, 99.5])
GATES = len(CONFIDENCE) + 1
#: What is added to both counts; weights before learning, and the weight of these in learning.
FADE, START, PRIOR = 0.3, np.array([0.05, 0.05, 0.1, 0.1, 0.7, 0.0]), 2.0
#: Most that a step moves a weight.
LEAP = 0.1
#: Branches of a step of learning, buckets of the adaptive map and their number a unit of log odds.
STEP, STEPS, STEEP = 32_768, 33, 2.0
#: Tokens whose scores every task holds, and tokens of a bucket.
FREQUENT, BUCKET = 65_536, 4_000_000
#: What sets kinds of hashed strings apart: a closed spelling, a piece of a long word, a whole long word.
SALT = np.array([0, 0x5851F42D4C957F2D, 0x14057B7EF767814F], np.uint64)
FIRST_BIT = np.array([8] + [8 - b.bit_length() for b in range(1, 256)], np.int32)


# --- texts into symbols -------------------------------------------------------------------------

class Symbols:
    """What the texts of a slice are made of: hash, kind, row, and whether it counts as a word and is spelled."""

    def __init__(self, flat: np.ndarray, offsets: np.ndarray):
        self.flat = LOWER[flat]
        start, length, row = runs.spans(~SPACE[flat], offsets)
        self.words = np.bincount(row, minlength=len(offsets) - 1)
        long = np.flatnonzero(length >= PIECE)
        short = np.flatnonzero(length < PIECE)
        whole = length[long] // PIECE  # pieces of PIECE bytes; what is left, maybe nothing, is closed by the blank
        at = np.repeat(np.arange(len(long)), whole)
        place = np.arange(len(at)) - np.repeat(np.cumsum(whole) - whole, whole)
        left = start[long] + PIECE * whole
        self.start = np.concatenate([start[short], left, start[long][at] + PIECE * place, start[long]])
        self.length = np.concatenate([length[short], length[long] - PIECE * whole, np.full(len(at), PIECE), length[long]])
        self.row = np.concatenate([row[short], row[long], row[long][at], row[long]])
        sizes = [len(short), len(long), len(at), len(long)]
        self.kind = np.repeat([0, 0, 1, 2], sizes)
        self.word, self.spelled = np.repeat([1, 0, 0, 1], sizes), np.repeat([1, 1, 1, 0], sizes)
        self.hash = runs.hashes(self.flat, self.start, self.length) ^ SALT[self.kind]

    def keys(self, at: np.ndarray) -> pa.Array:
        """The keys of some symbols: spellings, or a tab and the hash of a whole long word."""
        out = [runs.strings(self.flat, self.start[at], np.where(self.kind[at] < 2, self.length[at], 0)).to_pylist(), self.kind[at].tolist(), self.hash[at].tolist()]
        return pa.array([x + b" " if k == 0 else x if k == 1 else LONG + h.to_bytes(8, "big") for x, k, h in zip(*out)], pa.binary())


def symbol_counts(texts: DataFrame) -> DataFrame:
    """Every distinct key of ``texts`` (text, learns), with its uses in learned texts as a word and as a spelling."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = runs.Counts("words", "spelled")
        for batch in batches:
            learns = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            for first, flat, offsets in runs.slices(batch.column(0)):
                s = Symbols(flat, offsets)
                own = learns[first:first + len(offsets) - 1]
                _, at, back = np.unique(s.hash, return_index=True, return_inverse=True)
                sums = (np.bincount(back, own[s.row] * x, minlength=len(at)).astype(np.int64) for x in (s.word, s.spelled))
                held.add(s.keys(at), *sums)
                held.add(pa.array([END], pa.binary()), *[np.array([own.sum()])] * 2)
                yield from held.out()
        yield from held.out(True)

    return texts.select("text", "learns").mapInArrow(count, "key binary, words long, spelled long").groupBy("key").agg(F.sum("words").alias("words"), F.sum("spelled").alias("spelled"))


# --- spellings bit by bit -----------------------------------------------------------------------

class Spellings:
    """The sorted spellings of a range."""

    def __init__(self, keys: pa.ChunkedArray, counts: np.ndarray):
        flat, offsets = runs.utf8_bytes(keys.combine_chunks().cast(pa.large_binary()))
        length = np.diff(offsets)
        matrix = np.zeros((len(length), PIECE + 1), np.uint8)
        matrix[np.repeat(np.arange(len(length)), length), np.arange(len(flat)) - np.repeat(offsets[:-1], length)] = flat
        self.order = np.argsort(matrix.view(f"S{PIECE + 1}").ravel(), kind="stable")
        self.matrix, self.length, self.counts = matrix[self.order], length[self.order], counts[self.order].astype(np.float64)

    def bits(self, carry: np.ndarray | None = None) -> Iterator[tuple]:
        """Bit by bit the branches of the tree that stand before one: the bit's place in its byte, the rows that have it and
        its value, how many rows each branch holds, the bytes before and the bits so far of the byte, and
        the uses in which a zero and a one follow: of all ranges, and of this one.

        ``carry`` holds, by level, what other ranges count of the first and of the last row's branch.
        """
        rows, counts = np.arange(len(self.length)), self.counts
        apart = np.full(len(rows), -1, np.int32)  # first bit in which a row differs from the row before
        if len(rows) > 1:
            unlike = self.matrix[1:] != self.matrix[:-1]
            byte = unlike.argmax(axis=1)
            apart[1:] = 8 * byte + FIRST_BIT[self.matrix[np.arange(1, len(rows)), byte] ^ self.matrix[np.arange(len(rows) - 1), byte]]
        window = np.zeros(len(rows), np.uint64)
        for k in range(int(self.length.max(initial=0))):
            on = np.flatnonzero(self.length[rows] > k)
            if len(on) < len(rows):
                apart = np.minimum.reduceat(apart[:on[-1] + 1], np.r_[0, on[:-1] + 1])
                rows, counts, window = rows[on], counts[on], window[on]
            byte, node = self.matrix[rows, k], np.ones(len(rows), np.uint64)
            for j in range(8):
                level = 8 * k + j
                begin = np.flatnonzero(apart < level)
                bit = byte >> np.uint8(7 - j) & np.uint8(1)
                one = np.add.reduceat(counts * bit, begin)
                zero = np.add.reduceat(counts, begin) - one
                ones, zeros = one, zero
                if carry is not None:
                    ones, zeros = one.copy(), zero.copy()
                    for edge, at in ((0, 0), (1, -1)):
                        same, rest = carry[edge, level + 1], carry[edge, level] - carry[edge, level + 1]
                        ones[at] += same if bit[at] else rest
                        zeros[at] += rest if bit[at] else same
                yield j, rows, bit, np.diff(np.r_[begin, len(rows)]), window[begin], node[begin], zeros, ones, zero, one
                node = node << np.uint64(1) | bit
            window = window << np.uint64(8) | byte


def slots(window: np.ndarray, node: np.ndarray) -> list[np.ndarray]:
    """The cells of the hashed contexts."""
    return [((((window & np.uint64((1 << 8 * o) - 1)) << np.uint64(8)) + node) * runs.MULT >> np.uint64(64 - b)).astype(np.int64) for o, b in zip(ORDERS, TABLE_BITS)]


def context_counts(s: Spellings) -> list[np.ndarray]:
    """Counts of both bits in every cell of the hashed contexts."""
    tables = [np.zeros((1 << b, 2)) for b in TABLE_BITS]
    for *_, window, node, _, _, zero, one in s.bits():
        for table, cell in zip(tables, slots(window, node)):
            np.add.at(table[:, 0], cell, zero)
            np.add.at(table[:, 1], cell, one)
    return tables


def edges(s: Spellings) -> np.ndarray:
    """By level, the sums of the first and of the last row's branch, and whether both are the same branch."""
    out = np.zeros((3, LEVELS + 1))
    same = np.flatnonzero(s.matrix[0] != s.matrix[-1])
    alike = 8 * same[0] + FIRST_BIT[s.matrix[0, same[0]] ^ s.matrix[-1, same[0]]] if len(same) else LEVELS
    out[2, :alike + 1] = 1
    for row, at in ((0, 0), (1, len(s.length) - 1)):
        unlike = s.matrix != s.matrix[at]
        byte = unlike.argmax(axis=1)
        shared = np.where(unlike.any(axis=1), 8 * byte + FIRST_BIT[s.matrix[np.arange(len(byte)), byte] ^ s.matrix[at, byte]], LEVELS)
        out[row] = np.bincount(shared, s.counts, minlength=LEVELS + 1)[::-1].cumsum()[::-1]
    return out


def carries(firsts: np.ndarray, lasts: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """What all other ranges count of each range's first and last branch, from the edges of all ranges in order."""
    out = np.zeros((len(sums), 2, LEVELS + 1))

    def shared(a: np.ndarray, b: np.ndarray) -> int:
        at = np.flatnonzero(a != b)
        return 8 * at[0] + FIRST_BIT[a[at[0]] ^ b[at[0]]] if len(at) else LEVELS

    for p in range(1, len(sums)):
        n = shared(lasts[p - 1], firsts[p]) + 1
        out[p, 0, :n] = (sums[p - 1, 1] + sums[p - 1, 2] * out[p - 1, 0])[:n]
    for p in range(len(sums) - 2, -1, -1):
        n = shared(firsts[p + 1], lasts[p]) + 1
        out[p, 1, :n] = (sums[p + 1, 0] + sums[p + 1, 2] * out[p + 1, 1])[:n]
    return out


def expit(odds: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


class Mixer:
    """Weights by gate, and the adaptive map; what is learned are sums, so those of several ranges add up.

    ``squares`` and ``pulls`` of a gate are the sums of the second-order learning steps: the weights they
    agree on solve ``squares * weights = pulls``.
    """

    def __init__(self, tables: list[np.ndarray], weights: np.ndarray | None = None, refined: np.ndarray | None = None):
        self.pairs = [t.astype(np.float32).view(np.uint64).ravel() for t in tables] if weights is None else None
        self.odds = None if weights is None else [np.log((t[:, 1] + np.float32(FADE)) / (t[:, 0] + np.float32(FADE))).astype(np.float32) for t in tables]
        self.weights = np.tile(START, (8, GATES, 1)) if weights is None else weights
        self.refined = refined
        self.squares = np.tile(PRIOR * np.eye(INPUTS), (8, GATES, 1, 1))
        self.seen = np.zeros((2, 256 * STEPS))

    def mixed(self, j: int, window, node, zeros, ones, without: tuple[int, int] = (0, 0)) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Inputs, gate and log odds of a one. So many uses of a zero and a one are taken out of all counts first."""
        x = np.empty((INPUTS, len(node)), np.float32)
        for i, cell in enumerate(slots(window, node)):
            if self.odds is not None:
                x[i] = self.odds[i][cell]
            else:
                n = self.pairs[i][cell].view(np.float32).reshape(-1, 2)
                x[i] = np.log((np.maximum(n[:, 1] - without[1], 0) + np.float32(FADE)) / (np.maximum(n[:, 0] - without[0], 0) + np.float32(FADE)))
        zeros, ones = np.maximum(zeros - without[0], 0), np.maximum(ones - without[1], 0)
        x[-2] = np.log((ones + FADE) / (zeros + FADE))
        x[-1] = 0.25
        gate = np.searchsorted(CONFIDENCE, zeros + ones)
        weights = self.weights[j].astype(np.float32)
        return x, gate, sum(weights[:, i][gate] * x[i] for i in range(INPUTS))

    def learn(self, s: Spellings, carry: np.ndarray | None) -> None:
        """One pass over all branches, each bit weighted by its uses and predicted without one of them; a step follows every ``STEP``."""
        for j, *_, window, node, zeros, ones, zero, one in s.bits(carry):
            for k in range(0, len(node), STEP):
                part = slice(k, k + STEP)
                grown = [(np.zeros((INPUTS, INPUTS)), np.zeros(INPUTS)) for _ in range(GATES)]
                for bit, uses in ((0, zero[part]), (1, one[part])):
                    at = np.flatnonzero(uses) + k
                    uses = uses[at - k]
                    x, gate, odds = self.mixed(j, window[at], node[at], zeros[at], ones[at], (1 - bit, bit))
                    wrong = bit - expit(odds)
                    # both views of the curvature: of the prediction, and of the error where that was sure and wrong
                    curve, wrong = uses * np.abs(wrong), uses * wrong
                    for g, (squares, pull) in enumerate(grown):
                        here = gate == g
                        if here.any():
                            own_x = x[:, here].astype(np.float64)
                            squares += (own_x * curve[here]) @ own_x.T
                            pull += own_x @ wrong[here]
                    cell = node[at].astype(np.int64) * STEPS + np.clip(np.rint((odds + STEPS // 2 / STEEP) * STEEP), 0, STEPS - 1).astype(np.int64)
                    self.seen[0] += np.bincount(cell, uses, minlength=256 * STEPS)
                    self.seen[1] += np.bincount(cell, uses * bit, minlength=256 * STEPS)
                for g, (squares, pull) in enumerate(grown):
                    self.squares[j, g] += squares
                    self.weights[j, g] += np.clip(np.linalg.solve(self.squares[j, g], pull), -LEAP, LEAP)

    def sums(self) -> np.ndarray:
        """What was learned beyond the start, as numbers that add up over ranges."""
        pulls = np.einsum("jgab,jgb->jga", self.squares, self.weights) - PRIOR * START
        return np.concatenate([(self.squares - PRIOR * np.eye(INPUTS)).ravel(), pulls.ravel(), self.seen.ravel()])

    @staticmethod
    def of_sums(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Weights and adaptive map of summed numbers."""
        squares, pulls, seen = np.split(sums, np.cumsum([8 * GATES * INPUTS ** 2, 8 * GATES * INPUTS]))
        squares, pulls = squares.reshape(8, GATES, INPUTS, INPUTS) + PRIOR * np.eye(INPUTS), pulls.reshape(8, GATES, INPUTS) + PRIOR * START
        weights = np.linalg.solve(squares, pulls[..., None])[..., 0]
        seen, ones = seen.reshape(2, -1)
        plain = 1 / (1 + np.exp(-(np.arange(STEPS) / STEEP - STEPS // 2 / STEEP)))
        return weights, (ones + 20 * np.tile(plain, 256)) / (seen + 20)

    def costs(self, s: Spellings, carry: np.ndarray | None) -> np.ndarray:
        """Bits that every spelling costs."""
        out = np.zeros(len(s.length))
        for j, rows, bit, held, window, node, zeros, ones, *_ in s.bits(carry):
            price = np.empty((2, len(node)))
            for k in range(0, len(node), STEP):
                part = slice(k, k + STEP)
                _, _, odds = self.mixed(j, window[part], node[part], zeros[part], ones[part])
                place = np.clip((odds + STEPS // 2 / STEEP) * STEEP, 0, STEPS - 1.001)
                low = place.astype(np.int64)
                share, cell = place - low, node[part].astype(np.int64) * STEPS + low
                again = self.refined[cell] * (1 - share) + self.refined[cell + 1] * share
                price[0, part] = -np.log2(0.5 * expit(-odds) + 0.5 * (1 - again))
                price[1, part] = -np.log2(0.5 * expit(odds) + 0.5 * again)
            out[rows] += price[bit, np.repeat(np.arange(len(held)), held)]
        return out


# --- learning and scoring on Spark --------------------------------------------------------------

class Model:
    """What was learned: counts N and V, and for every key of the corpus its uses as a word and the bits it costs."""

    def __init__(self, tokens: int, distinct: int, scored: DataFrame):
        self.tokens, self.distinct, self.scored = tokens, distinct, scored


def train(texts: DataFrame) -> Model:
    """Learn from the texts that learn; ``texts`` holds text and learns. All keys, also those of the other texts, are scored."""
    spark = texts.sparkSession
    counted = materialize(symbol_counts(texts), "symbols")
    tokens, distinct, n = counted.agg(F.sum("words"), F.count(F.when(F.col("words") > 0, 1)), F.count("*")).first()
    spelled = counted.where(F.substring("key", 1, 1) != LONG)
    ranges = min(RANGES, max(1, math.ceil(n / RANGE_ROWS)))
    placed = materialize(spelled.repartitionByRange(ranges, "key").withColumn("part", F.spark_partition_id()), "spellings")

    def read(rows: pa.Table) -> Spellings:
        return Spellings(rows.column("key"), rows.column("spelled").to_numpy())

    def gather(rows: pa.Table) -> pa.Table:
        s, out = read(rows), []
        out.append((-1, rows.column("part")[0].as_py(), s.matrix[0].tobytes() + s.matrix[-1].tobytes(), edges(s).tobytes()))
        for t, table in enumerate(context_counts(s)):
            size = len(table) // PARTS
            for p in range(PARTS):
                cells = np.flatnonzero(table[p * size:(p + 1) * size].any(axis=1))
                out.append((t, p, cells.astype("<u4").tobytes(), table[p * size:(p + 1) * size][cells].astype("<f4").tobytes()))
        return pa.table({name: pa.array(c, kind) for name, kind, c in zip(("kind", "at", "cells", "sums"), (pa.int32(), pa.int32(), pa.binary(), pa.binary()), zip(*out))})

    def add(key: tuple, rows: pa.Table) -> pa.Table:
        size = (1 << TABLE_BITS[key[0].as_py()]) // PARTS
        table = np.zeros((size, 2))
        for cells, sums in zip(rows.column("cells"), rows.column("sums")):
            table[np.frombuffer(cells.as_buffer(), "<u4")] += np.frombuffer(sums.as_buffer(), "<f4").reshape(-1, 2)
        return pa.table({"kind": [key[0].as_py()], "at": [key[1].as_py()], "sums": [table.astype("<f4").tobytes()]}, schema=pa.schema([("kind", pa.int32()), ("at", pa.int32()), ("sums", pa.binary())]))

    gathered = materialize(placed.groupBy("part").applyInArrow(gather, "kind int, at int, cells binary, sums binary"), "contexts")
    ends = gathered.where("kind < 0").orderBy("at").collect()  # at most RANGES
    both = np.array([np.frombuffer(r["cells"], np.uint8).reshape(2, -1) for r in ends]).reshape(len(ends), 2, PIECE + 1)
    carry = carries(both[:, 0], both[:, 1], np.array([np.frombuffer(r["sums"]).reshape(3, -1) for r in ends]).reshape(len(ends), 3, LEVELS + 1))
    summed = gathered.where("kind >= 0").groupBy("kind", "at").applyInArrow(add, "kind int, at int, sums binary").orderBy("kind", "at").collect()  # of fixed size
    tables = [b"".join(bytes(r["sums"]) for r in summed if r["kind"] == t) or bytes(8 << b) for t, b in enumerate(TABLE_BITS)]
    sent = spark.sparkContext.broadcast((tables, {r["at"]: c for r, c in zip(ends, carry)}))

    def mixer(*learned) -> Mixer:
        return Mixer([np.frombuffer(t, "<f4").reshape(-1, 2) for t in sent.value[0]], *learned)

    def learn(rows: pa.Table) -> pa.Table:
        m = mixer()
        m.learn(read(rows), sent.value[1][rows.column("part")[0].as_py()])
        return pa.table({"at": np.arange(PARTS), "sums": pa.array([x.tobytes() for x in np.array_split(m.sums(), PARTS)], pa.binary())})

    def summed_up(key: tuple, rows: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_buffer()) for x in rows.column("sums"))
        return pa.table({"at": pa.array([key[0].as_py()], pa.int64()), "sums": pa.array([total.tobytes()], pa.binary())})

    learned = placed.groupBy("part").applyInArrow(learn, "at long, sums binary").groupBy("at").applyInArrow(summed_up, "at long, sums binary").orderBy("at").collect()  # of fixed size
    weights, refined = Mixer.of_sums(np.concatenate([np.frombuffer(r["sums"]) for r in learned]) if learned else Mixer([]).sums())

    def score(rows: pa.Table) -> pa.Table:
        s = read(rows)
        bits = np.empty(len(s.length))
        bits[s.order] = mixer(weights, refined).costs(s, sent.value[1][rows.column("part")[0].as_py()])
        flat, offsets = runs.utf8_bytes(rows.column("key").combine_chunks().cast(pa.large_binary()))
        length = np.diff(offsets)
        closed = flat[offsets[1:] - 1] == BLANK
        hashed = runs.hashes(flat, offsets[:-1], length - closed) ^ SALT[np.where(closed, 0, 1)]
        return pa.table({"hash": hashed.view(np.int64), "words": rows.column("words"), "bits": bits})

    cost = placed.groupBy("part").applyInArrow(score, "hash long, words long, bits double")
    held = F.conv(F.substring(F.hex("key"), 3, 16), 16, -10).cast("long")  # the hash that follows the tab
    whole = counted.where(F.substring("key", 1, 1) == LONG).select(held.alias("hash"), "words", F.lit(0.0).alias("bits"))
    return Model(tokens or 0, distinct or 0, materialize(cost.union(whole), "costs"))



ASKED = "bucket int, slice long, docs binary, hashes binary, words binary, spelled binary, ids array<long>, held array<boolean>, sums binary"
FOUND = "slice long, docs binary, ids array<long>, held array<boolean>, sums binary"
SCORES = "key long, doc_id long, held_out boolean, n_tokens double, n_known double, logs double, bits double, letters double"


def score(docs: DataFrame, learns, id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT, bucket: int = BUCKET) -> DataFrame:
    """Base score and model score of every whole text, learned from the rows where ``learns`` holds.

    Returns, one row per input row, doc_id, held_out, n_tokens (words and the end), n_known (those seen in learning),
    train_tokens, base_score (add-one unigram, log10), score (log10 probability of the model), bits and
    bits_per_byte of the spelled text. A null or empty text is its end alone; repeated rows count and
    come back each; a null id never learns; further columns are not read; an empty table gives an empty result. Words of 32
    bytes or more are told apart by a hash of 64 bits.
    """
    spark = docs.sparkSession
    rows = small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(learns, F.lit(False)).alias("learns"))
    model = train(rows)
    common = sorted((r["hash"] & (1 << 64) - 1, r["words"], r["bits"]) for r in model.scored.orderBy(F.col("words").desc(), "hash").limit(frequent).collect())  # at most FREQUENT
    end = (runs.hashes(np.frombuffer(END, np.uint8), np.zeros(1, np.int64), np.ones(1, np.int64)) ^ SALT[1])[0]
    last = model.scored.where(F.col("hash") == int(end.view(np.int64))).first() if model.tokens is not None else None
    buckets = max(1, math.ceil(model.tokens / bucket))
    sent = spark.sparkContext.broadcast((np.array([c[0] for c in common], np.uint64), np.array([c[1] for c in common], np.int64), np.array([c[2] for c in common])))
    end_words, end_bits = (last["words"], last["bits"]) if last else (0, 0.0)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, words, bits = sent.value
        names = [f.split()[0] for f in ASKED.split(", ")]
        for batch in batches:
            doc_keys = batch.column(0).to_numpy(zero_copy_only=False)
            for first, flat, offsets in runs.slices(batch.column(3)):
                n = len(offsets) - 1
                own, s = doc_keys[first:first + n], Symbols(flat, offsets)
                # known by its content, so a repeated task names it alike
                name = int.from_bytes(hashlib.blake2b(own.tobytes(), digest_size=8).digest(), "little", signed=True)
                at = np.minimum(np.searchsorted(hashes, s.hash), max(0, len(hashes) - 1))
                hit = hashes[at] == s.hash if len(hashes) else np.zeros(len(s.hash), bool)
                row, at, word = s.row[hit], at[hit], s.word[hit]
                letters = np.bincount(s.row, s.spelled * (s.length + (s.kind == 0)), minlength=n) + 1
                sums = np.stack([s.words + 1, np.bincount(row, word * (words[at] > 0), minlength=n) + (end_words > 0),
                                 np.bincount(row, word * np.log10(words[at] + 1), minlength=n) + np.log10(end_words + 1),
                                 np.bincount(row, s.spelled[hit] * bits[at], minlength=n) + end_bits, letters])
                yield pa.RecordBatch.from_arrays([pa.array([name % buckets], pa.int32()), pa.array([name], pa.int64()), *(pa.array([x], pa.binary()) for x in (own.tobytes(), b"", b"", b"")),
                                                  pa.array([batch.column(1).slice(first, n).to_pylist()], pa.list_(pa.int64())),
                                                  pa.array([batch.column(2).slice(first, n).to_pylist()], pa.list_(pa.bool_())), pa.array([sums.tobytes()], pa.binary())], names=names)
                # the other tokens of a text, each once, go to the buckets of their hashes
                rest = np.flatnonzero(~hit)
                order = rest[np.lexsort((s.row[rest], s.hash[rest]))]
                if not len(order):
                    continue
                begin = np.flatnonzero(np.r_[True, (s.hash[order][1:] != s.hash[order][:-1]) | (s.row[order][1:] != s.row[order][:-1])])
                token, doc = s.hash[order[begin]], own[s.row[order[begin]]]
                word, spelled = np.add.reduceat(s.word[order], begin), np.add.reduceat(s.spelled[order], begin)
                to = (token % np.uint64(buckets)).astype(np.int64)
                for b in np.unique(to):
                    k = to == b
                    blobs = (doc[k], token[k], word[k].astype("<u4"), spelled[k].astype("<u4"))
                    yield pa.RecordBatch.from_arrays([pa.array([int(b)], pa.int32()), pa.array([name], pa.int64()), *(pa.array([x.tobytes()], pa.binary()) for x in blobs), pa.array([None], pa.list_(pa.int64())),
                                                      pa.array([None], pa.list_(pa.bool_())), pa.array([None], pa.binary())], names=names)

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        key = left.column("hash").to_numpy().view(np.uint64)
        order = np.argsort(key)
        key, words, bits = key[order], left.column("words").to_numpy()[order], left.column("bits").to_numpy()[order]
        out = []
        for at in range(right.num_rows):  # row by row and without copies: a bucket's tokens lie in memory once
            r = {name: right.column(name)[at] for name in right.column_names}
            if r["sums"].is_valid:  # what the slice knows itself
                out.append(tuple(r[name].as_py() for name in ("slice", "docs", "ids", "held", "sums")))
                continue
            place = np.searchsorted(key, np.frombuffer(r["hashes"].as_buffer(), np.uint64))
            own, back = np.unique(np.frombuffer(r["docs"].as_buffer(), np.int64), return_inverse=True)
            word, spelled = np.frombuffer(r["words"].as_buffer(), "<u4").astype(np.int64), np.frombuffer(r["spelled"].as_buffer(), "<u4")
            sums = np.stack([np.bincount(back, x, minlength=len(own)) for x in (word * (words[place] > 0), word * np.log10(words[place] + 1), spelled * bits[place])])
            out.append((r["slice"].as_py(), own.tobytes(), None, None, sums.tobytes()))
        kinds = (pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.binary())
        return pa.table({f.split()[0]: pa.array(c, kind) for f, kind, c in zip(FOUND.split(", "), kinds, zip(*out) if out else [()] * 5)})

    def gather(rows: pa.Table) -> pa.Table:
        """The sums of the texts of a slice, one row each."""
        rows = rows.to_pylist()
        whole = [r for r in rows if r["ids"] is not None]
        doc = np.concatenate([np.frombuffer(r["docs"], np.int64) for r in whole])
        sums = np.concatenate([np.frombuffer(r["sums"]).reshape(5, -1) for r in whole], axis=1)
        own, first, times = np.unique(doc, return_index=True, return_counts=True)
        back = np.searchsorted(own, doc)
        more = np.zeros((3, len(own)))
        for r in rows:
            if r["ids"] is None:
                more[:, np.searchsorted(own, np.frombuffer(r["docs"], np.int64))] += np.frombuffer(r["sums"]).reshape(3, -1)
        sums[1:4] += (more / times)[:, back]  # texts of one id and content are alike
        ids, held = [x for r in whole for x in r["ids"]], [x for r in whole for x in r["held"]]
        columns = (pa.array(doc), pa.array(ids, pa.int64()), pa.array(held, pa.bool_()), *map(pa.array, sums))
        return pa.table(list(columns), names=[f.split()[0] for f in SCORES.split(", ")])

    keyed = rows.select(F.xxhash64("doc_id", "text").alias("key"), "doc_id", (~F.col("learns")).alias("held_out"), "text")
    asked = keyed.mapInArrow(ask, ASKED)
    held = model.scored.withColumn("bucket", F.pmod(F.conv(F.hex("hash"), 16, 10).cast("decimal(20,0)"), F.lit(buckets).cast("decimal(20,0)")).cast("int"))
    found = held.groupBy("bucket").cogroup(asked.groupBy("bucket")).applyInArrow(answer, FOUND)
    return found.groupBy("slice").applyInArrow(gather, SCORES).select(
        "doc_id", "held_out", F.col("n_tokens").cast("long").alias("n_tokens"), F.round("n_known").cast("long").alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("logs") - F.col("n_tokens") * math.log10(model.tokens + model.distinct + 1)).alias("base_score"),
        (-F.col("bits") * math.log10(2)).alias("score"), "bits", (F.col("bits") / F.col("letters")).alias("bits_per_byte"))


def scored(docs: DataFrame, folds: int = 7, held: int = 2) -> DataFrame:
    """Scores of ``documents``, learned from those outside the fold ``held`` of ``folds``."""
    return score(docs, fold("doc_id", folds) != held)
