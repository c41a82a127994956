"""Grouping of spelling variants by asymmetric q-chunks.

Two words are near if one edit (an inserted, deleted or replaced code point) turns one into the
other. The shorter word, of L code points, contributes two disjoint chunks: its first half and
the rest. One edit touches at most one of them, so the other stands unchanged in the longer word,
at the same place or shifted by one. The longer word contributes its grams of those lengths at
these places; grams at any other place can join no chunk within that shift and are not written. A join on length,
chunk and place finds every pair; the edit distance is verified inside the join.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm import runs
from tidewatch.llm.common import materialize, small_batches

#: A code point is deleted from the runs whose crc32 this number divides; least code points and occurrences of a word.
SLIP, LEAST_LENGTH, LEAST_COUNT = 97, 5, 3
#: A-Z count as a-z; letters are ASCII letters and U+00C0 to U+00FF, two bytes each, the first of which is 0xC3.
LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
ASCII = np.array([65 <= c <= 90 or 97 <= c <= 122 for c in range(256)])
LEAD = 0xC3


def _slipped(raw: bytes, crc: int) -> str:
    """The run without the code point that its checksum names."""
    run = raw.decode()
    at = crc % len(run)
    return run[:at] + run[at + 1:]


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slip: int = SLIP, least_length: int = LEAST_LENGTH) -> DataFrame:
    """Occurrences of every distinct word of at least ``least_length`` code points: word, n."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = runs.Counts("n")
        for batch in batches:
            before = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in batch.column(0).to_pylist()], np.uint32)
            for first, flat, offsets in runs.slices(batch.column(1)):
                lead = flat == LEAD
                inside = ASCII[flat] | lead
                inside[1:] |= lead[:-1]
                start, length, row = runs.spans(inside, offsets)
                flat = LOWER[flat]
                wide = np.r_[0, np.cumsum(lead)]
                points = length - (wide[start + length] - wide[start])
                long = np.flatnonzero(points >= least_length)
                start, length, row, points = start[long], length[long], row[long], points[long]
                if not len(start):
                    continue
                crc = runs.crcs(flat, start, length, before[first + row])
                slips = crc % np.uint32(slip) == 0
                odd = [_slipped(flat[a:a + n].tobytes(), int(c)) for a, n, c, p in zip(start[slips], length[slips], crc[slips], points[slips]) if p > least_length]
                start, length = start[~slips], length[~slips]
                _, at, n = np.unique(runs.hashes(flat, start, length), return_index=True, return_counts=True)
                held.add(runs.strings(flat, start[at], length[at]), n)
                held.add(pa.array([x.encode() for x in odd], pa.binary()), np.ones(len(odd), np.int64))
                yield from held.out()
        yield from held.out(True)

    texts = small_batches(docs).select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).alias("text"))
    parts = texts.mapInArrow(count, "key binary, n long")
    return parts.groupBy("key").agg(F.sum("n").alias("n")).select(F.decode("key", "UTF-8").alias("word"), "n")


def near_pairs(words: DataFrame) -> DataFrame:
    """Every pair of words (columns word, n) one edit apart, once: a, na, b, nb; ``a`` is not the longer one."""
    sized = words.select("word", "n", F.length("word").alias("size"))
    half = F.floor(F.col("length") / 2).cast("int")
    piece = lambda side, start, size: F.struct(F.lit(side).alias("side"), F.col("word").substr(start, size).alias("gram"))
    chunks = sized.withColumn("length", F.col("size")).select(
        F.col("word").alias("a"), F.col("n").alias("na"), "length", half.alias("half"),
        F.inline(F.array(piece(1, F.lit(1), half), piece(2, half + 1, F.col("length") - half))))
    # the longer word against words of its own length and of one code point less
    grams = sized.withColumn("length", F.explode(F.array(F.col("size"), F.col("size") - 1))).select(
        F.col("word").alias("b"), F.col("n").alias("nb"), "length", (F.col("size") - F.col("length")).alias("shift"),
        F.inline(F.array(piece(1, F.lit(1), half), piece(2, half + 1 + F.col("size") - F.col("length"), F.col("length") - half))))
    met = chunks.join(grams, ["length", "side", "gram"])
    once = F.expr("(shift = 1 OR a < b) AND (side = 1 OR NOT startswith(b, left(a, half)))")
    return met.where(once & (F.levenshtein("a", "b", 1) == 1)).select("a", "na", "b", "nb")


def roots(forms: DataFrame) -> DataFrame:
    """The last word that the forms reach from each word of ``forms`` (columns word, form), by doubling the steps.

    A form occurs more often than its word, so there is no circle; the rounds are about the
    logarithm of the longest chain.
    """
    steps = materialize(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        further = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        steps = materialize(steps.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "forms")
        if steps.where("moved").isEmpty():
            return steps.select("word", "root")
        steps = steps.select("word", "root")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slip: int = SLIP, least_length: int = LEAST_LENGTH,
             least_count: int = LEAST_COUNT) -> DataFrame:
    """Words of all texts, the more frequent word each may be a variant of, and the last of that chain.

    Returns word, form, root, n (occurrences), n_near (words one edit apart) and form_n. ``form``
    is the near word of largest n, ties to the smallest in code-point order, if it occurs at least twice
    as often; else form and form_n are null and root is the word. Null and empty texts have no words, a
    null id counts as an empty one, repeated rows count each, further columns are not read, an empty table
    gives an empty result. All words and pairs take part; a chunk that many words share makes a long list of candidates, as
    its pairs are all verified.
    """
    words = materialize(word_counts(docs, id_col, text_col, slip, least_length).where(F.col("n") >= least_count), "words")
    pairs = near_pairs(words)
    sides = pairs.select(F.inline(F.array(*(F.struct(F.col(x).alias("word"), F.col("n" + x).alias("n"), F.col(y).alias("other"), F.col("n" + y).alias("other_n"))
                                            for x, y in (("a", "b"), ("b", "a"))))))
    best = sides.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("minus"), F.col("other").alias("form"))).alias("best"))
    takes = -F.col("best.minus") >= 2 * F.col("n")
    near = materialize(words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(takes, F.col("best.form")).alias("form"),
                                                               F.when(takes, -F.col("best.minus")).alias("form_n")), "near-words")
    ends = roots(near.where("form IS NOT NULL"))
    return near.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
