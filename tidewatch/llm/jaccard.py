"""Documents whose word shingles overlap: an exact Jaccard join with set-relation skipping.

Order. Every shingle is a 64-bit hash. One pass over all texts counts the shingles; a bit table of
fixed size remembers which occur more than once, a list of bounded size how often the most
frequent ones do. Shingles are ordered from single to frequent, equals by hash.

Index lists. In that order two sets that may link share a shingle among their first ones. Those
first shingles, with their position, make the index lists; shingles that occur once are left
out. Lists are read sorted by set size, a sliding block of neighbours at a time. From the number of
shared first shingles and the position of the last, a lower bound of the symmetric difference
follows, and pairs beyond what a link allows are skipped without looking at the sets. The sets of a
list longer than the block are kept together instead, as far as their sizes allow a link, so no
pair is lost.

Clusters. What is left falls into clusters. The tables above are of fixed size: in a large corpus
they order the shingles badly, lists get long and clusters large. A cluster beyond one block of
work is therefore indexed once more by itself, with the exact frequencies of the shingles inside
it as a joined table, as long as that makes it smaller.

Answers. A cluster is checked in blocks of sets: the
overlaps of one set with all others come from the lists of its shingles, and those of a similar set
are derived from them by the few shingles in which the two differ. Only a spanning forest of the
links leaves a task. Equal sets are one set from the start.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import map_texts, materialize, small_batches, utf8_bytes
from tidewatch.llm.components import components

#: ASCII white space separates words, and A-Z count as a-z.
SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
#: Bits of the table of shared shingles, and most entries of the list of frequent ones: bounds of what is broadcast.
SHARED_BITS, FREQUENT = 26, 1 << 19
#: Parts of the hash range in which shingles are counted: 2 ** PART_BITS. A part holds at most 2 ** 22 different keys.
PART_BITS = 10
#: Keys that a counting task holds before it adds them up.
HELD = 4_000_000
#: Lists up to this length are joined in full; sets of longer ones are kept together.
NEAR = 8
#: Shingles of a verification block: bounds the memory of a task.
BLOCK = 250_000
#: Bits of the table of ids whose sets are needed.
WANTED_BITS = 25
BATCH = 256
MULT, ROOT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95)


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


class Shingler:
    """Distinct shingle hashes of whole texts, ascending; words are hashed as polynomials of their bytes."""

    def __init__(self, words: int = 3):
        self.words = words
        self.value = mixed(np.arange(1, 257, dtype=np.uint64) * MULT) | np.uint64(1)
        self.inverse = np.uint64(pow(int(ROOT), -1, 1 << 64))
        self.power = self.back = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.power) < n:
            for name, base in (("power", ROOT), ("back", self.inverse)):
                x = np.full(2 * n, base, np.uint64)
                x[0] = 1
                setattr(self, name, np.multiply.accumulate(x))

    def __call__(self, texts: pa.Array) -> list[np.ndarray]:
        flat, offsets = utf8_bytes(texts)
        n_docs = len(offsets) - 1
        if not len(flat):
            return [np.zeros(0, np.uint64)] * n_docs
        self._grow(len(flat) + 1)
        word = ~SPACE[flat]
        edge = np.zeros(len(flat) + 1, bool)
        edge[offsets] = True
        start = np.flatnonzero(word & (edge[:-1] | np.r_[True, ~word[:-1]]))
        stop = np.flatnonzero(word & (edge[1:] | np.r_[~word[1:], True])) + 1
        total = np.zeros(len(flat) + 1, np.uint64)
        np.cumsum(self.value[LOWER[flat]] * self.power[:len(flat)], out=total[1:])
        hashes = mixed((total[stop] - total[start]) * self.back[start] + (stop - start).astype(np.uint64) * MULT)
        doc = np.searchsorted(offsets, start, side="right") - 1
        k = self.words
        inside = doc[k - 1:] == doc[:len(doc) - k + 1] if len(doc) >= k else np.zeros(0, bool)
        at = np.flatnonzero(inside)
        shingle = np.full(len(at), np.uint64(k))
        for j in range(k):
            shingle = mixed(shingle * MULT + hashes[at + j])
        of = doc[at]
        bounds = np.searchsorted(of, np.arange(n_docs + 1))
        first = np.searchsorted(doc, np.arange(n_docs + 1))
        out = []
        for d in range(n_docs):
            a, b = bounds[d], bounds[d + 1]
            if b > a:
                out.append(np.unique(shingle[a:b]))
                continue
            own = hashes[first[d]:first[d + 1]]
            if len(own):  # fewer words than a shingle: the whole sequence
                whole = np.full(1, np.uint64(len(own)))
                for h in own:
                    whole = mixed(whole * MULT + h)
                own = whole
            out.append(own)
        return out


def most_apart(a, b, percent: int):
    """Largest symmetric difference of two linked sets of sizes a and b (counts, arrays or columns)."""
    return (a + b) * (100 - percent) / (100 + percent)


def first_shingles(n: int, percent: int) -> int:
    """Length of the part of a set that goes into the index lists.

    The shortest that loses no link, and some more so that chance meetings can be told by it.
    """
    return min(n, n * (100 - percent) * 13 // 1000 + 2)


class Order:
    """Class of a shingle: 0 if it surely occurs once, 1 if more often, and up with its frequency."""

    def __init__(self, shared: bytes, frequent: bytes, classes: bytes):
        self.shared = np.frombuffer(shared, np.uint8)
        self.frequent, self.classes = np.frombuffer(frequent, "<u4"), np.frombuffer(classes, np.uint8)

    def __call__(self, shingles: np.ndarray) -> np.ndarray:
        bit = shingles >> np.uint64(64 - SHARED_BITS)
        out = self.shared[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8) & np.uint8(1)
        if len(self.frequent):
            at = np.flatnonzero(out)
            key = (shingles[at] >> np.uint64(32)).astype(np.uint32)
            slot = np.minimum(np.searchsorted(self.frequent, key), len(self.frequent) - 1)
            out[at] += np.where(self.frequent[slot] == key, self.classes[slot], 0).astype(np.uint8)
        return out


def count_shingles(docs: DataFrame, words: int) -> tuple[bytes, bytes, bytes]:
    """The tables of ``Order``, from the counts of the shingles of all texts.

    Tasks send the sorted upper halves of their hashes by part of the hash range; a part is read in
    pieces and returns its piece of the bit table and its frequent entries, of which at most
    ``FREQUENT`` stay. A task holds the different keys of one part, of which there are at most
    2 ** 22, and ``HELD`` keys more, whatever the input size.
    """
    parts, width = 1 << PART_BITS, 32 - PART_BITS

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        held, size = [], 0

        def out() -> pa.RecordBatch:
            keys = np.sort(np.concatenate(held)) if held else np.zeros(0, np.uint32)
            cut = np.searchsorted(keys, (np.arange(parts, dtype=np.uint64) << np.uint64(width)).astype(np.uint32)).tolist() + [len(keys)]
            rows = [(k, keys[a:b].astype("<u4").tobytes()) for k, (a, b) in enumerate(zip(cut, cut[1:])) if b > a]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["part", "keys"])

        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                for own in shingler(batch.column(0).slice(at, BATCH)):
                    held.append((own >> np.uint64(32)).astype(np.uint32))
                    size += len(own)
                if size > HELD:
                    yield out()
                    held, size = [], 0
        yield out()

    def summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        found, at = np.unique(np.concatenate(keys), return_inverse=True)
        return found, np.bincount(at, np.concatenate(counts), len(found)).astype(np.int64)

    def piece(part: int, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        bits = np.zeros(1 << SHARED_BITS - PART_BITS, np.uint8)
        bits[(keys[counts > 1] >> np.uint32(32 - SHARED_BITS)) & np.uint32(len(bits) - 1)] = 1
        often = np.argsort(-counts, kind="stable")[:FREQUENT >> PART_BITS]
        often = np.sort(often[counts[often] > NEAR // 2])
        classes = np.minimum(60, np.log2(np.maximum(1, counts[often]))).astype(np.uint8)
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary()),
                                           pa.array([keys[often].astype("<u4").tobytes()], pa.binary()), pa.array([classes.tobytes()], pa.binary())],
                                          names=["part", "shared", "frequent", "classes"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, keys, counts, fresh = -1, [], [], 0
        for batch in batches:
            for own, sent in zip(batch.column(0).to_pylist(), batch.column(1)):
                if own != part:
                    if keys:
                        yield piece(part, *summed(keys, counts))
                    part, keys, counts, fresh = own, [], [], 0
                keys.append(np.frombuffer(sent.as_buffer(), "<u4"))
                counts.append(np.ones(len(keys[-1])))
                fresh += len(keys[-1])
                if fresh > HELD:
                    one = summed(keys, counts)
                    keys, counts, fresh = [one[0]], [one[1]], 0
        if keys:
            yield piece(part, *summed(keys, counts))

    sent = small_batches(docs).select("text").mapInArrow(collect, "part int, keys binary")
    found = (sent.repartition("part").sortWithinPartitions("part")
             .mapInArrow(add, "part int, shared binary, frequent binary, classes binary").collect())
    by_part = {r["part"]: r for r in found}  # of fixed size: the bit table and at most FREQUENT entries
    empty = bytes(1 << SHARED_BITS - PART_BITS - 3)
    pieces = [by_part.get(k) for k in range(parts)]
    return (b"".join(bytes(p["shared"]) if p else empty for p in pieces), b"".join(bytes(p["frequent"]) for p in pieces if p),
            b"".join(bytes(p["classes"]) for p in pieces if p))


def set_rows(docs: DataFrame, order: tuple[bytes, bytes, bytes], words: int, percent: int) -> DataFrame:
    """Of every text the size and digest of its set, and those first shingles that other sets may share."""
    sent = docs.sparkSession.sparkContext.broadcast(order)  # bounded by SHARED_BITS and FREQUENT

    def make():
        rank, shingler = Order(*sent.value), Shingler(words)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            sizes, digests, keys, places = [], [], [], []
            for at in range(0, batch.num_rows, BATCH):
                sets = shingler(batch.column(1).slice(at, BATCH))
                classes = np.split(rank(np.concatenate(sets)), np.cumsum([len(s) for s in sets])[:-1])
                for own, grade in zip(sets, classes):
                    sizes.append(len(own))
                    digests.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest())
                    first = np.argsort(grade, kind="stable")[:first_shingles(len(own), percent)]
                    place = np.flatnonzero(grade[first])
                    keys.append(own[first[place]].view(np.int64))
                    places.append(place)
            count = np.cumsum([0, *map(len, keys)])
            lists = lambda x, t: pa.ListArray.from_arrays(pa.array(count, pa.int32()), pa.array(np.concatenate(x) if x else [], t))
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int32()), pa.array(digests, pa.binary()),
                                               lists(keys, pa.int64()), lists(places, pa.int32())], names=["doc_id", "n", "digest", "keys", "places"])
        return step

    return map_texts(docs, ["doc_id", "text"], "doc_id long, n int, digest binary, keys array<long>, places array<int>", make)


def near_pairs(postings: DataFrame, percent: int, near: int = NEAR) -> DataFrame:
    """Pairs of sets that meet in an index list, once per list.

    ``postings`` holds key, doc_id, n and place. Sets of a list are read by size; each is paired
    with the ``near`` before it whose size allows a link. ``tied`` marks pairs from the part of a
    list beyond its first ``near`` sets: they tie a list together, up to a gap in its sizes that no
    link can cross.
    """
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = None  # the last postings seen, and the rank of the first of them in its list
        for batch in batches:
            if not batch.num_rows:
                continue
            key, doc, n, place = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(4))
            rank0, skip = 0, 0
            if tail is not None:
                (tk, td, tn, tp), rank0 = tail
                skip = len(tk)
                key, doc, n, place = np.r_[tk, key], np.r_[td, doc], np.r_[tn, n], np.r_[tp, place]
            begin = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            rank = np.arange(len(key)) - np.repeat(begin, np.diff(np.r_[begin, len(key)]))
            rank[key == key[0]] += rank0
            parts = []
            for lag in range(1, min(near, len(key) - 1) + 1):
                i = np.flatnonzero(key[lag:] == key[:-lag]) + lag
                i = i[i >= skip]
                tied = rank[i] >= near
                able = (tied | (doc[i] != doc[i - lag])) & (100 * n[i - lag].astype(np.int64) >= percent * n[i].astype(np.int64))
                i, tied = i[able], tied[able]
                parts.append((doc[i - lag], doc[i], n[i - lag], n[i], place[i - lag], place[i], tied))
            if parts and any(len(p[0]) for p in parts):
                a, b, na, nb, ia, ib, tied = (np.concatenate(c) for c in zip(*parts))
                turn = a > b
                a, b, na, nb, ia, ib = (np.where(turn, y, x) for x, y in ((a, b), (b, a), (na, nb), (nb, na), (ia, ib), (ib, ia)))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (a, b, na, nb, ia, ib, tied)], names=["a", "b", "na", "nb", "ia", "ib", "tied"])
            last = slice(max(0, len(key) - near), None)
            keep = key[last] == key[-1]
            at = np.flatnonzero(keep) + max(0, len(key) - near)
            tail = ((key[at], doc[at], n[at], place[at]), int(rank[at[0]]))

    dealt = postings.select("key", "doc_id", "n", "place").repartition("key").sortWithinPartitions("key", "n", "doc_id")
    return dealt.mapInArrow(scan, "a long, b long, na int, nb int, ia int, ib int, tied boolean")


def first_length(n, percent: int):
    """``first_shingles`` of a column."""
    return F.least(n, F.floor(n * ((100 - percent) * 13) / 1000) + 2)


def candidate_edges(pairs: DataFrame, percent: int) -> DataFrame:
    """Pairs that may link: from long lists, or by the bound of their symmetric difference.

    Up to the last shared first shingle, at places ia and ib, the sets hold ia + ib + 2 shingles
    of which c are shared; of what follows, the shorter rest is met by none of the other's.
    """
    met = pairs.where("a <> b").groupBy("a", "b", "na", "nb").agg(F.count("*").alias("c"), F.max(F.struct("ia", "ib")).alias("last"), F.max("tied").alias("tied"))
    rest = F.least(first_length(F.col("na"), percent) - 1 - F.col("last.ia"), first_length(F.col("nb"), percent) - 1 - F.col("last.ib"))
    apart = F.col("last.ia") + F.col("last.ib") + 2 - 2 * F.col("c") + rest
    return met.where(F.col("tied") | (apart <= F.floor(most_apart(F.col("na"), F.col("nb"), percent)))).select("a", "b")


def links(ids: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the linked pairs among ``sets``, as pairs of ids."""
    n = len(sets)
    if n < 2:
        return []
    size = np.array([len(s) for s in sets])
    flat, member = np.concatenate(sets), np.repeat(np.arange(n), size)
    by = np.argsort(flat, kind="stable")
    keys, first, runs = np.unique(flat[by], return_index=True, return_counts=True)
    lists, code = member[by], np.searchsorted(keys, flat)
    own = np.split(code, np.cumsum(size)[:-1])  # ascending, as the sets are
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    def lists_of(codes: np.ndarray) -> np.ndarray:
        """Members of the index lists of these shingles, one after another."""
        if not len(codes):
            return np.zeros(0, np.int64)
        lengths = runs[codes]
        ends = np.cumsum(lengths)
        return lists[np.arange(ends[-1]) - np.repeat(ends - lengths, lengths) + np.repeat(first[codes], lengths)]

    out = []
    leader = np.full(n, -1)  # a set whose answers are known and that is similar
    gap = np.full(n, np.iinfo(np.int64).max)
    known: dict[int, np.ndarray] = {}
    for x in np.argsort(-size, kind="stable"):
        p = leader[x]
        if p >= 0:  # derive the overlaps from those of a similar set
            gone, new = np.setdiff1d(own[p], own[x], assume_unique=True), np.setdiff1d(own[x], own[p], assume_unique=True)
            overlap = known[p] - np.bincount(lists_of(gone), minlength=n) + np.bincount(lists_of(new), minlength=n)
        else:
            overlap = np.bincount(lists_of(own[x]), minlength=n)
        apart = size[x] + size - 2 * overlap
        if p < 0:
            close = (apart < gap) & (4 * apart <= size)
            close[x] = False
            leader[close & (leader < 0)] = x
            gap[close] = np.minimum(gap[close], apart[close])
            if (leader == x).any():
                known[x] = overlap
        union = size[x] + size - overlap
        for y in np.flatnonzero(100 * overlap >= percent * union):
            a, b = root(int(x)), root(int(y))
            if a != b:
                parent[a] = b
                out.append((int(ids[x]), int(ids[y])))
    return out


def id_table(ids: DataFrame) -> bytes:
    """A bit table of fixed size in which the hashes of the column ``doc_id`` are set."""
    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = id_hash(batch.column(0))
            part = (h >> np.uint64(WANTED_BITS - 6)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array((h & np.uint64((1 << WANTED_BITS - 6) - 1)).astype(np.int32))], names=["part", "bit"])

    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        table = np.zeros(1 << WANTED_BITS - 6, np.uint8)
        table[rows["bit"].to_numpy()] = 1
        return pd.DataFrame({"part": [key[0]], "bits": [np.packbits(table, bitorder="little").tobytes()]})

    hashes = ids.select("doc_id").mapInArrow(bits, "part int, bit int").distinct()
    parts = {r["part"]: bytes(r["bits"]) for r in hashes.groupBy("part").applyInPandas(pack, "part int, bits binary").collect()}  # 4 MB in all
    return b"".join(parts.get(k, bytes(1 << WANTED_BITS - 9)) for k in range(1 << 6))


def id_hash(ids: pa.Array) -> np.ndarray:
    return mixed(ids.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) * MULT) >> np.uint64(64 - WANTED_BITS)


def in_table(docs: DataFrame, sent, wanted: bool, id_col: str = "doc_id") -> DataFrame:
    """Rows whose id may be in a broadcast bit table, or those whose id is surely not."""
    at = docs.columns.index(id_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(sent.value, np.uint8)
        for batch in batches:
            h = id_hash(batch.column(at))
            on = (table[(h >> np.uint64(3)).astype(np.int64)] >> (h & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
            yield batch.filter(pa.array(on == wanted))

    return small_batches(docs).mapInArrow(keep, docs.schema)


def only(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``docs`` joined with ``wanted`` on doc_id; rows surely not wanted are left out before the shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast(id_table(wanted))
    return in_table(docs, sent, True).join(wanted, "doc_id")


def without(docs: DataFrame, unwanted: DataFrame) -> DataFrame:
    """``docs`` whose doc_id is not in ``unwanted``; rows surely not in it pass without a shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast(id_table(unwanted))
    return in_table(docs, sent, False).union(in_table(docs, sent, True).join(unwanted.select("doc_id"), "doc_id", "left_anti"))


def indexed_inside(docs: DataFrame, clusters: DataFrame, words: int, percent: int) -> DataFrame:
    """Index lists of the sets of clusters, each cluster with the exact frequencies of its own shingles.

    ``clusters`` holds doc_id and cluster. Shingles that occur once in a cluster are left out; the
    others are ordered by their number of sets, equals by hash. Returns postings as ``near_pairs``
    reads them; lists of different clusters have different keys.
    """
    def make():
        shingler = Shingler(words)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = [s for at in range(0, batch.num_rows, BATCH) for s in shingler(batch.column(1).slice(at, BATCH))]
            sizes = [len(s) for s in sets]
            marks = [int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True) for s in sets]
            keys = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), pa.array(np.concatenate(sets).view(np.int64)))
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(sizes, pa.int32()), pa.array(marks, pa.int64()), keys],
                                              names=["doc_id", "cluster", "n", "mark", "keys"])
        return step

    texts = only(docs.select("doc_id", "text"), clusters.select("doc_id", "cluster")).dropDuplicates(["doc_id", "text"])
    sets = map_texts(texts, ["doc_id", "text", "cluster"], "doc_id long, cluster long, n int, mark long, keys array<long>", make)
    held = materialize(sets, "inside")
    rows = held.select("doc_id", "cluster", "n", "mark", F.explode("keys").alias("key"))
    often = rows.groupBy("cluster", "key").agg(F.count("*").alias("c")).where("c > 1")
    own = Window.partitionBy("doc_id", "mark")
    placed = rows.join(often, ["cluster", "key"]).withColumn("place", F.col("n") - F.count("*").over(own) + F.row_number().over(own.orderBy("c", "key")) - 1)
    first = placed.where(F.col("place") < first_length(F.col("n"), percent))
    return first.select(F.xxhash64("cluster", "key").alias("key"), "doc_id", "n", F.col("place").cast("int").alias("place"))


def copied(clusters: DataFrame, block: int) -> tuple[DataFrame, int]:
    """Members of clusters beyond one block, and how many shingles their check would send out."""
    weights = clusters.groupBy("cluster").agg(F.ceil(F.sum("n") / block).alias("blocks")).where("blocks > 1")
    large = materialize(clusters.join(weights, "cluster"), "large")
    return large.drop("blocks"), large.agg(F.sum(F.col("n") * F.col("blocks"))).first()[0] or 0


def cut_clusters(docs: DataFrame, clusters: DataFrame, words: int, percent: int, block: int = BLOCK) -> DataFrame:
    """``clusters`` (doc_id, n, cluster), those beyond one block cut by an index of their own.

    Linked sets stay together; a set without a possible partner is in no cluster any more. Ends
    when the work left for the check falls by less than a tenth.
    """
    large, work = copied(clusters, block)
    while work:
        edges = materialize(candidate_edges(near_pairs(indexed_inside(docs, large, words, percent), percent), percent), "pairs")
        parts = components(edges).withColumnsRenamed({"node": "doc_id", "component": "cluster"})
        kept = clusters.join(large.select("cluster").distinct(), "cluster", "left_anti").select("doc_id", "n", "cluster")
        clusters = materialize(kept.unionByName(large.select("doc_id", "n").join(parts, "doc_id")), "clusters")
        before = work
        large, work = copied(clusters, block)
        if 10 * work > 9 * before:
            break
    return clusters


def verified_links(docs: DataFrame, clusters: DataFrame, words: int, percent: int, block: int = BLOCK) -> DataFrame:
    """Links (a, b) inside clusters that make the same components as all links.

    ``clusters`` holds doc_id, n and cluster. A cluster is cut into blocks of about ``block``
    shingles; every pair of its blocks is one task's work, and a set goes to as many tasks as its
    cluster has blocks.
    """
    blocks = clusters.groupBy("cluster").agg(F.ceil(F.sum("n") / block).cast("int").alias("blocks"))
    placed = clusters.join(blocks, "cluster").withColumn("own", F.pmod(F.xxhash64("doc_id"), "blocks").cast("int"))

    def make():
        shingler = Shingler(words)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = [s.tobytes() for at in range(0, batch.num_rows, BATCH) for s in shingler(batch.column(1).slice(at, BATCH))]
            return pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], pa.array(sets, pa.binary())], names=["doc_id", "cluster", "blocks", "own", "shingles"])
        return step

    texts = only(docs.select("doc_id", "text"), placed.select("doc_id", "cluster", "blocks", "own"))
    sets = map_texts(texts, ["doc_id", "text", "cluster", "blocks", "own"], "doc_id long, cluster long, blocks int, own int, shingles binary", make)
    tasks = sets.select("doc_id", "cluster", "own", "shingles", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    tasks = tasks.select("doc_id", "cluster", "shingles", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))

    def check(rows: pa.Table) -> pa.Table:
        ids = rows.column("doc_id").to_numpy()
        found = links(ids, [np.frombuffer(x.as_buffer(), np.uint64) for x in rows.column("shingles")], percent)
        return pa.table({"a": pa.array([x[0] for x in found], pa.int64()), "b": pa.array([x[1] for x in found], pa.int64())})

    return tasks.groupBy("cluster", "low", "high").applyInArrow(check, "a long, b long")


def shingle_components(docs: DataFrame, words: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Components of documents whose sets of ``words``-word shingles have a Jaccard index of ``percent`` / 100 or more.

    Words are runs of characters other than blank, tab, line ends, vertical tab and form feed, with
    A-Z lower-cased. A text of fewer words has its whole sequence as only shingle; one without
    words, a null or an empty text has the empty set and is linked with nothing. Returns one row
    per input row: doc_id, n_shingles (size of the set) and component_id, the smallest id that
    links reach. Rows with a null id are left out. Rows of one id are one node. Further columns are
    not read; an empty table gives an empty result.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id IS NOT NULL")
    rows = materialize(set_rows(texts, count_shingles(texts, words), words, percent), "sets")
    keyed = rows.where("n > 0 AND size(keys) > 0")
    first = rows.where("n > 0").groupBy("digest").agg(F.min("doc_id").alias("first"))
    heads = keyed.join(first, "digest").where("doc_id = first").select("doc_id", "n", "digest", "keys", "places").dropDuplicates(["doc_id", "digest"])
    postings = heads.select("doc_id", "n", F.explode(F.arrays_zip("keys", "places")).alias("p")).select(F.col("p.keys").alias("key"), "doc_id", "n", F.col("p.places").alias("place"))
    edges = materialize(candidate_edges(near_pairs(postings, percent), percent), "pairs")
    together = materialize(components(edges).withColumnsRenamed({"node": "doc_id", "component": "cluster"}), "clusters")
    sized = materialize(together.join(heads.groupBy("doc_id").agg(F.max("n").alias("n")), "doc_id"), "sized")
    found = materialize(verified_links(texts, cut_clusters(texts, sized, words, percent), words, percent), "links")
    parts = components(found).withColumnsRenamed({"node": "first", "component": "part"})
    whole = first.join(parts, "first", "left").select("digest", F.coalesce("part", "first").alias("component"))
    return rows.join(whole, "digest", "left").select("doc_id", F.col("n").cast("long").alias("n_shingles"),
                                                     F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"))
