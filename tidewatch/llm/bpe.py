"""Byte-pair encoding and decoding by forced-boundary splitting.

A pair of neighbouring bytes that occurs inside no vocabulary token can never be merged
over, so it marks a certain cut: what lies left and right of it is encoded independently
and the ids are concatenated. Three kinds of cut are used, coarse to fine:

* before a blank that follows a non-blank: no token holds such a pair, and the
  pre-tokenising pattern always ends a word there. A text falls into chunks at these cuts
  and every chunk is encoded once per task.
* the word boundaries of the pre-tokenising pattern inside a chunk.
* impossible byte pairs inside a word. The remaining fragments are merged by rank.

The vocabulary file is the one of the ``tokenizers`` library; its special tokens are cut out
of the text first, as that library does.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from array import array
from collections.abc import Callable, Iterable
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tidewatch.llm.common import map_texts

#: Bytes of chunks, and of words, kept per task (text and ids; an entry counts for ``ENTRY`` bytes besides); a full store is emptied.
KEPT, ENTRY = 60_000_000, 120
#: Characters from which a chunk or word is not kept beyond its batch.
RARE = 200
#: Texts encoded at once.
BATCH = 512
#: Bytes from which a fragment is joined with a heap.
LONG = 64
NONE = np.iinfo(np.int32).max
HASH = np.int64(0x9E3779B97F4A7C1)
#: Fixed value: the word pattern of byte-level vocabularies.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s+(?!\S)|\s+"


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class ByteBpe:
    """Encoder and decoder of one vocabulary file.

    Defined results: an empty text has no ids; ids of unknown value raise ``KeyError``.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        back = {letter: b for b, letter in enumerate(byte_letters())}
        vocab: dict[str, int] = spec["model"]["vocab"]
        raw = {token: bytes(back[c] for c in token) for token in vocab}
        self.specials: dict[str, int] = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = {i: raw[token] for token, i in vocab.items()} | {i: s.encode() for s, i in self.specials.items()}
        self.byte_id = np.array([vocab[letter] for letter in byte_letters()], np.int32)
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merge[vocab[a], vocab[b]] = (rank, vocab[a + b])
        self.joined = np.array([new for _, new in self.merge.values()], np.int32)
        self._index_merges()
        self.never = np.ones((256, 256), bool)
        for token in raw.values():
            for pair in zip(token, token[1:]):
                self.never[pair] = False
        self.words = regex.compile(WORDS).findall
        self.special = regex.compile("|".join(sorted(map(regex.escape, self.specials), key=len, reverse=True))) if self.specials else None
        self._chunk: dict[str, bytes] = {}
        self._word: dict[str, bytes] = {}
        self._bytes = {"chunk": 0, "word": 0}

    def _index_merges(self) -> None:
        """An open-addressing table from pairs of ids to ranks."""
        size = 1 << (4 * len(self.merge)).bit_length()
        self.mask, self.keys, self.ranks = size - 1, np.full(size, -1, np.int64), np.zeros(size, np.int32)
        pairs = np.array(list(self.merge), np.int64).reshape(-1, 2)
        key = (pairs[:, 0] << 32) | pairs[:, 1]
        for k, slot, (rank, _) in zip(key.tolist(), ((key * HASH >> 20) & self.mask).tolist(), self.merge.values()):
            while self.keys[slot] != -1:
                slot = (slot + 1) & self.mask
            self.keys[slot], self.ranks[slot] = k, rank

    def _merged_long(self, ids: list[int]) -> list[int]:
        """Join neighbours, lowest rank first and leftmost among equals, until none can be joined.

        For long fragments: a heap of joins and links between neighbours.
        """
        merge, n = self.merge.get, len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        alive = [True] * n
        heap = [(*m, i, a, b) for i, (a, b) in enumerate(zip(ids, ids[1:])) if (m := merge((a, b)))]
        heap = [(r, i, a, b, new) for r, new, i, a, b in heap]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j], after[i] = new, False, after[j]
            if after[i] < n:
                before[after[i]] = i
                if m := merge((new, ids[after[i]])):
                    heapq.heappush(heap, (m[0], i, new, ids[after[i]], m[1]))
            if before[i] >= 0 and (m := merge((ids[before[i]], new))):
                heapq.heappush(heap, (m[0], before[i], ids[before[i]], new, m[1]))
        return [t for t, live in zip(ids, alive) if live]

    def _pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids, ``NONE`` where they never join."""
        key = (a.astype(np.int64) << 32) | b
        out = np.full(len(key), NONE, np.int32)
        slot, todo = (key * HASH >> 20) & self.mask, np.arange(len(key))
        while len(todo):
            found = self.keys[slot]
            hit = found == key[todo]
            out[todo[hit]] = self.ranks[slot[hit]]
            on = ~hit & (found != -1)
            todo, slot = todo[on], (slot[on] + 1) & self.mask
        return out

    def _merged_all(self, words: list[bytes]) -> list[bytes]:
        """Ids of many words at once: every round joins the lowest pair of every fragment."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        first = np.zeros(len(raw) + 1, bool)
        ends = np.cumsum(sizes)
        first[ends - sizes] = first[len(raw)] = True
        first[1:-1] |= self.never[raw[:-1], raw[1:]]
        starts = np.flatnonzero(first)
        length = np.diff(starts)
        word_of = np.searchsorted(ends, starts[:-1], side="right")
        ids, frag = self.byte_id[raw], np.repeat(np.arange(len(length)), length)
        done_ids, done_frag = [], []
        for f in np.flatnonzero(length > LONG):
            joined = np.array(self._merged_long(ids[starts[f]:starts[f + 1]].tolist()), np.int32)
            done_ids.append(joined)
            done_frag.append(np.full(len(joined), f))
        on = length[frag] <= LONG
        ids, frag = ids[on], frag[on]
        rank = np.full(len(ids), NONE, np.int32)
        inner = np.flatnonzero(frag[:-1] == frag[1:])
        rank[inner] = self._pair_rank(ids[inner], ids[inner + 1])
        while len(ids):
            begin = np.flatnonzero(np.r_[True, frag[1:] != frag[:-1]])
            lowest = np.repeat(np.minimum.reduceat(rank, begin), np.diff(np.r_[begin, len(ids)]))
            over = lowest == NONE
            if over.any():
                done_ids.append(ids[over])
                done_frag.append(frag[over])
                ids, frag, rank, lowest = ids[~over], frag[~over], rank[~over], lowest[~over]
                if not len(ids):
                    break
            at = np.flatnonzero(rank == lowest)
            at = at[np.r_[True, frag[at[1:]] != frag[at[:-1]]]]
            ids[at] = self.joined[rank[at]]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            at = at - np.arange(len(at))  # one element goes in every fragment before
            ids, frag, rank = ids[keep], frag[keep], rank[keep]
            rank[at] = NONE
            right = at[(at + 1 < len(ids))]
            right = right[frag[right] == frag[right + 1]]
            left = at[at > 0] - 1
            left = left[frag[left] == frag[left + 1]]
            both = np.concatenate([left, right])
            rank[both] = self._pair_rank(ids[both], ids[both + 1])
        ids, frag = np.concatenate(done_ids), np.concatenate(done_frag)
        order = np.argsort(frag, kind="stable")
        blob = ids[order].astype("<u4").tobytes()
        stop = 4 * np.cumsum(np.bincount(word_of[frag], minlength=len(words)))
        return [blob[i:j] for i, j in zip([0, *stop[:-1].tolist()], stop.tolist())]

    def _of_words(self, words: list[str]) -> list[bytes]:
        """Ids of words of the pattern, each distinct word joined once per task."""
        store = self._word
        if new := list({w for w in words if w not in store}):
            store.update(zip(new, self._merged_all([w.encode() for w in new])))
        out = [store[w] for w in words]
        self._trim(store, "word", new)
        return out

    def _trim(self, store: dict[str, bytes], kind: str, new: Iterable[str]) -> None:
        """Forget the long ones of the new entries, and all of a store that holds too many bytes."""
        for x in new:
            if len(x) > RARE:
                del store[x]
            else:
                self._bytes[kind] += ENTRY + 2 * len(x) + len(store[x] or b"")
        if self._bytes[kind] > KEPT:
            store.clear()
            self._bytes[kind] = 0

    def _of_chunks(self, parts: set[str]) -> None:
        """Store the ids of parts that follow a blank.

        An empty part, or one that ends in white space, moves the cut after it: its text is
        left to the pattern as a whole, which ``None`` marks.
        """
        whole = [p for p in parts if p and not p[-1].isspace()]
        self._chunk.update(dict.fromkeys(parts))
        if whole:
            words = self.words(" " + " ".join(whole))
            ids = self._of_words(words)
            begins = [i for i, w in enumerate(words) if w[0] == " "]
            self._chunk.update(zip(whole, [ids[i] if j - i == 1 else b"".join(ids[i:j]) for i, j in zip(begins, [*begins[1:], len(words)])]))

    def _sections(self, text: str) -> list[str | bytes]:
        """Plain sections of a text, and the ids of the special tokens between them."""
        out: list[str | bytes] = []
        at = 0
        for m in self.special.finditer(text):
            out += [text[at:m.start()], self.specials[m.group()].to_bytes(4, "little")]
            at = m.end()
        return [x for x in [*out, text[at:]] if x]

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """Ids of whole texts as little-endian unsigned 32-bit integers; null counts as empty."""
        sections = [self._sections(x) if x and self.special and "<" in x else [x] if x else [] for x in texts]
        parts = [[x.split(" ") if isinstance(x, str) else x for x in own] for own in sections]
        new = set().union(*(x[1:] for own in parts for x in own if isinstance(x, list))).difference(self._chunk)
        self._of_chunks(new)
        chunk, rest, heads = self._chunk.__getitem__, [], []
        for own, cut in zip(sections, parts):
            for x, p in zip(own, cut):
                if isinstance(x, bytes):
                    rest.append([x])
                    heads.append([])
                    continue
                ids = list(map(chunk, p[1:]))
                odd = None in ids or not p[0] or p[0][-1].isspace()
                rest.append([] if odd else ids)
                heads.append(self.words(x) if odd else self.words(p[0]))
        ids_of = iter(self._of_words([w for words in heads for w in words]))
        self._trim(self._chunk, "chunk", new)
        done = iter([b"".join([*islice(ids_of, len(words)), *ids]) for words, ids in zip(heads, rest)])
        return [b"".join(islice(done, len(own))) for own in sections]

    def encode(self, text: str | None) -> bytes:
        return self.encode_batch([text])[0]

    def decode(self, ids: bytes | Iterable[int]) -> str:
        """Text of ids, special tokens included; bytes that are not UTF-8 become U+FFFD."""
        if isinstance(ids, bytes):
            ids = array("I", ids)
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


def token_digests(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode every whole text; return counts and digests, one row per input row.

    ``docs`` may hold further columns, which are not read. Null and empty texts have no
    tokens and the digests of the empty string. Repeated rows stay repeated; an empty table
    gives an empty result. Texts of any length are encoded whole.
    """
    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        bpe = ByteBpe(vocabulary)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            n, ids_sha, text_sha = [], [], []
            for at in range(0, batch.num_rows, BATCH):
                for ids in bpe.encode_batch(batch.column(1).slice(at, BATCH).to_pylist()):
                    n.append(len(ids) // 4)
                    ids_sha.append(hashlib.sha256(ids).hexdigest())
                    text_sha.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())],
                                              names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        return step

    return map_texts(docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")), ["doc_id", "text"],
                     "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", make)
