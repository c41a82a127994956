"""Secret scan: base patterns, and strings in a sensitive context that zstandard cannot foresee.

A candidate is a run of key-like characters shortly after a word such as ``secret`` or
``access key``, or on its line. Its novelty is the number of bytes by which the compressed surroundings grow when
the candidate is put back, per byte of the candidate; the compressor is primed with a dictionary
of common identifiers, and the surroundings hold the code and the identifiers next to it. Names,
paths and repeated values are nearly free, keys are not.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import map_texts, small_batches

#: The base patterns and the least length of what they must find.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_LEAST, ACCESS_LEAST = 6, 20
KINDS = ("assign", "access", "hex", "novel")
#: Words of which one must stand shortly before a candidate or on its line.
CONTEXT = re.compile(r"passw|passphrase|pwd|secret|token|credential|bearer|authorization|(?:api|access|private|auth|signing|client|session|encryption)[ \t_-]?key",
                     re.ASCII | re.IGNORECASE)
#: Parts of which every match of that pattern holds one.
PARTS = ("passw", "passphrase", "pwd", "secret", "token", "credential", "bearer", "authorization", "key")
LEAST_LENGTH = 12
ONE_WORD = re.compile(r"[+/_=.-]*(?:[A-Za-z][a-z]*|[A-Z]+)[+/_=.-]*")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=.-]{%d,}" % LEAST_LENGTH)
#: Characters after a sensitive word in which a candidate may begin on the next lines; on the word's line it may begin anywhere.
REACH = 48
#: Characters of surroundings on either side.
SURROUNDINGS = 512
#: Least growth in bytes, and per byte of the candidate.
LEAST_BYTES, LEAST_SHARE = 8, 0.5
#: Least growth per byte where less speaks for a secret: further than ``REACH`` after a word or before it, and for a
#: candidate that its surroundings hold once more, as names are.
WEAK_SHARE = 0.75
#: Least growth in bytes, and per byte, of a candidate without a second kind of character, which a long word may be as well.
PLAIN_BYTES, PLAIN_SHARE = 15, 0.65
#: Common identifiers that prime the compressor.
IDENTIFIERS = """
import from return class function def const let var static public private final string int long double boolean true false null none
self this new args kwargs name value key index count size length path file open read write close print format json yaml config settings
environ getenv os.environ process.env user username password passwd secret token api_key apikey access_key secret_key client_id client_secret
authorization bearer basic credential credentials session cookie header headers request response http https url localhost host port example
example.com your_api_key_here your-password changeme placeholder xxxxxxxx test testing default undefined database connection postgres mysql
redis mongodb aws azure google github aws_access_key_id aws_secret_access_key private_key public_key BEGIN END RSA KEY certificate
configuration Configuration manager Manager service Service factory Factory provider Provider handler Handler controller Controller
repository Repository security Security authentication Authentication authorization Authorization application Application management
interface Interface component Component exception Exception container Container generator Generator validator Validator
expires encryption signature algorithm validation environment description information implementation development production
abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 1234567890 00000000000000000000000000000000
"""


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Start, end and kind of what the base patterns find, by start and then kind as listed."""
    found = []
    low = text.lower()
    if "passw" in low or "secret" in low or "token" in low or "api" in low:
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


class NoveltyScan:
    """Finds candidates in a sensitive context and measures how new they are."""

    def __init__(self, identifiers: str = IDENTIFIERS, least_share: float = LEAST_SHARE, least_bytes: int = LEAST_BYTES):
        prime = zstandard.ZstdCompressionDict(identifiers.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.compressor = zstandard.ZstdCompressor(level=3, dict_data=prime, write_content_size=False, write_checksum=False)
        self.least_share, self.least_bytes = least_share, least_bytes

    def growth(self, text: str, start: int, end: int) -> tuple[int, bool]:
        """Bytes that the candidate adds to its compressed surroundings, and whether they hold it once more.

        Other occurrences of the candidate are taken out of the surroundings first, also those
        that stand across their edges.
        """
        key = core(text[start:end])
        gap, wide = "\0" * len(key), SURROUNDINGS + len(key)
        before, after = text[max(0, start - wide):start], text[end:end + wide]
        repeated = key in before or key in after
        if repeated:
            before, after = before.replace(key, gap), after.replace(key, gap)
        before, after = before[-SURROUNDINGS:], after[:SURROUNDINGS]
        if repeated:
            before, after = before.replace("\0", ""), after.replace("\0", "")
        size = lambda x: len(self.compressor.compress(x.encode("utf-8", "replace")))
        return size(before + after + text[start:end]) - size(before + after), repeated

    def spans(self, text: str, taken: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
        """Novel strings that overlap none of ``taken``, in order."""
        low = text.lower()
        if not any(part in low for part in PARTS):  # much faster than the pattern
            return []
        words = [m.span() for m in CONTEXT.finditer(text)]
        if not words:
            return []
        ends = [b for _, b in words]
        lines: list[tuple[int, int]] = []
        for a, b in words:
            if not lines or a >= lines[-1][1]:
                stop = text.find("\n", b)
                lines.append((text.rfind("\n", 0, a) + 1, len(text) if stop < 0 else stop))
        found, line, k, busy = [], 0, 0, 0
        taken = sorted(taken)
        for start, end in _candidates(text, words):
            while line < len(lines) and lines[line][1] <= start:
                line += 1
            last = bisect_right(ends, start) - 1
            near = last >= 0 and start <= ends[last] + REACH
            while k < len(taken) and taken[k][0] < end:
                busy = max(busy, taken[k][1])
                k += 1
            if not near and (line == len(lines) or start < lines[line][0]) or busy > start:
                continue
            value = text[start:end]
            grown, repeated = self.growth(text, start, end)
            least, share = self.least_bytes, self.least_share
            if plain := value.isdigit() or ONE_WORD.fullmatch(value):
                least, share = max(least, PLAIN_BYTES), max(share, PLAIN_SHARE)
            if repeated or not near and not plain:
                share = max(share, WEAK_SHARE)
            if grown >= least and grown >= share * len(value):
                found.append((start, end, "novel"))
        return sorted(found + copies(text, found, taken)) if found else found


def _candidates(text: str, words: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Runs of key-like characters; a sensitive word inside a run cuts it into what stands before and after the word."""
    k = 0
    for m in CANDIDATE.finditer(text):
        start, end = m.span()
        while k < len(words) and words[k][1] <= start:
            k += 1
        if k < len(words) and words[k][0] < end:
            if words[k][0] - start >= LEAST_LENGTH:
                yield start, words[k][0]
            start = words[k][1]
        if end - start >= LEAST_LENGTH:
            yield start, end


def core(value: str) -> str:
    """What stands again where a candidate is repeated: its longest part between equal signs, without marks at the ends."""
    part = max(value.split("="), key=len).strip("+/_.-")
    return part if len(part) >= LEAST_LENGTH else value


def copies(text: str, found: list[tuple[int, int, str]], taken: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Further occurrences, in the whole text, of the strings found novel; none overlaps another span."""
    heads: dict[str, set[str]] = {}
    for a, b, _ in found:
        key = core(text[a:b])
        heads.setdefault(key[:LEAST_LENGTH], set()).add(key)
    spans = sorted([*taken, *found])
    out, k, busy = [], 0, 0
    for run in CANDIDATE.finditer(text):
        at = run.start()
        while at + LEAST_LENGTH <= run.end():
            keys = heads.get(text[at:at + LEAST_LENGTH])
            key = max((x for x in keys if text.startswith(x, at)), key=len, default="") if keys else ""
            if key:
                while k < len(spans) and spans[k][0] < at + len(key):
                    busy = max(busy, spans[k][1])
                    k += 1
                if busy <= at:
                    out.append((at, at + len(key), "novel"))
            at += len(key) or 1
    return out


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spans of secrets in every whole text: id and an array of (kind, start, end).

    Positions are code points, ends exclusive; spans come by start and then kind. A null or
    empty text has no spans. Repeated rows stay repeated, further columns are not read, an
    empty table gives an empty result.
    """
    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        scan = NoveltyScan()
        span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            for value in batch.column(1):
                text = value.as_py() or ""
                base = base_spans(text)
                spans = sorted(base + scan.spans(text, base), key=lambda s: (s[0], KINDS.index(s[2])))
                rows.append([{"kind": k, "start": a, "end": b} for a, b, k in spans])
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(span))], names=["doc_id", "spans"])
        return step

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_texts(rows, ["doc_id", "text"], "doc_id long, spans array<struct<kind:string,start:long,end:long>>", make)


def secret_digests(docs: DataFrame) -> DataFrame:
    """Counts of the base spans by kind, the digest of their list, and the list of all spans."""
    spans = secret_spans(docs)
    text = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    base = F.filter("spans", lambda s: s["kind"] != "novel")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias("n_" + kind)
    return spans.select("doc_id", *map(count, KINDS[:3]), F.sha2(F.concat_ws(",", F.transform(base, text)), 256).alias("base_sha256"),
                        F.concat_ws(",", F.transform("spans", text)).alias("spans"))


def masked(docs: DataFrame, mask: str = "[secret]") -> DataFrame:
    """The rows with every secret in ``text`` replaced by ``mask``; ``n_chars`` follows.

    Spans that touch or overlap are one secret. Rows without secrets come back unchanged; a
    null text stays null.
    """
    columns = docs.columns

    def run(batches):
        scan = NoveltyScan()
        at = columns.index("text")
        for batch in batches:
            texts, sizes = [], batch.column(columns.index("n_chars")).to_pylist()
            for i, value in enumerate(batch.column(at)):
                text = value.as_py()
                base = base_spans(text or "")
                spans = sorted(base + scan.spans(text or "", base))
                if spans:
                    out, end = [], 0
                    for a, b, _ in spans:
                        if a > end or not out:
                            out += [text[end:a], mask]
                        end = max(end, b)
                    text = "".join([*out, text[end:]])
                    sizes[i] = len(text)
                texts.append(text)
            own = {"text": pa.array(texts, pa.string()), "n_chars": pa.array(sizes, pa.int64())}
            yield pa.RecordBatch.from_arrays([own.get(c, batch.column(k)) for k, c in enumerate(columns)], names=columns)

    return small_batches(docs).mapInArrow(run, docs.schema)
