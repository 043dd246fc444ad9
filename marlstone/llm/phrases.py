"""Substring dedup: words covered by passages of WINDOW words that recur anywhere are removed.

1. Segments. A window's anchor is the leftmost least hash among its runs of ANCHOR words, so equal windows have equal anchors
   at equal places. Windows of one anchor are neighbours; together they are its core. Anchors seen once cannot belong to a
   recurring window. For each of the others every distinct text gives a segment: the words of the anchor's core.
2. Confirm passages. A core seen twice is a passage as a whole. Where cores of one anchor differ, their windows are compared
   by hash, and neighbouring windows that the same cores have make a passage. Each passage is written down once, as words.
3. Compile automata. Passages are dealt by their anchors to shards of SHARD_CHARS characters, one Aho-Corasick automaton each.
4. Stream the documents. Each segment goes to the shard of its anchor, which has every passage that can begin with that
   anchor's windows, and the automaton locates every occurrence. What it locates is removed, and nothing else is. Parts of a
   document without recurring anchors cannot hold a passage and are not sent.

No passage or segment passes through the driver. A shard that many segments ask for is repeated SLICE segments at a time.
Passages are found by 128 bits of hashes (anchor and core, or anchor and window) and located by their characters; only words
over LONG_WORD bytes stand in automata as their 128-bit digests. What is joined to documents is broadcast if its bytes, summed up
here, are within MOST_BYTES, else joined by a shuffle on the texts' digest.

Nulls: a null text has no words; null ids are ids. Repeated rows, and equal texts, recur as wholes; of equal texts one is
streamed and all are cut. Whole texts are read, however long. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import hint_if_light, importable, materialize, tidy

WINDOW = 35
ANCHOR = 6
SHARD_CHARS = 500_000
#: Segments that an automaton scans before another task takes the rest.
SLICE = 50_000
LONG_WORD = 48
#: Bytes up to which what goes to the documents is broadcast.
MOST_BYTES = 32 << 20

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of the base and of its inverse modulo 2^64, grown as needed."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def to(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, 2 * len(cls.up), 4096)
            cls.up, cls.down = (np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)))) for b in (_BASE, _INVERSE))
        return cls.up[:n], cls.down[:n]


class Text:
    """A text's words, its anchors (place ``p``, first and last window ``a`` and ``b``) and hashes of its runs of words."""

    def __init__(self, raw: bytes, window: int = WINDOW, anchor: int = ANCHOR):
        self.words, self.window = raw.split(), window
        n = len(self.words)
        self.p = self.a = self.b = np.empty(0, np.int64)
        if n < window:
            return
        digest = xxhash.xxh64_intdigest
        up, self._down = Powers.to(n + 1)
        h = np.array([digest(w) for w in self.words], np.uint64)
        self._sums = np.concatenate((np.zeros(1, np.uint64), np.add.accumulate(h * up[:n])))
        g = self.runs(np.arange(n - anchor + 1), anchor)
        span = window - anchor + 1
        least, at, width = g, np.arange(len(g)), 1
        while 2 * width <= span:
            left = least[:-width] <= least[width:]
            least, at = np.where(left, least[:-width], least[width:]), np.where(left, at[:-width], at[width:])
            width *= 2
        if (rest := span - width):
            left = least[:-rest] <= least[rest:]
            at = np.where(left, at[:-rest], at[rest:])
        change = np.flatnonzero(np.diff(at)) + 1
        self.a = np.concatenate(([0], change))
        self.b = np.concatenate((change - 1, [len(at) - 1]))
        self.p = at[self.a]
        self.hash = g[self.p]

    def runs(self, at: np.ndarray, size: int | np.ndarray) -> np.ndarray:
        """A hash of the words [at, at + size)."""
        return _mix((self._sums[at + size] - self._sums[at]) * self._down[at])

    def cores(self) -> np.ndarray:
        shape = (self.p - self.a).astype(np.uint64) * _M1 + (self.b - self.a).astype(np.uint64) * _M2
        return _mix(self.runs(self.a, self.b - self.a + self.window) ^ _mix(shape + np.uint64(1)))


def _parts(batches: Iterator[pa.RecordBatch], rows: int = 64) -> Iterator[pa.RecordBatch]:
    """Batches in parts of few texts, as the words of many would fill a worker's memory."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _raw(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _longs(parts: list[np.ndarray]) -> pa.Array:
    return pa.array(np.concatenate(parts).view(np.int64) if parts else np.empty(0, np.int64))


def _line(words: list[bytes]) -> str:
    """Words with a space before, between and after; long ones by digest."""
    short = [w if len(w) <= LONG_WORD and w[:1] != b"\x01" else b"\x01" + xxhash.xxh3_128_hexdigest(w).encode() for w in words]
    return " " + b" ".join(short).decode("utf-8", "surrogatepass") + " "


def automaton(passages: set[str]) -> ahocorasick.Automaton:
    """Finds passages with their lengths in characters and in words."""
    out = ahocorasick.Automaton()
    for p in passages:
        out.add_word(p, (len(p), p.count(" ") - 1))
    out.make_automaton()
    return out


def locate(shard: ahocorasick.Automaton, segment: str) -> Iterator[tuple[int, int]]:
    """(first word, end) of every occurrence of a passage."""
    for last, (size, n) in shard.iter(segment):
        first = segment.count(" ", 0, last - size + 1)
        yield first, first + n


def _windows(line: str, window: int = WINDOW) -> np.ndarray:
    """A hash of each window of a segment."""
    words = line.split(" ")[1:-1]
    up, down = Powers.to(len(words) + 1)
    h = np.array([xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) for w in words], np.uint64)
    sums = np.concatenate((np.zeros(1, np.uint64), np.add.accumulate(h * up[: len(words)])))
    at = np.arange(len(words) - window + 1)
    return _mix((sums[at + window] - sums[at]) * down[at])


def segments(docs: DataFrame, kind: str) -> DataFrame:
    """``docs`` (doc_id, text, copy) to the segments of distinct texts: h (anchor), core, lead (windows before the one that begins

    with the anchor), copy (digest of the text), n (rows with that text), a (first word), line (the words).
    """

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            found = [Text(_raw(t)) for t in batch.column(1).to_pylist()]
            of = np.repeat(np.arange(len(found)), [len(x.p) for x in found])
            yield pa.RecordBatch.from_arrays([_longs([x.hash for x in found if len(x.p)]), batch.column(0).take(pa.array(of)), batch.column(2).take(pa.array(of)), _longs([x.p for x in found]).cast(pa.int32())], names=["h", "doc_id", "copy", "p"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            h, core, lead, at, lines, of = [], [], [], [], [], []
            for i, (t, places) in enumerate(zip(batch.column(0).to_pylist(), batch.column(3).to_pylist())):
                x = Text(_raw(t))
                k = np.flatnonzero(np.isin(x.p, np.array(places, np.int64)))
                h.append(x.hash[k])
                core.append(x.cores()[k])
                lead.append((x.p - x.a)[k])
                at.append(x.a[k])
                lines += [_line(x.words[u : v + WINDOW]) for u, v in zip(x.a[k].tolist(), x.b[k].tolist())]
                of += [i] * len(k)
            take = pa.array(of, pa.int64())
            yield pa.RecordBatch.from_arrays([_longs(h), _longs(core), _longs(lead).cast(pa.int32()), batch.column(1).take(take), batch.column(2).take(take), _longs(at).cast(pa.int32()), pa.array(lines, pa.string())], names=["h", "core", "lead", "copy", "n", "a", "line"])

    known = materialize(docs.mapInArrow(anchors, f"h bigint, doc_id {kind}, copy binary, p int"), "anchors")
    recurring = materialize(known.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("h").alias("of_h")), "recurring")
    marks = known.join(hint_if_light(recurring, F.lit(8), MOST_BYTES), F.col("h") == F.col("of_h"), "left_semi")
    marks = marks.groupBy(F.col("copy").alias("m_copy")).agg(F.collect_set("p").alias("places"), F.min(F.struct(F.col("doc_id").isNull().alias("no"), F.col("doc_id").alias("id"))).alias("least"), F.count(F.lit(1)).alias("n"))
    marks = materialize(marks.select("m_copy", "places", F.col("least.id").alias("least"), (F.col("n") / F.size("places")).cast("bigint").alias("n")), "marks")
    whole = docs.join(hint_if_light(marks, 48 + 4 * F.size("places"), MOST_BYTES), (F.col("copy") == F.col("m_copy")) & F.col("doc_id").eqNullSafe(F.col("least")))
    return materialize(whole.select("text", "copy", "n", "places").mapInArrow(cut, "h bigint, core bigint, lead int, copy binary, n bigint, a int, line string"), "segments")


def passages(parts: DataFrame) -> DataFrame:
    """Of segments, the passages that recur: h, line. A passage may be given more than once."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches, 4096):
            h, core, lead, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            w = [_windows(x) for x in batch.column(4).to_pylist()]
            of = np.repeat(np.arange(len(w)), [len(x) for x in w])
            back = np.concatenate([k - np.arange(len(x)) for k, x in zip(lead, w)]) if w else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(h[of]), _longs(w), pa.array(core[of]), pa.array(back.astype(np.int32)), pa.array(n[of])], names=["h", "w", "core", "back", "n"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, out = [], []
            for anchor, lead, line, found in zip(*(batch.column(i).to_pylist() for i in range(4))):
                words = line.split(" ")[1:-1]
                starts = sorted((lead - x["back"], x["holders"], x["cores"]) for x in found)
                at = 0
                for i in range(1, len(starts) + 1):
                    if i == len(starts) or starts[i] != (starts[i - 1][0] + 1, *starts[i - 1][1:]):
                        h.append(anchor)
                        out.append(" " + " ".join(words[starts[at][0] : starts[i - 1][0] + WINDOW]) + " ")
                        at = i
            yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(out, pa.string())], names=["h", "line"])

    by_core = parts.groupBy("h", "core").agg(F.sum("n").alias("n"), F.min(F.struct("copy", "a")).alias("least"))
    by_anchor = by_core.groupBy(F.col("h").alias("a_h")).agg(F.count(F.lit(1)).alias("cores"), F.min("n").alias("rarest"))
    state = by_core.join(by_anchor, F.col("h") == F.col("a_h")).select(
        F.col("h").alias("s_h"), F.col("core").alias("s_core"), F.col("n").alias("s_n"), F.col("least.copy").alias("s_copy"), F.col("least.a").alias("s_a"), ((F.col("cores") > 1) & (F.col("rarest") == 1)).alias("compare"))
    state = state.filter((F.col("s_n") > 1) | F.col("compare"))
    mine = (F.col("h") == F.col("s_h")) & (F.col("core") == F.col("s_core")) & (F.col("copy") == F.col("s_copy")) & (F.col("a") == F.col("s_a"))
    firsts = materialize(parts.join(state, mine).select("h", "core", "lead", F.col("s_n").alias("n"), "line", "compare"), "cores")

    seen = materialize(firsts.filter("compare").select("h", "core", "lead", "n", "line").mapInArrow(windows, "h bigint, w bigint, core bigint, back int, n bigint"), "windows")
    shared = seen.groupBy("h", "w").agg(F.sum("n").alias("n"), F.min("n").alias("rarest"), F.count(F.lit(1)).alias("cores"), F.bit_xor(F.xxhash64("core")).alias("holders"), F.min("core").alias("owner"), F.min("back").alias("back"))
    shared = shared.filter((F.col("n") > 1) & (F.col("rarest") == 1))  # those of whole cores only lie in whole passages
    runs = shared.groupBy(F.col("h").alias("r_h"), "owner").agg(F.collect_list(F.struct("back", "holders", "cores")).alias("found"))
    cuts = firsts.join(runs, (F.col("h") == F.col("r_h")) & (F.col("core") == F.col("owner"))).select("h", "lead", "line", "found").mapInArrow(cut, "h bigint, line string")
    return materialize(firsts.filter("n > 1").select("h", "line").unionByName(cuts), "passages")


def occurrences(parts: DataFrame, known: DataFrame, shard_chars: int = SHARD_CHARS, slice_: int = SLICE) -> DataFrame:
    """Where the automata find passages (``known``: h, line) in segments: copy, spans (first word and end of each stretch, in turn)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, now = None, set(), None
        for batch in batches:
            out = []
            for g, copy, a, line in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if g != now:  # a shard's passages come before its segments
                    shard, held, now = None, set(), g
                if copy is None:
                    held.add(line)
                    continue
                if shard is None:
                    shard, held = automaton(held), set()
                hits = sorted(locate(shard, line))
                while hits:  # a segment's passages overlap
                    first, end = hits[0]
                    k = 1
                    while k < len(hits) and hits[k][0] <= end:
                        end = max(end, hits[k][1])
                        k += 1
                    out.append((copy, a + first, a + end))
                    hits = hits[k:]
            copies, first, end = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(copies, pa.binary()), pa.array(first, pa.int32()), pa.array(end, pa.int32())], names=["copy", "first", "end"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for found in batch.column(1).to_pylist():
                merged: list[int] = []
                for x in sorted((x["first"], x["end"]) for x in found):
                    if merged and x[0] <= merged[-1]:
                        merged[-1] = max(merged[-1], x[1])
                    else:
                        merged += x
                out.append(merged)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int32()))], names=["copy", "spans"])

    asked = parts.groupBy(F.col("h").alias("p_h")).agg(F.count(F.lit(1)).alias("asked"))
    routes = known.groupBy(F.col("h").alias("r_h")).agg(F.sum(F.length("line")).alias("chars")).join(asked, F.col("r_h") == F.col("p_h"))
    routes = materialize(routes.select("r_h", "chars", F.ceil(F.col("asked") / slice_).cast("int").alias("copies")), "routes")
    shards = max(1, -(-(routes.agg(F.sum(F.col("chars") * F.col("copies"))).first()[0] or 0) // shard_chars))
    shard = F.pmod(F.xxhash64("h", "salt"), F.lit(shards)).alias("g")
    few = hint_if_light(routes, F.lit(24), MOST_BYTES)
    given = known.join(few, F.col("h") == F.col("r_h")).select("h", "line", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("salt"))
    given = given.select(shard, F.lit(None).cast("binary").alias("copy"), F.lit(None).cast("int").alias("a"), "line")
    sent = parts.join(few, F.col("h") == F.col("r_h")).withColumn("salt", F.pmod(F.xxhash64("copy", "a"), F.col("copies")).cast("int")).select(shard, "copy", "a", "line")
    dealt = given.unionByName(sent).repartition("g").sortWithinPartitions("g", F.col("copy").asc_nulls_first())
    found = materialize(dealt.mapInArrow(scan, "copy binary, first int, end int"), "found")
    return materialize(found.groupBy("copy").agg(F.collect_list(F.struct("first", "end")).alias("found")).mapInArrow(merge, "copy binary, spans array<int>"), "places")


def removed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shard_chars: int = SHARD_CHARS, slice_: int = SLICE) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256, kept_text."""
    importable(docs.sparkSession)
    kind = docs.schema[doc_id].dataType.simpleString()
    whole = F.coalesce(F.col(text), F.lit(""))
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.unhex(F.md5(whole)).alias("copy"))
    parts = segments(texts, kind)
    tidy(docs.sparkSession)
    known = passages(parts)
    tidy(docs.sparkSession)
    places = occurrences(parts, known, shard_chars, slice_).withColumnRenamed("copy", "p_copy")
    tidy(docs.sparkSession)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            sizes, gone, kept = [], [], []
            for t, spans in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                words = _raw(t).split()
                sizes.append(len(words))
                edges = [0, *(spans or ()), len(words)]
                left = [w for i in range(0, len(edges), 2) for w in words[edges[i] : edges[i + 1]]]
                gone.append(len(words) - len(left))
                kept.append(b" ".join(left))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()), pa.array([k.decode("utf-8", "replace") for k in kept], pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    out = texts.join(hint_if_light(places, 48 + 4 * F.size("spans"), MOST_BYTES), F.col("copy") == F.col("p_copy"), "left").select("doc_id", "text", "spans")
    return out.mapInArrow(finish, f"doc_id {kind}, n_words bigint, n_removed bigint, kept_sha256 string, kept_text string")
