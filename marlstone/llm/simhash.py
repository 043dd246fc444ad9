"""SimHash near-duplicates, found by BK-trees over shards of fingerprints.

A BK-tree keeps the children of a node by their Hamming distance to it, so a search for what lies within a radius of a
fingerprint follows only the edges whose distance is within the radius of the fingerprint's own distance to the node.

One tree over all documents would need all fingerprints in one place. Trees are therefore built per shard, and a
fingerprint goes to every shard in which a partner of its own can be:

* ``link`` is exact. A radius of r leaves one of r + 1 blocks of bits as it is, so shards are (block, its value).
* ``near_copies`` is for a similarity of 0.8, at which a tenth of the bits differ and more. Shards are the values of
  seeded choices of k bits of a 256-bit fingerprint. From a million texts on, k grows with the logarithm of their number,
  so shards stay small; the number of choices is what the recall asked for needs. A shard's tree gives no pairs, but as
  few links as join what lies within the radius, so a group of m texts gives some m links and not m * m.
  ``alike`` then finds the true links among the texts that such links join, exactly, by their shingles.

Shards meet their trees by a shuffle, not by the driver, which never sees fingerprints, links or components. A tree holds
distinct fingerprints (or texts) only, so heaps of copies do not count; a shard of many is split by its other bits.

Nulls: a null text is an empty one. Texts without words have fingerprint zero and are copies of one another. A null id is
the least of its group only if all are null. Repeated rows belong to one group. Texts are read whole, however long; a worker
has a few at a time. Empty tables give empty results. Extra columns are ignored by ``groups`` and kept by ``one_of_each``.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator
from itertools import accumulate, chain, islice
from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import fresh, hint_if_small, importable, materialize

SEED = 42
RADIUS = 2
#: Shards of more fingerprints are split by the bits that their members need not share.
LARGE_SHARD = 4096
#: For near copies: words of a shingle, similarity, share of pairs at just that similarity to be found, radius in so many bits.
SHINGLE, SIMILARITY, RECALL, WIDE_RADIUS, WIDE_BITS = 5, 0.8, 0.98, 38, 128
SIGNATURE_BITS = 256
#: Texts in a shard, on average, from which on keys grow by bits.
MEAN_SHARD = 16
#: Shingles of a block of texts that are verified together: 24 MB of hashes.
BLOCK = 3_000_000

_LOWER = bytes.maketrans(ascii_uppercase.encode(), ascii_lowercase.encode())
_U64 = (1 << 64) - 1


def shingle_hashes(text: str | None, n: int) -> np.ndarray:
    """XXH64 of each run of n words (lower-cased A-Z, joined by a space); of all words if there are fewer."""
    tokens = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not tokens:
        return np.empty(0, np.uint64)
    joined = b" ".join(tokens)
    if len(tokens) <= n:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = list(accumulate(len(t) + 1 for t in tokens))
    starts = [0, *ends]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a : b - 1], SEED) for a, b in zip(starts, ends[n - 1 :])], np.uint64)


def _majority(rows: np.ndarray) -> np.ndarray:
    """Of uint64 rows (n, w), the bits that are set in over half: (w,) uint64."""
    n, width = rows.shape
    count = np.zeros(64 * width, np.int64)
    for i in range(0, n, 2048):
        part = np.ascontiguousarray(rows[i : i + 2048].astype("<u8", copy=False))
        count += np.unpackbits(part.view(np.uint8).reshape(len(part), 8 * width), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * count > n, bitorder="little").view("<u8")


def fingerprint(text: str | None, n: int = 3) -> int:
    """The 64-bit SimHash, unsigned; 0 for a text without words."""
    h = shingle_hashes(text, n)
    return int(_majority(h[:, None])[0]) if len(h) else 0


def signature(hashes: np.ndarray) -> np.ndarray:
    """A 256-bit SimHash as four uint64, of which each word comes from a mix of the shingles' hashes of its own."""
    words = []
    for k in range(SIGNATURE_BITS // 64):
        x = hashes + np.uint64((0x9E3779B97F4A7C15 * (k + 1)) & _U64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        words.append(x ^ (x >> np.uint64(31)))
    return _majority(np.stack(words, axis=1))


class BKTree:
    def __init__(self):
        self.root = None

    def add(self, value: int) -> None:
        if self.root is None:
            self.root = (value, {})
            return
        node = self.root
        while True:
            d = (node[0] ^ value).bit_count()
            if d == 0:
                return
            child = node[1].get(d)
            if child is None:
                node[1][d] = (value, {})
                return
            node = child

    def within(self, value: int, radius: int) -> Iterator[int]:
        todo = [self.root] if self.root else []
        while todo:
            at, children = todo.pop()
            d = (at ^ value).bit_count()
            if d <= radius:
                yield at
            for e, child in children.items():
                if d - radius <= e <= d + radius:
                    todo.append(child)


def _find(parent: dict[int, int], x: int) -> int:
    while parent[x] != x:
        parent[x] = x = parent[parent[x]]
    return x


def _linked(values: list[int], radius: int, free: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Links (as few as join what belongs together) of distinct values; ``free``: (lowest bit, bits) in which they may differ."""
    width = sum(n for _, n in free)
    if len(values) > LARGE_SHARD and width > 8 * (radius + 1):
        bits = [b for low, n in free for b in range(low, low + n)]
        size = -(-len(bits) // (radius + 1))
        for i in range(0, len(bits), size):
            own, rest, shards = bits[i : i + size], bits[:i] + bits[i + size :], {}
            for v in values:
                shards.setdefault(tuple(v >> b & 1 for b in own), []).append(v)
            for shard in shards.values():
                if len(shard) > 1:
                    yield from _linked(shard, radius, [(b, 1) for b in rest])
        return
    tree, parent, groups = BKTree(), {v: v for v in values}, 0
    for v in values:
        groups += 1
        for w in tree.within(v, radius):
            a, b = _find(parent, v), _find(parent, w)
            if a != b:
                parent[a] = b
                groups -= 1
                yield v, w
                if groups == 1:  # nothing is left to be joined
                    break
        tree.add(v)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of sorted batches as arrays that hold whole runs of the first column."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if not len(cols[0]):
            continue
        cut = int(np.searchsorted(cols[0], cols[0][-1]))
        if held and (cut or cols[0][0] != held[-1][0][0]):
            yield [np.concatenate(x) for x in zip(*held, [c[:cut] for c in cols])]
            held = []
        elif cut:
            yield [c[:cut] for c in cols]
        held.append([c[cut:] for c in cols])
    if held:
        yield [np.concatenate(x) for x in zip(*held)]


def link(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``fps`` (fp: distinct bigint) to links (a, b) that join all fingerprints within the radius of one another, directly or not."""
    importable(fps.sparkSession)
    blocks = radius + 1
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    spans = [(cuts[i], cuts[i + 1] - cuts[i]) for i in range(blocks)]
    values = [F.call_function("shiftrightunsigned", F.col("fp"), F.lit(low)).bitwiseAND(F.lit((1 << n) - 1)) for low, n in spans]
    shards = fps.select(F.explode(F.array(*[(v * blocks + i).alias("s") for i, v in enumerate(values)])).alias("shard"), "fp")

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, fp in _runs(batches):
            edges = np.flatnonzero(np.diff(shard)) + 1
            sizes = np.diff(np.concatenate(([0], edges, [len(shard)])))
            starts = np.concatenate(([0], edges))
            out = []
            for at, n in zip(starts[sizes > 1], sizes[sizes > 1]):
                block = int(shard[at]) % blocks
                free = [s for i, s in enumerate(spans) if i != block]
                out += _linked([int(x) & _U64 for x in fp[at : at + n]], radius, free)
            if out:
                pairs = np.array(out, np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    dealt = shards.repartition("shard").sortWithinPartitions("shard", "fp")
    return dealt.mapInArrow(trees, "a bigint, b bigint")


def groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 3, radius: int = RADIUS) -> DataFrame:
    """Per row: doc_id, fingerprint (16 hex digits), component_id (the least id reachable over links within the radius)."""

    def fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t, n) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    importable(docs.sparkSession)
    kind = docs.schema[doc_id].dataType.simpleString()
    known = materialize(docs.select(F.col(doc_id), F.col(text)).mapInArrow(fingerprints, f"doc_id {kind}, fp bigint"), "fingerprints")
    fps = materialize(known.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    labels = materialize(components(link(fps.select("fp"), radius)), "labels")
    named = fps.join(labels, F.col("fp") == F.col("node"), "left").select("fp", "least", "label")
    grouped = materialize(named.filter(F.col("label").isNotNull()), "grouped")
    reach = grouped.groupBy(F.col("label").alias("of")).agg(F.min("least").alias("reached"))
    alone = named.filter(F.col("label").isNull()).select(F.col("fp").alias("of_fp"), F.col("least").alias("component_id"))
    whole = alone.unionByName(grouped.join(reach, F.col("label") == F.col("of")).select(F.col("fp").alias("of_fp"), F.col("reached").alias("component_id")))
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")
    return known.join(whole, F.col("fp") == F.col("of_fp")).select("doc_id", hexed, "component_id")


def _choices(texts: int) -> tuple[int, list[list[int]]]:
    """Bits of a shard's key, and the seeded choices of them that give the recall at the similarity."""
    k = max(16, math.ceil(math.log2(max(texts, 2) / MEAN_SHARD)))
    agree = 1 - math.acos(2 * SIMILARITY / (1 + SIMILARITY)) / math.pi
    agree -= math.sqrt(agree * (1 - agree) / SIGNATURE_BITS)  # of a pair whose bits differ more than they should, by a standard deviation
    beyond = sum(math.comb(WIDE_BITS, i) * (1 - agree) ** i * agree ** (WIDE_BITS - i) for i in range(WIDE_RADIUS + 1, WIDE_BITS + 1))
    count = math.ceil(math.log(1 - RECALL - beyond) / math.log(1 - agree**k))  # a pair is lost by the choices or by the radius
    dice = random.Random(SEED)
    return k, [dice.sample(range(SIGNATURE_BITS), k) for _ in range(count)]


def near_copies(texts: DataFrame, choices: list[list[int]]) -> DataFrame:
    """``texts`` (node: bigint, sig: binary of 32 bytes) to links (a, b) that join all texts that share a shard and lie within the radius."""
    k, places = len(choices[0]), np.array(choices)
    power = (1 << np.arange(k, dtype=np.int64))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                raw = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint8).reshape(-1, SIGNATURE_BITS // 8)
                bits = np.unpackbits(raw, axis=1, bitorder="little").astype(np.int64)
                keys = np.stack([bits[:, p] @ power for p in places], axis=1) * len(places) + np.arange(len(places))
                low, high = np.ascontiguousarray(raw[:, : WIDE_BITS // 8]).view("<i8").T
                node = part.column(0).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1)), *(pa.array(np.repeat(x, len(places))) for x in (low, high, node))], names=["shard", "low", "high", "node"])

    def search(fp: list[int], node: list[int]) -> Iterator[tuple[int, int]]:
        of: dict[int, int] = {}
        for v, x in zip(fp, node):
            if of.setdefault(v, x) != x:
                yield of[v], x
        for v, w in _linked(list(of), WIDE_RADIUS, []):
            yield of[v], of[w]

    def batch(pairs: np.ndarray) -> pa.RecordBatch:
        p = np.unique(np.sort(pairs, axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(p[:, 0]), pa.array(p[:, 1])], names=["a", "b"])

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, low, high, node in _runs(batches):
            edges = np.flatnonzero(np.diff(shard)) + 1
            starts = np.concatenate(([0], edges))
            sizes = np.diff(np.concatenate((starts, [len(shard)])))
            two = starts[sizes == 2]  # a root and one child
            differ = sum(np.bitwise_count(w[two] ^ w[two + 1]) for w in (low.view(np.uint64), high.view(np.uint64)))
            close = two[differ <= WIDE_RADIUS]
            if len(close):
                yield batch(np.stack([node[close], node[close + 1]], axis=1))
            many = zip(starts[sizes > 2], sizes[sizes > 2])
            found = chain.from_iterable(search([h << 64 | v for v, h in zip(low[at : at + n].view(np.uint64).tolist(), high[at : at + n].view(np.uint64).tolist())], node[at : at + n].tolist()) for at, n in many)
            while part := list(islice(found, 200_000)):
                yield batch(np.array(part, np.int64))

    shards = texts.select("node", "sig").mapInArrow(deal, "shard bigint, low bigint, high bigint, node bigint")
    return shards.repartition("shard").sortWithinPartitions("shard", "node").mapInArrow(trees, "a bigint, b bigint").distinct()


def similar(sets: list[np.ndarray], sides: list[int] | None = None, similarity: float = SIMILARITY) -> Iterator[tuple[int, int]]:
    """Links between places of ``sets`` (sorted, distinct) that join all with the Jaccard similarity or more, directly or not.

    Of two sets that are alike, each has one of the shingles that they share among its rarest, of which it may lack all but
    one; so rare shingles of earlier sets are looked up, group by group, and a set that is joined to a group passes it by. With
    ``sides``, only links between different sides are looked for.
    """
    sizes = np.array([len(x) for x in sets])
    _, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    ends = np.cumsum(sizes)
    known: dict[int, dict[int, list[int]]] = {}
    parent = {i: i for i in range(len(sets))}
    for i in np.argsort(sizes, kind="stable").tolist():
        n = len(sets[i])
        tokens = inverse[ends[i] - n : ends[i]]
        often = counts[tokens]
        rare = tokens[np.lexsort((tokens, often))][: n - math.ceil(similarity * n - 1e-9) + 1]
        rare = rare[counts[rare] > 1].tolist()
        checked: set[int] = set()
        for t in rare:
            held = known.get(t)
            for root in list(held or ()):
                now = _find(parent, root)
                if now != root:  # its group has been joined to another since
                    held.setdefault(now, []).extend(held.pop(root))
            for root, members in list((held or {}).items()):
                for j in members:
                    if _find(parent, i) == _find(parent, root):
                        break
                    if j in checked or sides and sides[i] == sides[j]:
                        continue
                    checked.add(j)
                    least = math.ceil(similarity * (n + len(sets[j])) / (1 + similarity) - 1e-6)
                    if len(sets[j]) >= least and len(np.intersect1d(sets[i], sets[j], assume_unique=True)) >= least:
                        parent[_find(parent, root)] = _find(parent, i)
                        yield j, i
        for t in rare:
            known.setdefault(t, {}).setdefault(_find(parent, i), []).append(i)


def alike(links: DataFrame, sets: DataFrame, block: int = BLOCK) -> DataFrame:
    """Of what ``links`` (a, b: bigint) join, the links between ``sets`` (row: bigint, shingles: sorted array<bigint>) of the similarity.

    What is joined is dealt to blocks of ``block`` shingles on average; a cell is a block or two, and searched by one task. So a
    set moves once, and where its group has more blocks, once for each of them.
    """
    labels = components(links).select(F.col("node").alias("of"), "label")
    sized = materialize(sets.select("row", F.size("shingles").alias("n")).join(labels, F.col("row") == F.col("of")).select("row", "n", "label"), "sized")
    totals = sized.groupBy(F.col("label").alias("of")).agg(F.ceil(F.sum("n") / block).alias("blocks"))
    placed = sized.join(totals, F.col("label") == F.col("of")).select(F.col("row").alias("own"), "label", "blocks", F.pmod(F.xxhash64("row"), "blocks").cast("int").alias("side"))
    cells = placed.select("own", "label", "side", F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1)).alias("other"))
    cells = materialize(cells.select("own", "side", F.xxhash64("label", F.least("side", "other"), F.greatest("side", "other")).alias("cell"), (F.col("side") == F.col("other")).alias("alone")), "cells")
    # In the cell of a block with itself all links are looked for; in that of two blocks, those between them.
    dealt = sets.join(hint_if_small(cells, 500_000), F.col("row") == F.col("own")).select("cell", "row", F.when(F.col("alone"), F.lit(None)).otherwise(F.col("side")).alias("side"), "shingles")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, sides, sets_ = None, [], [], []

        def found() -> pa.RecordBatch:
            pairs = np.array([(rows[i], rows[j]) for i, j in similar(sets_, None if sides[0] is None else sides)] if len(rows) > 1 else [], np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

        for batch in batches:
            values = batch.column(3).to_numpy(zero_copy_only=False)
            for c, r, side, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), values):
                if c != now and rows:
                    yield found()
                    rows, sides, sets_ = [], [], []
                now = c
                rows.append(r)
                sides.append(side)
                sets_.append(np.array(x, np.int64))
        if rows:
            yield found()

    return dealt.repartition("cell").sortWithinPartitions("cell", "row").mapInArrow(search, "a bigint, b bigint").distinct()


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, with their columns, of which no other stays in the same group of near copies.

    Two texts are linked if they are equal or share 0.8 of their runs of five words (Jaccard, of sets); a group is what
    links join. The row with the least id stays.
    """
    importable(docs.sparkSession)
    row, need, drop = fresh(docs, "_row", "_need", "_drop")
    numbered = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    kind = docs.schema[doc_id].dataType.simpleString()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            copy, sig = [], []
            for t in batch.column(2).to_pylist():
                h = shingle_hashes(t, SHINGLE)
                copy.append(xxhash.xxh3_128_digest((t or "").encode("utf-8", "surrogatepass")) if len(h) else b"")
                sig.append(signature(np.unique(h)).tobytes() if len(h) else bytes(SIGNATURE_BITS // 8))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(copy, pa.binary()), pa.array(sig, pa.binary())], names=["row", "doc_id", "copy", "sig"])

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [np.unique(shingle_hashes(t, SHINGLE)).view(np.int64) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["row", "shingles"])

    signed = materialize(numbered.select(F.col(row), F.col(doc_id), F.col(text)).mapInArrow(sign, f"row bigint, doc_id {kind}, copy binary, sig binary"), "signatures")
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("row"))
    texts = materialize(signed.groupBy("copy").agg(F.min(order).alias("least"), F.min("sig").alias("sig")).select("copy", "least", F.col("least.row").alias("node"), "sig"), "texts")
    _, choices = _choices(texts.count())

    links = materialize(near_copies(texts.filter(F.length("copy") > 0).select("node", "sig"), choices), "candidates")
    needed = materialize(links.select(F.col("a").alias(need)).union(links.select(F.col("b"))).distinct(), "needed")
    sets = numbered.join(hint_if_small(needed, 500_000), F.col(row) == F.col(need), "left_semi").select(F.col(row), F.col(text)).mapInArrow(shingles, "row bigint, shingles array<bigint>")
    links = materialize(alike(links, materialize(sets, "shingles")), "alike")
    labels = materialize(components(links), "labels")
    named = texts.withColumnRenamed("node", "own").join(labels, F.col("own") == F.col("node"), "left").select("least", F.coalesce("label", "own").alias("label"))
    stay = named.groupBy("label").agg(F.min("least").alias("stays")).select(F.col("stays.row").alias("stay"))
    gone = materialize(signed.select(F.col("row").alias(drop)).join(stay, F.col(drop) == F.col("stay"), "left_anti"), "gone")
    return numbered.join(hint_if_small(gone, 500_000), F.col(row) == F.col(drop), "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
