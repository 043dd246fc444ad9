"""Mixing sources to target weights: min-cost flow over membership patterns, then seeded documents.

The pattern of a text is the set of sources that hold it. Documents are aggregated by pattern and source; a min-cost flow
routes the words of patterns to the sources' quotas, with costs that grow with every repetition of a text, whichever
source takes it. So a source first takes what only it has, and shared or repeated texts last. Each pattern and source then
takes its share in the order of a seeded hash: whole documents, none more than twice its size. What whole documents leave of
a quota is made up for by a few that are used once more or less.

The flow runs on the driver over patterns, not documents: a row for each pattern that occurs and each of its members, and for
each source. More than MOST_CELLS of them are an error, never cut. Sums and places are computed by DataFrame operations, and
no task gathers a source.

Nulls: a null source is a source, the last; a null text has no words and takes none. Repeated rows each have their size.
Equal documents are interchangeable; ties in the seeded order go by id and size. Whole texts are measured, however long.
Sources without words have target 0. An empty table gives an empty result. Extra columns are ignored by ``mix`` and kept
by ``mixed_documents``.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import flow
from .shared import fresh, hint_if_small, importable, materialize, running_totals

#: Weights of the sources in order, repeating.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
PASSES = 2
SEED = 2024
#: Sources, and pairs of a pattern and a member, that the driver's flow takes.
MOST_CELLS = 2_000_000
#: Rounds in which what whole documents leave of quotas, or take beyond them, is made up for.
ROUNDS = 2
MOST_EXACT = 24


def targets(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = PASSES) -> list[float]:
    """Words for each source: shares by weight, none above ``most`` times its size, the excess shared again."""
    want = [weights[i % len(weights)] for i in range(len(sizes))]
    out, open_, rest = [0.0] * len(sizes), list(range(len(sizes))), share * sum(sizes)
    while open_:
        by = rest / sum(want[i] for i in open_)
        full = [i for i in open_ if want[i] * by > most * sizes[i]]
        if not full:
            for i in open_:
                out[i] = want[i] * by
            break
        for i in full:
            out[i] = float(most * sizes[i])
            rest -= out[i]
        open_ = [i for i in open_ if i not in set(full)]
    return out


def _measured(docs: DataFrame, key: str, doc_id: str, text: str, source: str, seed: int) -> DataFrame:
    """key, source, size, copy (128-bit hash of the text), turn (seeded hash of id and text)."""
    importable(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, copy, turn = [], [], []
            for k, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                raw = (t or "").encode("utf-8", "surrogatepass")
                size.append(len(raw.split()))
                copy.append(xxhash.xxh3_128_digest(raw))
                turn.append(xxhash.xxh64_intdigest(f"{k}".encode() + b"\0" + copy[-1], seed) - (1 << 63))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(size, pa.int64()), pa.array(copy, pa.binary()), pa.array(turn, pa.int64())], names=["key", "source", "size", "copy", "turn"])

    return docs.select(F.col(key).alias("key"), F.col(source).cast("string").alias("source"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(measure, f"key {kind}, source string, size bigint, copy binary, turn bigint")


def _rows(df: DataFrame) -> list:
    """The rows of an aggregate by source, or by pattern and source."""
    rows = df.take(MOST_CELLS + 1)
    if len(rows) > MOST_CELLS:
        raise ValueError(f"more than {MOST_CELLS} sources, or members of patterns of sources: the flow does not fit the driver")
    return rows


def _taken(measured: DataFrame) -> DataFrame:
    """``measured`` with source_size, target, taken."""
    spark = measured.sparkSession
    sums = {r[0]: r[1] for r in _rows(measured.groupBy("source").agg(F.sum("size")))}
    order = sorted(sums, key=lambda s: (s is None, s or ""))
    target = dict(zip(order, targets([sums[s] for s in order])))
    table = spark.createDataFrame([(i, s, sums[s], float(target[s])) for i, s in enumerate(order)], "sid int, of string, source_size bigint, target double")
    named = materialize(measured.join(hint_if_small(table, 200_000), F.col("source").eqNullSafe(F.col("of")), "left").drop("of"), "sourced")

    held = named.filter("size > 0").groupBy("copy", "sid").agg(F.max("size").alias("unit"))
    shared = held.groupBy("copy").agg(F.sort_array(F.collect_set("sid")).alias("members")).filter(F.size("members") > 1)
    shared = materialize(shared.select(F.col("copy").alias("of_copy"), F.array_join("members", ",").alias("pattern")), "shared")
    sorted_ = named.join(hint_if_small(shared, 200_000), F.col("copy") == F.col("of_copy"), "left").withColumn("pattern", F.coalesce("pattern", F.col("sid").cast("string"))).drop("of_copy")
    sorted_ = materialize(sorted_, "patterns")

    texts = sorted_.groupBy("pattern", "copy").agg(F.max("size").alias("unit")).groupBy("pattern").agg(F.sum("unit").alias("unit"))
    units = {r[0]: r[1] for r in _rows(texts)}
    has: dict[str, dict[int, int]] = {}
    for r in _rows(sorted_.groupBy("pattern", "sid").agg(F.sum("size").alias("words"))):
        has.setdefault(r["pattern"], {})[r["sid"]] = r["words"]
    quotas = {i: round(target[s]) for i, s in enumerate(order)}
    names = sorted(p for p in has if units[p])
    routed = flow.route([(units[p], {i: w for i, w in has[p].items() if w}) for p in names], quotas, PASSES)
    goal = {(p, i): f for p, of in zip(names, routed) for i, f in of.items()}

    cells = [(n, p, i, goal.get((p, i), 0) // max(has[p][i], 1), goal.get((p, i), 0) % max(has[p][i], 1)) for n, (p, i) in enumerate(sorted((p, i) for p in has for i in has[p]))]
    classes = spark.createDataFrame(cells, "class int, c_pattern string, c_sid int, times bigint, rest bigint")
    of_class = (F.col("pattern") == F.col("c_pattern")) & (F.col("sid") == F.col("c_sid"))
    ranked = running_totals(
        sorted_.join(hint_if_small(classes, 200_000), of_class).drop("c_pattern", "c_sid", "copy", "pattern"),
        ["class"], ["turn", "key", "size"], F.col("size"), "mix", ("place", "before"))
    whole = F.col("times") + (F.col("before") + F.col("size") <= F.col("rest")).cast("bigint")
    placed = materialize(ranked.withColumn("uses", F.when(F.col("size") > 0, whole).otherwise(F.lit(0))).drop("times", "rest", "before"), "placed")

    # Whole documents leave a little of each quota: a few documents of each size come or go to make up for it.
    got = {r[0]: r[1] for r in _rows(placed.groupBy("sid").agg(F.sum(F.col("size") * F.col("uses"))))}
    left = {i: q - got.get(i, 0) for i, q in quotas.items()}
    moved: dict[tuple[int, int], int] = {}
    for _ in range(ROUNDS):
        short = spark.createDataFrame([(i,) for i, n in left.items() if n], "s_sid int")
        used = spark.createDataFrame([(*k,) for k in moved], "u_class int, u_place bigint")
        fits = placed.filter("size > 0").join(hint_if_small(used, 200_000), (F.col("class") == F.col("u_class")) & (F.col("place") == F.col("u_place")), "left_anti")
        one = F.struct("size", "class", "place", "uses")
        some = fits.join(hint_if_small(short, 200_000), F.col("sid") == F.col("s_sid")).groupBy("sid", "uses", F.floor(F.log2("size")).alias("bits")).agg(
            F.array_distinct(F.array(F.max(one), F.min(one), F.max_by(one, F.struct("turn", "class", "place")), F.min_by(one, F.struct("turn", "class", "place")))).alias("docs"))
        by_source: dict[int, dict[tuple[int, int], tuple[int, int]]] = {}
        for r in _rows(some):
            by_source.setdefault(r["sid"], {}).update({(x["class"], x["place"]): (x["size"], x["uses"]) for x in r["docs"]})
        for i, docs_ in sorted(by_source.items()):
            steps = settle(left[i], docs_)
            moved |= steps
            left[i] -= sum(n * docs_[k][0] for k, n in steps.items())
    changed = spark.createDataFrame([(*k, n) for k, n in moved.items()], "a_class int, a_place bigint, more int")
    out = placed.join(hint_if_small(changed, 200_000), (F.col("class") == F.col("a_class")) & (F.col("place") == F.col("a_place")), "left")
    return out.select("key", "size", "source_size", "target", (F.col("size") * (F.col("uses") + F.coalesce("more", F.lit(0)))).alias("taken"))


def settle(left: int, docs: dict[tuple[int, int], tuple[int, int]], most: int = PASSES) -> dict[tuple[int, int], int]:
    """Which documents (size, uses so far) to use once more (1) or once less (-1) to come closest to ``left`` words more, step by step.

    A step is one use more, one less, or both at once; it is the one that leaves least, and the first of equals. Of a few
    documents (MOST_EXACT) all sums are tried, so what is left is the least there is.
    """
    if len(docs) <= MOST_EXACT:
        return _closest(left, sorted(docs.items()), most)
    steps: dict[tuple[int, int], int] = {}
    while left:
        free = sorted((size, k) for k, (size, uses) in docs.items() if k not in steps)
        ups = [(size, k) for size, k in free if docs[k][1] < most]
        sizes = [size for size, _ in ups]
        best = (abs(left), ())
        for gone, k in [(0, None), *((size, k) for size, k in free if docs[k][1] > 0)]:
            if k is not None:
                best = min(best, (abs(left + gone), ((k, -1),)), key=lambda x: x[0])
            at = bisect.bisect_left(sizes, left + gone)
            for size, up in ups[max(at - 2, 0) : at + 2]:
                if up != k:
                    best = min(best, (abs(left + gone - size), ((up, 1),) if k is None else ((up, 1), (k, -1))), key=lambda x: x[0])
        if not best[1]:
            break
        steps |= dict(best[1])
        left -= sum(n * docs[k][0] for k, n in best[1])
    return steps


def _closest(left: int, docs: list[tuple[tuple[int, int], tuple[int, int]]], most: int) -> dict[tuple[int, int], int]:
    """All sums of one use more, one less or none of each document, as bits of an integer that stands for sums from ``low`` on."""
    low = -sum(size for _, (size, uses) in docs if uses)
    sums = [1 << -low]
    for _, (size, uses) in docs:
        now = sums[-1]
        sums.append(now | (now << size if uses < most else 0) | (now >> size if uses else 0))
    last = sums[-1]
    above = last >> max(left - low, 0)
    below = last & ((1 << max(left - low + 1, 0)) - 1)
    found = ([max(left - low, 0) + (above & -above).bit_length() - 1] if above else []) + ([below.bit_length() - 1] if below else [])
    at, steps = min(found, key=lambda x: abs(x + low - left)), {}
    for (key, (size, uses)), before in zip(reversed(docs), reversed(sums[:-1])):
        for n in (0, 1, -1):
            if (n != 1 or uses < most) and (n != -1 or uses) and 0 <= at - n * size and before >> (at - n * size) & 1:
                at -= n * size
                if n:
                    steps[key] = n
                break
    return steps


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = SEED) -> DataFrame:
    """Per row: doc_id, size, source_size, target (its source's), taken."""
    return _taken(materialize(_measured(docs, doc_id, doc_id, text, source, seed), "measured")).withColumnRenamed("key", "doc_id")


def mixed_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = SEED) -> DataFrame:
    """The rows of ``docs`` with their columns, each as often as the mix takes it (0 to PASSES times)."""
    row, times, each = fresh(docs, "_row", "_times", "_each")
    numbered = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    taken = _taken(materialize(_measured(numbered, row, doc_id, text, source, seed), "measured")).filter("taken > 0")
    copies = taken.select(F.col("key").alias(each), F.expr("taken div size").cast("int").alias(times))
    cols = [F.col(f"`{c}`") for c in docs.columns]
    copies = hint_if_small(materialize(copies, "copies"), 500_000)
    return numbered.join(copies, F.col(row) == F.col(each)).select(*cols, F.explode(F.array_repeat(F.lit(0), F.col(times))).alias(each)).select(*cols)
