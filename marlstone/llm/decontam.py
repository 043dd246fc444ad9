"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

An item is short and a document may be long, so their Jaccard similarity is near zero even where the document holds the
whole item, and sketches of both sides would need thousands of permutations. Containment MinHash sketches the short side only
and looks its min-hashes up among all shingles of the long one: each is there with a probability of the containment.

Items are partitioned by size. A partition's sketch is the k least values under one random hash (a draw without repetition),
k being what its largest item may lack, plus one. A document is a candidate if it has at least k less what the item itself
may lack of them, so no document that reaches the threshold is missed. Candidates are verified by all their shingles.

One pass over the documents keeps the shingles that pass a bit array of all items' shingles; whatever follows are joins of
rows (document, shingle), of which items' rows are broadcast within MOST_BYTES. A benchmark too large for the bit array goes
without it.

Shingles are runs of five lower-cased words; an item of fewer words is one run of its own length, looked up among the runs
of that length. DataFrame operations only.

Nulls: null texts have no shingles; an item without words fits nothing; null ids are kept. Repeated documents and items
are reported each. Whole texts are read, however long. Empty tables give empty results. Extra columns are ignored by
``search`` and kept by ``clean``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import fresh, hint_if_light, hint_if_small, let, materialize, shingle_hashes, words

SHINGLE = 5
THRESHOLD = 0.8
#: Of the bit array, and of items' rows that are broadcast.
MOST_BYTES = 32 << 20
#: Bits of the array for each shingle: as many as the bytes allow, within these.
BITS = (8, 64)


def _tokens(text: Column) -> Column:
    return words(F.lower(text))


def _shingles(tokens: Column, width: int, n: int) -> Column:
    h = shingle_hashes(tokens, width)
    return h if width == n else F.transform(h, lambda x: F.xxhash64(x, F.lit(width)))


def _lacking(n: Column, threshold: float) -> Column:
    """How many of n shingles a document may lack."""
    return n - F.ceil(F.lit(threshold) * n - 1e-9).cast("int")


def item_table(items: DataFrame, item_id: str = "item_id", text: str = "text", n: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """Items with words: item_id, width (words of a shingle), shingles (distinct, by hash), n_item, k (size of the sketch), need (of its min-hashes)."""
    a = items.select(F.col(item_id).alias("item_id"), _tokens(F.col(text)).alias("w")).filter(F.size("w") > 0)
    of = {k: F.array_distinct(_shingles(F.col("w"), k, n)) for k in range(1, n + 1)}
    by_width = F.when(F.size("w") >= n, of[n])
    for k in range(1, n):
        by_width = by_width.when(F.size("w") == k, of[k])
    b = a.select("item_id", F.least(F.size("w"), F.lit(n)).alias("width"), F.sort_array(by_width).alias("shingles")).withColumn("n_item", F.size("shingles"))
    largest = F.pow(F.lit(2), F.ceil(F.log2("n_item"))).cast("int")  # of the item's partition
    sketch = F.least(_lacking(largest, threshold) + 1, F.col("n_item"))
    return b.withColumn("k", sketch).withColumn("need", F.greatest(F.col("k") - _lacking(F.col("n_item"), threshold), F.lit(1)))


def _bit_test(hashes: DataFrame, count: int, most_bytes: int) -> tuple[Column, Callable[[Column, Column], Column]] | None:
    """For distinct hashes (column h): the words of a bit array, as a column to select, and a test of a hash against them."""
    each = min(BITS[1], 8 * most_bytes // max(count, 1))
    if each < BITS[0]:
        return None
    size = 64 * max(1, -(-count * each // 64))
    places = lambda h: [F.pmod(h if not i else F.xxhash64(h, F.lit(i)), F.lit(size)) for i in range(3)]
    at = hashes.select(F.explode(F.array(*places(F.col("h")))).alias("at"))
    set_ = at.groupBy(F.expr("at div 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits"))
    dense = hashes.sparkSession.range(size // 64).join(set_, F.col("id") == F.col("word"), "left")
    rows = dense.agg(F.sort_array(F.collect_list(F.struct("id", F.coalesce("bits", F.lit(0)).alias("bits")))).alias("all"))
    table = materialize(rows.select(F.transform("all", lambda x: x["bits"]).alias("bits")), "item-bits")

    def test(bits: Column, h: Column) -> Column:
        out = None
        for place in places(h):
            word = F.get(bits, F.call_function("shiftrightunsigned", place, F.lit(6)).cast("int"))
            on = F.call_function("shiftrightunsigned", word, place.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1
            out = on if out is None else out & on
        return out

    return table.scalar(), test


def search(docs: DataFrame, items: DataFrame, keys: dict[str, Column], text: str = "text", item_id: str = "item_id", item_text: str = "text",
           n: int = SHINGLE, threshold: float = THRESHOLD, most_bytes: int = MOST_BYTES) -> DataFrame:
    """A row for each document and item with containment at or over the threshold: ``keys``, item_id, n_shared, n_item, containment."""
    known = materialize(item_table(items, item_id, item_text, n, threshold).withColumn("item", F.monotonically_increasing_id()), "items")
    widths = sorted(r[0] for r in known.select("width").distinct().collect()) or [n]  # 1 to n
    each = materialize(known.select("item", "n_item", "k", "need", F.posexplode("shingles").alias("rank", "h")), "item-shingles")
    distinct = each.select("h").distinct()
    bits = _bit_test(distinct, distinct.count(), most_bytes)

    array = docs.select(F.struct(*[c.alias(k) for k, c in keys.items()]).alias("key"), _tokens(F.col(text)).alias("w"), (bits[0] if bits else F.lit(None)).alias("bits"))
    every = let(F.col("w"), lambda w: F.array_distinct(F.concat(*[_shingles(w, width, n) for width in widths])))
    # The row's number keeps Spark from making the shingles twice, in the filter and in what is selected.
    passed = array.select("key", F.monotonically_increasing_id().alias("row"), (F.filter(every, lambda h: bits[1](F.col("bits"), h)) if bits else every).alias("hits"))
    kept = materialize(passed.filter(F.size("hits") > 0), "hits")

    hits = kept.select("row", F.explode("hits").alias("hit"))
    sketch = each.filter(F.col("rank") < F.col("k")).select("item", "need", "h")
    found = hits.join(hint_if_light(sketch, F.lit(24), most_bytes), F.col("hit") == F.col("h")).groupBy("row", "item").agg(F.count(F.lit(1)).alias("n"), F.first("need").alias("need"))
    candidates = materialize(found.filter(F.col("n") >= F.col("need")).select(F.col("row").alias("c_row"), F.col("item").alias("c_item")), "candidates")

    own = hits.join(candidates, F.col("row") == F.col("c_row")).select("row", "c_item", "hit")
    whole = hint_if_light(each.select("item", "h", "n_item"), F.lit(24), most_bytes)
    both = own.join(whole, (F.col("c_item") == F.col("item")) & (F.col("hit") == F.col("h"))).groupBy("row", "item").agg(F.count(F.lit(1)).alias("n_shared"), F.first("n_item").cast("long").alias("n_item"))
    good = both.filter(F.col("n_shared") >= F.ceil(F.lit(threshold) * F.col("n_item") - 1e-9)).select(F.col("row").alias("g_row"), F.col("item").alias("g_item"), "n_shared", "n_item")
    named = good.join(known.select(F.col("item").alias("i_item"), F.col("item_id").alias("named")), F.col("g_item") == F.col("i_item"))
    return kept.select("row", "key").join(named, F.col("row") == F.col("g_row")).select("key.*", F.col("named").alias("item_id"), "n_shared", "n_item", (F.col("n_shared") / F.col("n_item")).alias("containment"))


def leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, item_id, n_shared, n_item, containment."""
    return search(docs, items, {"doc_id": F.col(doc_id)}, text, item_id, item_text)


def clean(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no item, with the columns they came with."""
    d, h, bad_id, bad_hash = fresh(docs, "_id", "_text_hash", "_bad_id", "_bad_hash")
    bad = materialize(search(docs, items, {d: F.col(doc_id), h: F.xxhash64(F.col(text))}, text, item_id, item_text).select(F.col(d).alias(bad_id), F.col(h).alias(bad_hash)).distinct(), "leaks")
    same = F.col(doc_id).eqNullSafe(F.col(bad_id)) & (F.xxhash64(F.col(text)) == F.col(bad_hash))
    return docs.join(hint_if_small(bad, 200_000), same, "left_anti")
