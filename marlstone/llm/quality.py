"""Quality rules: outlier fences from mergeable quantile sketches per language and source.

The sketch is a log-linear histogram of integers: exact below 64, then 32 buckets for each power of two, so a quantile
is off by at most 1/32. Sketches are merged by adding counts; the result does not depend on order or partitioning.
A group's quartiles are drawn towards those of its language, as if PRIOR documents of it counted along, and a language's towards
those of the corpus; the sketches of both are sums of the groups'. So a group of a few documents follows its language, one of many
goes by itself, and none changes verdicts at some size. A document fails the method if a metric lies beyond its group's fence

    q75 + REACH * max(q75 - q25, FLOOR[metric])

of which FLOOR is the least spread that counts as spread. That of repeats is wide: of labelled documents that the base rule lets
pass, those with 20 to 30 % of repeated words are good ten times out of eleven, so only groups that repeat a lot get a fence of
their own there, and none below the base rule's. Everything runs as DataFrame operations.

Nulls: a null text has no words (and fails the base rule); null languages and sources are groups of their own. Repeated
rows are judged one by one, alike; ties at a fence pass. Texts are read whole, however long. An empty table gives an empty result. Extra columns are ignored by ``judge`` and kept
by ``keep_good``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import fresh, hint_if_small, let, materialize, shingle_hashes, words

#: Metric -> least spread (FLOOR). All are integers in thousandths, but for tenths of characters in word_length.
FLOOR = {"symbols": 10, "repeats": 75, "shouting": 40, "word_length": 6}
REACH = 4
#: Documents of its language that count along with a group's own, and of the corpus with a language's.
PRIOR = 200
WINDOW = 8
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _covered(hashes: Column, width: int) -> Column:
    """Words in windows whose hash occurs twice or more, the first included.

    Of a text with repeats, hash prefixes are packed with positions, sorted as plain integers, and neighbours compared in
    full; texts of 2^24 words or more sort pairs instead.
    """
    low = (1 << 24) - 1

    def at(sorted_: Column, i: Column) -> Column:
        return F.get(hashes, F.get(sorted_, i).bitwiseAND(F.lit(low)).cast("int"))

    def starts(sorted_: Column) -> Column:
        def twin(x: Column, i: Column) -> Column:
            return let(at(sorted_, i), lambda h: F.coalesce((h == at(sorted_, i + 1)), F.lit(False)) | F.coalesce((h == at(sorted_, i - 1)), F.lit(False))
                       | F.coalesce((h == at(sorted_, i + 2)), F.lit(False)) | F.coalesce((h == at(sorted_, i - 2)), F.lit(False)))

        return F.sort_array(F.transform(F.filter(sorted_, twin), lambda x: x.bitwiseAND(F.lit(low)).cast("int")))

    def starts_of_pairs(sorted_: Column) -> Column:
        same = lambda x, i: F.coalesce(x["h"] == F.get(sorted_, i)["h"], F.lit(False))
        return F.sort_array(F.transform(F.filter(sorted_, lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x["i"]))

    def union(begins: Column) -> Column:
        steps = F.transform(begins, lambda p, k: F.least(F.lit(width), F.coalesce(F.get(begins, k + 1) - p, F.lit(width))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    packed = F.sort_array(F.transform(hashes, lambda h, i: h.bitwiseAND(F.lit(~low)).bitwiseOR(i.cast("long"))))
    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return (F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0))
            .when(F.size(hashes) <= low, let(let(packed, starts), union)).otherwise(let(let(pairs, starts_of_pairs), union)))


def metrics(df: DataFrame, text: str, keep: list[Column], names: list[str]) -> DataFrame:
    """``keep`` and, under ``names``, the base counts of BASE, ``base_failed`` and the metrics of FLOOR, of each row's whole text."""
    kept = [f"k{i}" for i in range(len(keep))]
    counts = let(words(F.col(text)), lambda w: let(shingle_hashes(w, WINDOW), lambda h: F.struct(
        F.size(w).cast("long").alias("n"), F.length(F.array_join(w, "")).cast("long").alias("chars"), _covered(h, WINDOW).cast("long").alias("rep"))))
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    a = df.select(
        *[c.alias(k) for c, k in zip(keep, kept)], counts.alias("c"), F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long").alias("sym"),
        F.regexp_count(t, F.lit(r"\p{Lu}")).cast("long").alias("up"), let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"),
    )
    c = a.select(*kept, "c.*", "sym", "up", "dup")
    share = lambda x, of, by=1000: F.expr(f"{by} * {x} div greatest({of}, 1)")
    out = [F.col("n"), F.col("chars"), F.col("sym"), F.col("dup"), F.col("rep"), (F.col("n") < 20) | (100 * F.col("rep") > 30 * F.col("n")),
           share("sym", "chars"), share("rep", "n"), share("up", "chars"), share("chars", "n", 10)]
    return c.select(*kept, *[x.alias(name) for x, name in zip(out, names)])


def bucket(v: Column) -> Column:
    """The sketch's bucket of a non-negative integer."""
    e = F.greatest(F.length(F.bin(v)) - 6, F.lit(0))
    return (e * 32).cast("long") + let(F.struct(v.alias("v"), e.alias("e")), lambda x: F.call_function("shiftright", x["v"], x["e"]))


def floor_of(b: Column) -> Column:
    """The least value of a bucket."""
    e = F.greatest(F.floor(b / 32) - 1, F.lit(0)).cast("int")
    return F.call_function("shiftleft", (b - e * 32).cast("long"), e)


def sketches(measured: DataFrame, lang: str, source: str, cols: dict[str, str]) -> DataFrame:
    """One row for each language, source, metric and bucket: how many documents it holds. Sketches merge by adding up."""
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), bucket(F.col(c)).alias("bucket")) for m, c in cols.items()])
    long = measured.select(F.col(lang).alias("lang"), F.col(source).alias("source"), F.explode(pairs).alias("x"))
    return long.groupBy("lang", "source", F.col("x.metric").alias("metric"), F.col("x.bucket").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def _quartiles(s: DataFrame, by: list[str]) -> DataFrame:
    rising = Window.partitionBy(*by).orderBy("bucket")
    run = s.groupBy(*by, "bucket").agg(F.sum("n").alias("n")).select(*by, "bucket", F.sum("n").over(rising).alias("cum"), F.sum("n").over(Window.partitionBy(*by)).alias("total"))
    at = lambda p: floor_of(F.min(F.when(F.col("cum") * 100 >= F.col("total") * p, F.col("bucket"))))
    return run.groupBy(*by).agg(F.first("total").alias("total"), at(25).alias("q25"), at(75).alias("q75"))


def fences(s: DataFrame, reach: int = REACH, prior: int = PRIOR) -> DataFrame:
    """For each language and source, the highest value that each metric may have: columns lang, source, fence_<metric>."""
    by_floor = F.create_map(*[F.lit(x) for kv in FLOOR.items() for x in kv])
    own = _quartiles(s, ["lang", "source", "metric"])
    tongue = _quartiles(s, ["lang", "metric"]).select(F.col("lang").alias("l_lang"), F.col("metric").alias("l_metric"), F.col("total").alias("l_total"), F.col("q25").alias("l25"), F.col("q75").alias("l75"))
    every = _quartiles(s, ["metric"]).select(F.col("metric").alias("a_metric"), F.col("q25").alias("a25"), F.col("q75").alias("a75"))
    joined = own.join(tongue, (F.col("metric") == F.col("l_metric")) & F.col("lang").eqNullSafe(F.col("l_lang")), "left").join(every, F.col("metric") == F.col("a_metric"), "left")
    for q in (25, 75):
        joined = joined.withColumn(f"t{q}", F.expr(f"(l_total * l{q} + {prior} * a{q}) div (l_total + {prior})")).withColumn(f"p{q}", F.expr(f"(total * q{q} + {prior} * t{q}) div (total + {prior})"))
    fence = F.col("p75") + reach * F.greatest(F.col("p75") - F.col("p25"), F.element_at(by_floor, F.col("metric")))
    return joined.groupBy("lang", "source").agg(*[F.max(F.when(F.col("metric") == m, fence)).alias(f"fence_{m}") for m in FLOOR])


def _judged(measured: DataFrame, lang: str, source: str, failed: str, cols: dict[str, str], out: str) -> DataFrame:
    """``measured`` with the verdict ``out``. The fences are broadcast if they are counted and few, else joined by shuffle."""
    limits = materialize(fences(sketches(measured, lang, source, cols)), "fences")
    named = dict(zip(limits.columns, fresh(measured, *[f"_limit_{c}" for c in limits.columns])))
    limits = limits.withColumnsRenamed(named)
    ok = ~F.col(failed)
    for m, c in cols.items():
        ok &= F.col(c) <= F.col(named[f"fence_{m}"])
    same = F.col(f"`{lang}`").eqNullSafe(F.col(named["lang"])) & F.col(f"`{source}`").eqNullSafe(F.col(named["source"]))
    return measured.join(hint_if_small(limits, 50_000), same, "left").withColumn(out, ok).drop(*limits.columns)


def judge(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """Per row: doc_id, the counts of BASE, base_failed, kept, and the metrics that were compared."""
    names = [*BASE, "base_failed", *FLOOR]
    m = metrics(docs, text, [F.col(doc_id), F.col(lang), F.col(source)], names)
    m = materialize(m.withColumnsRenamed({"k0": "doc_id", "k1": "lang", "k2": "source"}), "quality")
    out = _judged(m, "lang", "source", "base_failed", {c: c for c in FLOOR}, "kept")
    return out.select("doc_id", *BASE, "base_failed", "kept", *FLOOR)


def keep_good(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The rows of ``docs`` that pass, with the columns they came with."""
    cols = docs.columns
    names = fresh(docs, *[f"q_{x}" for x in (*BASE, "base_failed", *FLOOR)], "q_kept")
    m = metrics(docs, text, [F.col(f"`{c}`") for c in cols], names[:-1]).withColumnsRenamed({f"k{i}": c for i, c in enumerate(cols)})
    m = materialize(m, "quality")
    out = _judged(m, lang, source, names[5], dict(zip(FLOOR, names[6:-1])), names[-1])
    return out.filter(F.col(names[-1])).select(*[F.col(f"`{c}`") for c in cols])
