"""The pipeline's rows against plain Python, stage by stage."""

import math
import re
from collections import Counter

import duckdb

import corpus_pipeline
from marlstone.llm import mixing, queries, sharding, simhash

SF = "/root/testdata/sf0.001"


def test_pipeline(spark):
    """Quality rules by their SQL, near copies and leaks by all pairs, the mix by its contract, shards by their counts and slots."""
    rows = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    kept = {d for d, ok in con.execute(f"SELECT doc_id, kept FROM ({queries.ORACLE_SQL['op2_quality_rules']})").fetchall() if ok}

    sets = {d: set(simhash.shingle_hashes(rows[d].text, 5).tolist()) for d in sorted(kept)}
    label = {d: d for d in sets}
    for a in sets:
        for b in sets:
            if b < a and label[a] != label[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
                lo, hi = sorted((label[a], label[b]))
                label = {d: lo if m == hi else m for d, m in label.items()}
    left = {d for d, m in label.items() if d == m}

    word = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t.lower())
    grams = lambda t: {tuple(word(t)[i : i + 5]) for i in range(len(word(t)) - 4)}
    items = [grams(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    of = {d: grams(rows[d].text) for d in left}
    left = {d for d in left if not any(len(q & of[d]) >= math.ceil(0.8 * len(q) - 1e-9) for q in items)}

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == [*docs.columns, "shard", "slot"]
    got = out.collect()
    assert all(tuple(r)[:5] == tuple(rows[r.doc_id]) for r in got)

    times = Counter(r.doc_id for r in got)
    assert set(times) <= left and set(times.values()) <= {1, 2}
    size = {d: len(word(rows[d].text)) for d in left}
    sources = sorted({rows[d].source for d in left}, key=lambda s: (s is None, s or ""))
    sums = [sum(size[d] for d in left if rows[d].source == s) for s in sources]
    share = [w * 1.5 * sum(sums) / sum((5, 2, 1)[i % 3] for i in range(len(sources))) for i, w in ((i, (5, 2, 1)[i % 3]) for i in range(len(sources)))]
    want = mixing.targets(sums)
    assert abs(sum(want) - min(1.5 * sum(sums), 2 * sum(sums))) < 1e-6 and all(t <= 2 * n + 1e-9 for t, n in zip(want, sums)) and all(t >= min(x, 2 * n) - 1e-9 for t, x, n in zip(want, share, sums))
    for s, t in zip(sources, want):  # about ten documents a source
        own = [d for d in left if rows[d].source == s]
        assert abs(sum(size[d] * times[d] for d in own) - t) <= max(0.01 * t, 60)

    n, count = len(got), Counter(r.shard for r in got)
    assert all(count[s] in (n // sharding.SHARDS, -(-n // sharding.SHARDS)) for s in range(sharding.SHARDS))
    assert all(sorted(r.slot for r in got if r.shard == s) == list(range(count[s])) for s in count)


def test_runs_do_not_disturb_one_another(spark):
    first = corpus_pipeline.run(spark, SF)
    second = corpus_pipeline.run(spark, SF)
    key = lambda r: (r.doc_id, r.shard, r.slot)
    assert sorted(map(key, first.collect())) == sorted(map(key, second.collect()))


def test_stages_take_odd_tables(spark):
    docs = spark.createDataFrame([(1, None, None, None, None, 1, "x"), (None, "", "en", "s", 0, 1, "x"), (2, "a b c", "en", "s", 5, 1, "x"), (2, "a b c", "en", "s", 5, 1, "x"), (3, "word " * 20_000, None, "t", 1, 1, "x")], "doc_id long, text string, lang string, source string, n_chars long, shard int, _row string")
    for df in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, df, SF)
            assert out.columns[: len(docs.columns)] == docs.columns and out.count() <= 2 * df.count()
