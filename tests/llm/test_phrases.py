"""Substring dedup against counts of all windows in plain Python."""

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from marlstone.llm import phrases

SF = "/root/testdata/sf0.001"


def brute(texts):
    lines = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen = Counter(tuple(w[i : i + 35]) for w in lines for i in range(len(w) - 34))
    out = []
    for w in lines:
        gone = {k for i in range(len(w) - 34) if seen[tuple(w[i : i + 35])] > 1 for k in range(i, i + 35)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return out


def odd():
    dice = random.Random(8)
    word = lambda: f"{dice.choice('abcdé漢🙂')}{dice.randrange(400)}"
    run = lambda n: [word() for _ in range(n)]
    p35, p34, p60, p90 = run(35), run(34), run(60), run(90)
    texts = [None, "", " \n", "a " * 34, "b " * 35, "c " * 36, "c " * 20]
    for k in range(12):
        texts.append(" ".join(run(20 + k) + p35 + run(9) + p34 + run(5)))
        texts.append("\n".join(run(k) + p60[k : k + 40] + run(30)))
        texts.append("\t".join(p90[: 30 + 4 * k] + run(3) + p90[50 - k :]))
    base = run(300)
    for k in range(20):
        other = list(base)
        for i in dice.sample(range(300), k):
            other[i] = word()
        texts.append(" ".join(other))
    texts += [" ".join(run(50))] * 3 + [" ".join(["x", "y"] * 100), " ".join(run(3000) * 2), " ".join(["ab"] + p35 + ["cd"]), " ".join(["zab"] + p35[:-1] + [p35[-1] + "s"])]
    return texts


@pytest.mark.parametrize("which", ["odd", "table"])
def test_removed(spark, which, monkeypatch):
    texts = odd() if which == "odd" else [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]
    docs = spark.createDataFrame([(i, t, b"x", 3) for i, t in enumerate(texts)], "doc_id long, text string, copy binary, n_words int").repartition(3)
    want = brute(texts)
    for small in (True, False):
        if not small:
            monkeypatch.setattr(phrases, "MOST_BYTES", 0)
        got = {r.doc_id: tuple(r)[1:] for r in (phrases.removed(docs) if small else phrases.removed(docs, shard_chars=5000, slice_=2)).collect()}
        assert len(got) == len(texts)
        assert {i: got[i] for i in got if got[i] != want[i]} == {}


def test_ids_and_empty(spark):
    t = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(None, t), (None, t), (1, None)], "doc_id long, text string")
    assert Counter((r.doc_id, r.n_removed) for r in phrases.removed(docs).collect()) == {(None, 40): 2, (1, 0): 1}
    assert phrases.removed(docs.limit(0)).count() == 0


def test_only_automata_find_words(spark, monkeypatch):
    """Without the passages of one stretch its words stay, in every document; without any passage all words do."""
    dice = random.Random(1)
    run = lambda n: [f"w{dice.randrange(10**6)}" for _ in range(n)]
    p, q = run(40), run(50)
    docs = spark.createDataFrame([(i, " ".join(run(20) + p + run(20) + q + run(i))) for i in range(5)], "doc_id long, text string")
    assert {r.n_removed for r in phrases.removed(docs).collect()} == {90}
    every = phrases.passages
    monkeypatch.setattr(phrases, "passages", lambda parts: every(parts).filter(~F.contains("line", F.lit(f" {q[0]} "))))
    assert all(40 < r.n_removed < 90 for r in phrases.removed(docs).collect())
    monkeypatch.setattr(phrases, "passages", lambda parts: every(parts).limit(0))
    assert {r.n_removed for r in phrases.removed(docs).collect()} == {0}


def test_locate():
    line = " " + " ".join(f"w{i}" for i in range(100)) + " "
    shard = phrases.automaton({" w3 w4 w5 ", " w4 w5 ", " w98 w99 ", " w0 ", " 3 w4 "})
    assert sorted(phrases.locate(shard, line)) == [(0, 1), (3, 6), (4, 6), (98, 100)]


def test_long_words(spark):
    """Words longer than automata hold, a hot passage and very long texts."""
    long = [f"{i}" + "x" * 100_000 for i in range(40)]
    other = [*long[:-1], long[-1] + "y"]
    same = " ".join(f"s{i}" for i in range(40))
    big = " ".join(f"b{i}" for i in range(100_000))
    docs = spark.createDataFrame([(1, " ".join(long)), (2, " ".join(other)), (3, big + " tail"), (4, "head " + big), *((10 + i, f"u{i} {same} v{i}") for i in range(50))], "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in phrases.removed(docs, slice_=10).collect()}
    assert got == {1: 39, 2: 39, 3: 100_000, 4: 100_000, **{10 + i: 40 for i in range(50)}}
