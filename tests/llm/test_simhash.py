"""SimHash groups and near copies against all pairs in plain Python."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from marlstone.llm import simhash
from marlstone.llm.components import components

SF = "/root/testdata/sf0.001"


def fp(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def closure(n, linked):
    label = list(range(n))
    for i in range(n):
        for j in range(i):
            if linked(i, j) and label[i] != label[j]:
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    return label


def least(ids, label):
    return [min((d for d, m in zip(ids, label) if m == k and d is not None), default=None) for k in label]


ODD = [(3, None), (2, ""), (9, " \n"), (5, "One two"), (4, "one TWO"), (None, "one two"), (7, "É ñ 漢字 🙂 a b c"), (8, "x " * 5000), (8, "x " * 5000), (None, None)]


@pytest.mark.parametrize("which", ["odd", "table"])
def test_groups(spark, which):
    docs = spark.createDataFrame([(*r, "c", 1) for r in ODD], "doc_id long, text string, fingerprint string, node int") if which == "odd" else spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    f = [fp(r.text) for r in rows]
    want = Counter((r.doc_id, f"{x:016x}", c) for r, x, c in zip(rows, f, least([r.doc_id for r in rows], closure(len(f), lambda i, j: (f[i] ^ f[j]).bit_count() <= 2))))
    assert Counter(tuple(r) for r in simhash.groups(docs).collect()) == want
    assert simhash.groups(docs.limit(0)).count() == 0


def test_links_reach_all_pairs(spark, monkeypatch):
    dice = random.Random(1)
    seeds = [dice.getrandbits(64) for _ in range(40)]
    values = set(seeds)
    for s in seeds:
        for _ in range(12):
            s ^= 1 << dice.randrange(64)
            s ^= 1 << dice.randrange(64)
            values.add(s)
    values = sorted(values)
    df = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long")
    want = closure(len(values), lambda i, j: (values[i] ^ values[j]).bit_count() <= 2)
    got = {r.node: r.label for r in components(simhash.link(df)).collect()}
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    for i in range(len(values)):
        for j in range(i):
            assert (want[i] == want[j]) == (got.get(signed[i], i) == got.get(signed[j], -j - 1))
    monkeypatch.setattr(simhash, "LARGE_SHARD", 8)  # a large shard is split by its other bits
    split = list(simhash._linked(values, 2, [(0, 64)]))
    parent = dict(zip(values, values))
    for a, b in split:
        parent[simhash._find(parent, a)] = simhash._find(parent, b)
    assert all((want[i] == want[j]) == (simhash._find(parent, values[i]) == simhash._find(parent, values[j])) for i in range(len(values)) for j in range(i))


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, (1 << 64) - 1), min_size=1, max_size=60, unique=True), st.integers(0, 30))
def test_tree(values, radius):
    tree = simhash.BKTree()
    for v in values:
        tree.add(v)
    near = sorted(v for v in values if (v ^ values[0]).bit_count() <= radius)
    assert sorted(tree.within(values[0], radius)) == near


@pytest.mark.parametrize("sided", [False, True])
def test_similar_sets(sided):
    dice = random.Random(3)
    sets, sides = [], []
    for g in range(30):
        base = [dice.getrandbits(60) for _ in range(dice.choice([1, 3, 40, 120]))]
        for _ in range(12):
            own = set(base) | set(dice.sample(range(50), dice.randint(0, 5)))
            for x in dice.sample(base, dice.randint(0, len(base) // 5)):
                own.discard(x)
                own.add(dice.getrandbits(60))
            sets.append(np.array(sorted(own), np.int64))
            sides.append(dice.randrange(2))
    want = [(i, j) for i in range(len(sets)) for j in range(i) if len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j])) - 1e-9 and (not sided or sides[i] != sides[j])]
    got = list(simhash.similar(sets, sides if sided else None))
    assert len(want) > 50 and {tuple(sorted(p)) for p in got} <= {tuple(sorted(p)) for p in want}
    assert len(got) < len(sets)
    ids, w, g = range(len(sets)), set(want), {tuple(sorted(p, reverse=True)) for p in got}
    assert least(ids, closure(len(sets), lambda i, j: (i, j) in w)) == least(ids, closure(len(sets), lambda i, j: (i, j) in g))


def test_alike_in_blocks(spark):
    """A group of more blocks than one is searched cell by cell, with the same components."""
    dice = random.Random(9)
    base = [dice.getrandbits(62) for _ in range(100)]
    sets = [sorted({*dice.sample(base, 95), *(dice.getrandbits(62) for _ in range(dice.choice([2, 30])))}) for _ in range(60)]
    links = spark.createDataFrame([(i, i + 1) for i in range(59)], "a long, b long")
    table = spark.createDataFrame(list(enumerate(sets)), "row long, shingles array<long>")
    ways = [{r.node: r.label for r in components(simhash.alike(links, table, block)).collect()} for block in (10**6, 700)]
    assert ways[0] == ways[1] and len(set(ways[0].values())) >= 1 and len(ways[0]) > 10


def test_components(spark):
    chain = [(i, i + 1) for i in range(-50, 50)] + [(1000, 1000 + i) for i in range(1, 300)] + [(7, 7), (5000, 4999), (4999, 5000)]
    got = {r.node: r.label for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: -50 for i in range(-50, 51)}, **{1000 + i: 1000 for i in range(300)}, 4999: 4999, 5000: 4999}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def copies(n, words, share, dice):
    vocab = [f"t{i}" for i in range(5000)]
    out = []
    for _ in range(n):
        base = [dice.choice(vocab) for _ in range(words)]
        other = list(base)
        for i in dice.sample(range(words), int(share * words)):
            other[i] = dice.choice(vocab)
        out += [" ".join(base), " ".join(other)]
    return out


def test_one_of_each(spark):
    dice = random.Random(5)
    texts = copies(40, 300, 0.01, dice) + copies(40, 200, 0.02, dice) + copies(40, 200, 0.2, dice) + ["", None, "a b", "A b", "a b", *["same " * 3] * 3]
    ids = list(range(len(texts)))
    dice.shuffle(ids)
    docs = spark.createDataFrame([(i, t, 0, "n") for i, t in zip(ids, texts)], "doc_id long, text string, _row int, stay string")
    sets = [set(simhash.shingle_hashes(t, 5).tolist()) for t in texts]

    def linked(i, j):
        return not (sets[i] or sets[j]) or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9

    label = closure(len(texts), linked)
    want = {min(d for d, m in zip(ids, label) if m == k) for k in set(label)}
    got = simhash.one_of_each(docs)
    assert got.columns == docs.columns
    got = {r.doc_id for r in got.collect()}
    assert want <= got and len(got - want) <= 1  # no clean one lost; recall at the very threshold is 0.98
    assert simhash.one_of_each(docs.limit(0)).count() == 0
    table = spark.read.parquet(f"{SF}/documents.parquet")
    assert simhash.one_of_each(table).count() < table.select("text").distinct().count() + 1


def test_partners_in_a_crowd(spark):
    dice = random.Random(11)
    word = lambda: f"t{dice.randrange(100_000)}"
    page = [word() for _ in range(200)]
    tails = [[word() for _ in range(43)] for _ in range(300)]  # alike at 0.7: no links
    texts = [" ".join(page + t) for t in tails] + [" ".join(page + t[:22] + [word() for _ in range(21)]) for t in tails[:60]]
    sets = [set(simhash.shingle_hashes(t, 5).tolist()) for t in texts]
    alike = lambda i, j: len(sets[i] & sets[j]) / len(sets[i] | sets[j])
    assert all(alike(i, 300 + i) >= 0.8 for i in range(60)) and all(alike(i, j) < 0.8 for i in range(300) for j in range(i))
    got = {r.doc_id for r in simhash.one_of_each(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert set(range(300)) <= got and len(got) <= 301  # of 60 partners


def test_recall_on_a_table(spark):
    """All links of a table by an inverted index of all shingles; every one that is lost is listed."""
    docs = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet")
    rows = docs.collect()
    sets = [set(simhash.shingle_hashes(r.text, 5).tolist()) for r in rows]
    holders = {}
    for i, x in enumerate(sets):
        for h in x:
            holders.setdefault(h, []).append(i)
    links = []
    for i, x in enumerate(sets):
        shared = Counter(j for h in x for j in holders[h] if j < i)
        links += [(j, i) for j, n in shared.items() if n >= 0.8 * (len(x) + len(sets[j]) - n) - 1e-9]
    label = closure(len(rows), lambda i, j, w=set(links): (j, i) in w)
    stays = {r.doc_id for r in simhash.one_of_each(docs).collect()}
    lost = [(rows[j].doc_id, rows[i].doc_id) for j, i in links if rows[j].doc_id in stays and rows[i].doc_id in stays]
    assert len(links) > 20 and lost == []
    empty = [i for i, x in enumerate(sets) if not x]
    assert stays == {min(rows[i].doc_id for i in range(len(rows)) if label[i] == m and sets[i]) for m in {label[i] for i in range(len(rows)) if sets[i]}} | {min((rows[i].doc_id for i in empty), default=None)} - {None}


def test_recall_counts_the_radius():
    k, choices = simhash._choices(100_000)
    width, sim = getattr(simhash, "WIDE_BITS", 64), 2 * simhash.SIMILARITY / (1 + simhash.SIMILARITY)
    differ = math.acos(sim) / math.pi
    differ += math.sqrt(differ * (1 - differ) / simhash.SIGNATURE_BITS)
    beyond = 1 - sum(math.comb(width, i) * differ**i * (1 - differ) ** (width - i) for i in range(simhash.WIDE_RADIUS + 1))
    assert (1 - (1 - differ) ** k) ** len(choices) + beyond <= 1 - simhash.RECALL


def test_signature_is_deterministic():
    h = simhash.shingle_hashes("a b c d e f g h", 5)
    assert simhash.signature(h).tobytes() == simhash.signature(np.array(h)).tobytes() and len(simhash.signature(h).tobytes()) == 32


def test_heaps_of_copies_and_long_texts(spark):
    """A third of all rows in one group of copies, one of near copies, and texts of a hundred thousand words."""
    dice = random.Random(2)
    base = [f"t{dice.randrange(5000)}" for _ in range(300)]
    near = [" ".join(base[:i] + [f"x{i}"] + base[i + 1 :]) for i in range(150)]
    long = " ".join(f"w{i}" for i in range(100_000))
    texts = ["hot text of the corpus again and again"] * 300 + near + [long, long + " end", "other " + long[::-1]] + [f"single {i} " + " ".join(str(dice.random()) for _ in range(20)) for i in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id for r in simhash.one_of_each(docs).collect()} == {0, 300, 450, 452, *range(453, 653)}
    got = {r.doc_id: r.component_id for r in simhash.groups(docs).collect()}
    assert all(got[i] == 0 for i in range(300)) and got[450] == got[451] == 450 and all(got[i] == i for i in range(453, 653))
