"""The flow against all flows of small networks; the mix against its contract."""

import itertools
import random
import re
from collections import Counter, defaultdict

from marlstone.llm import flow, mixing

SF = "/root/testdata/sf0.001"


def cost(patterns, taken):
    total = 0
    for (unit, members), of in zip(patterns, taken):
        for use in range(sum(of.values())):
            total += use // unit
    return total


def test_flow_is_the_cheapest():
    dice = random.Random(2)
    for _ in range(40):
        members = [{"a": dice.randint(1, 3), "b": dice.randint(1, 3)} if dice.random() < 0.6 else {dice.choice("ab"): dice.randint(1, 3)} for _ in range(3)]
        patterns = [(max(m.values()), m) for m in members]
        have = {s: sum(m.get(s, 0) for m in members) for s in "ab"}
        quotas = {s: dice.randint(0, 2 * have[s]) for s in "ab"}
        got = flow.route(patterns, quotas)
        assert all(sum(of.get(s, 0) for of in got) == quotas[s] for s in "ab")
        assert all(f <= 2 * m[s] for m, of in zip(members, got) for s, f in of.items())
        slots = [(i, s) for i, m in enumerate(members) for s in m]
        best = None
        for choice in itertools.product(*[range(2 * members[i][s] + 1) for i, s in slots]):
            if all(sum(f for (_, t), f in zip(slots, choice) if t == s) == quotas[s] for s in "ab"):
                of = [{} for _ in members]
                for (i, s), f in zip(slots, choice):
                    of[i][s] = f
                c = cost(patterns, of)
                best = c if best is None else min(best, c)
        assert cost(patterns, got) == best


def test_flow_of_many_uses():
    """Convex at any number of uses: texts that are used a million times share the uses evenly, as far as members allow."""
    got = flow.route([(1, {"a": 10**6}), (2, {"a": 10**6}), (1, {"a": 100}), (5, {"b": 7})], {"a": 1_500_000, "b": 0})
    assert got[2] == {"a": 200} and got[3] == {"b": 0}
    assert abs(got[0]["a"] - got[1]["a"] / 2) <= 1 and got[0]["a"] + got[1]["a"] == 1_499_800


def test_settle():
    dice = random.Random(6)
    for _ in range(200):
        docs = {(0, i): (dice.randint(1, 400), dice.randint(0, 2)) for i in range(dice.choice([1, 3, 12, 40]))}
        left = dice.randint(-500, 500)
        steps = mixing.settle(left, docs)
        assert all(0 <= docs[k][1] + n <= 2 and abs(n) == 1 for k, n in steps.items())
        after = left - sum(n * docs[k][0] for k, n in steps.items())
        pairs = [n * docs[k][0] for k in docs for n in (1, -1) if 0 <= docs[k][1] + n <= 2] + [docs[a][0] - docs[b][0] for a in docs for b in docs if a != b and docs[a][1] < 2 and docs[b][1] > 0]
        assert abs(after) <= min([abs(left), *(abs(left - x) for x in pairs)])
    for _ in range(60):  # all sums of a few documents
        docs = {(0, i): (dice.randint(1, 60), dice.randint(0, 2)) for i in range(5)}
        left = dice.randint(-300, 300)
        ways = itertools.product(*[[n for n in (-1, 0, 1) if 0 <= uses + n <= 2] for _, uses in docs.values()])
        best = min(abs(left - sum(n * size for n, (size, _) in zip(w, docs.values()))) for w in ways)
        assert abs(left - sum(n * docs[k][0] for k, n in mixing.settle(left, docs).items())) == best
    assert mixing.settle(0, {(0, 0): (5, 0)}) == {} and mixing.settle(7, {}) == {}


def test_targets():
    assert mixing.targets([]) == [] and mixing.targets([0, 0]) == [0.0, 0.0]
    t = mixing.targets([100, 1000, 1000])
    assert t[0] == 200 and abs(sum(t) - 1.5 * 2100) < 1e-6 and abs(t[1] - 2 * t[2]) < 1e-6
    assert mixing.targets([0, 5])[0] == 0


def check(spark, docs, slack=0):
    rows = docs.collect()
    got = mixing.mix(docs).collect()
    assert Counter((r.doc_id, r.size) for r in got) == Counter((r.doc_id, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))) for r in rows)
    sums, taken, largest, goal = defaultdict(int), defaultdict(int), defaultdict(int), {}
    of = defaultdict(list)
    for r in rows:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
        sums[r.source] += n
        largest[r.source] = max(largest[r.source], n)
        of[r.doc_id].append(r.source)
    order = sorted(sums, key=lambda s: (s is None, s or ""))
    want = dict(zip(order, mixing.targets([sums[s] for s in order])))
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        match = [s for s in of[r.doc_id] if sums[s] == r.source_size and want[s] == r.target]
        assert match
        taken[match[0]] += r.taken
        goal[match[0]] = r.target
    for s in goal:
        assert abs(taken[s] - goal[s]) <= max(0.01 * goal[s], slack)
    assert sorted(map(str, mixing.mix(docs.repartition(3)).collect())) == sorted(map(str, got))


def test_mix(spark):
    check(spark, spark.read.parquet(f"{SF}/documents.parquet"), slack=30)  # about ten documents a source
    check(spark, spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet"))
    dice = random.Random(4)
    shared = [" ".join(f"w{dice.randrange(99)}" for _ in range(dice.randint(1, 30))) for _ in range(60)]
    rows = [(i, dice.choice(shared), dice.choice(["a", "b", "é", None]), 1, "x") for i in range(400)] + [(400 + i, t, "z", 1, "x") for i, t in enumerate(["", None, " "])] + [(None, "one two", "a", 1, "x")]
    check(spark, spark.createDataFrame(rows, "doc_id long, text string, source string, taken int, pattern string"), slack=2)
    check(spark, spark.createDataFrame([(7, "same row here", "hot", 1, "x")] * 300 + [(8, "another", "b", 1, "x")], "doc_id long, text string, source string, taken int, pattern string"), slack=3)
    assert mixing.mix(spark.read.parquet(f"{SF}/documents.parquet").limit(0)).count() == 0


def test_mixed_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumnRenamed("n_chars", "_times")
    times = {r.doc_id: r.taken // r.size for r in mixing.mix(docs).collect() if r.size}
    got = mixing.mixed_documents(docs)
    assert got.columns == docs.columns
    assert Counter(r.doc_id for r in got.collect()) == Counter({d: n for d, n in times.items() if n})
