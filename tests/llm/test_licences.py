"""Licence scans against the same definitions in plain Python, without any dropping of lines."""

import math
import re
import unicodedata
from collections import Counter, defaultdict

from marlstone.llm import licences

SF = "/root/testdata/sf0.001"


def tokens(line):
    edge = lambda c: unicodedata.category(c)[0] in "PS"
    out = []
    for w in re.split(r"[\x20\x09-\x0D]+", line.lower()):
        while w and edge(w[0]):
            w = w[1:]
        while w and edge(w[-1]):
            w = w[:-1]
        if w:
            out.append(w)
    return out


def brute(rows):
    """rows: (key, path, text). Windows at every place of every leading word."""
    temps = [(name, tokens(t)) for name, t in licences.TEMPLATES]
    vocabulary = {w for _, t in temps for w in t}
    df = Counter(w for _, _, t in rows for w in set(tokens(t or "")) & vocabulary)
    n = len(rows)
    idf = lambda w: 1 + math.log((1 + n) / (1 + df[w])) if w in vocabulary else 1 + math.log(1 + n)
    vec = lambda ts: {w: c * idf(w) for w, c in Counter(ts).items()}
    cos = lambda u, v: sum(x * v.get(w, 0) for w, x in u.items()) / math.sqrt(sum(x * x for x in u.values()) * sum(x * x for x in v.values())) if u and v else 0
    _, units = licences.vectors(df, n)
    lead = [licences.leading(u, licences.THRESHOLD) for u in units]
    found, votes = [], defaultdict(Counter)
    for key, path, text in rows:
        ts, hits, spent = tokens(text or ""), [], set()
        for (name, t), words in zip(temps, lead):
            for s in {max(p - t.index(w), 0) for p, w in enumerate(ts) if w in words}:
                x = round(cos(vec(ts[s : s + len(t)]), vec(t)), 9)
                if x >= licences.THRESHOLD:
                    hits.append((-x, name))
                    spent |= set(range(s, min(s + len(t), len(ts))))
        own = min(hits) if hits else None
        found.append((key, path, own))
        if own and path is not None and (re.match(licences.LICENCE_FILE, path.split("/")[-1]) or len(ts) - len(spent) <= licences.MOST_OTHER_WORDS):
            votes[path.rpartition("/")[0]][own[1]] += 1
    dirs = {d: min((-c, name) for name, c in v.items())[1] for d, v in votes.items()}
    out = Counter()
    for key, path, own in found:
        got = (own[1], -own[0], "own", None) if own else (None, None, "none", None)
        if not own and path is not None:
            at = path.rpartition("/")[0]
            ups = ["/".join(at.split("/")[:i]) for i in range(len(at.split("/")), 0, -1)] + [""]
            up = next((u for u in ups if u in dirs), None)
            if up is not None:
                got = (dirs[up], None, "inherited", up)
        out[(key, path, *got)] += 1
    return out


def check(spark, rows):
    df = spark.createDataFrame([(*r, "o", 1.0) for r in rows], "key long, path string, text string, own string, score double")
    assert Counter(tuple(r) for r in licences.scan(df, "key", "path").collect()) == brute(rows)


def test_scan(spark):
    apache, gpl, mit = (licences.TEMPLATES[i][1] for i in (0, 3, 4))
    rows = [
        (1, "a/LICENSE", "x " * 500 + "\n" + apache), (2, "a/b/c/d.py", "print(1)\n"), (3, "a/b/e.py", f"# {mit.upper()}\ncode " + "w " * 90), (4, "a/b/c/COPYING.txt", gpl + "\n" + "long text " * 100),
        (5, "a/b/c/f", None), (6, None, mit), (7, None, None), (8, "", ""), (9, "z", "released under the license"), (9, "z", "released under the license"), (10, "q/r", mit), (11, "q/s", gpl),
        (12, "q/t/u", "nothing here"), (13, "top", apache), (14, "aa/b", "the license is " + "long " * 5000 + "license"), (15, "w/x", f"{apache} {apache}"), (16, "w/y", mit + "\n" + apache), (17, "/abs/x", "n"),
        (18, "v/w", "Licensed under Apache License Version 2.0"), (19, "v/w2", "is this work by the general public"), (None, "v/w3", "é ñ 漢字"),
    ]
    check(spark, rows)
    empty = spark.createDataFrame([], "key long, path string, text string")
    assert licences.scan(empty, "key", "path").count() == 0


def wrapped(text, width, sign):
    lines, line = [], ""
    for w in text.split():
        if len(line) + len(w) > width:
            lines.append(line)
            line = ""
        line += w + " "
    return "\n".join(f"{sign} {x}" for x in [*lines, line])


def test_wrapped_headers_and_licence_files(spark):
    """Every template is found however it is wrapped, commented and surrounded, with some words changed; other prose is not."""
    code = "def main(argv): " + "value = compute(x, y) return total " * 60
    rows = []
    for i, (name, text) in enumerate(licences.TEMPLATES):
        some = text.split()
        changed = " ".join(w if k % 15 != 9 else f"altered{k}" for k, w in enumerate(some))
        rows += [(f"{i}a", name, wrapped(text, 72, " *") + "\n */\n" + code), (f"{i}b", name, "Copyright (c) 2020 Some One\n\n" + wrapped(text, 30, "#") + "\n" + code), (f"{i}c", name if len(some) > 20 else None, code + wrapped(changed, 50, "//") + code), (f"{i}d", name, text.upper())]
    rows += [("x", None, code), ("y", None, "The software of the author is in the source, and the license of the file is not the copy of the public work " * 9)]
    df = spark.createDataFrame([(k, f"{k}/f", t) for k, _, t in rows], "key string, path string, text string")
    got = {r.key: r.licence for r in licences.scan(df, "key", "path").collect()}
    assert {k: (want, got[k]) for k, want, _ in rows if want and got[k] != want} == {}
    assert got["x"] is None and got["y"] is None


def test_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    check(spark, [(r.doc_id, "/".join(x for x in (r.source, r.lang, str(r.doc_id)) if x), r.text) for r in docs])


def test_leading_words_are_needed():
    _, units = licences.vectors({"the": 100, "under": 80}, 100)
    for u in units:
        lead = licences.leading(u, 0.8)
        assert math.sqrt(sum(x * x for w, x in u.items() if w not in lead)) < 0.8
