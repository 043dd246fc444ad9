"""Rollups against sums over all rows."""

import base64
import random
import re
from collections import Counter, defaultdict

import pytest

from marlstone.llm import queries, tokens

VOCAB = "/opt/tokenizers/byte_bpe_50k.tiktoken"
SF = "/root/testdata/sf0.001"


def as_dict(df):
    return {(r.source, r.lang, r.tokenizer): (r.n_docs, r.n_tokens) for r in df.collect()}


def test_signed_batches(spark, tmp_path):
    dice = random.Random(1)
    roll = tokens.Rollup(spark, f"file://{tmp_path}/roll")
    live, want = {}, defaultdict(lambda: [0, 0])
    assert as_dict(roll.totals()) == {} and not roll.compact()
    schema = "op string, source string, lang string, tokenizer string, n_tokens long, old_source string, old_lang string, old_tokenizer string, old_n_tokens long, doc_id long"
    for batch in range(6):
        rows = []
        for i in range(40):
            key = (dice.choice(["a", "b", None]), dice.choice(["en", None]), dice.choice(["v1", "v2"]))
            n = dice.choice([None, 0, 5, 17])
            op = dice.choice(["insert", "insert", "delete", "revise"]) if live else "insert"
            if op == "insert":
                live[batch, i] = (key, n)
                rows.append((op, *key, n, None, None, None, None, i))
            elif op == "delete":
                old, m = live.pop(dice.choice(sorted(live)))
                rows.append((op, *old, m, None, None, None, None, i))
            else:
                who = dice.choice(sorted(live))
                old, m = live[who]
                live[who] = (key, n)
                rows.append((op, *key, n, *old, m, i))
        df = spark.createDataFrame(rows, schema)
        assert roll.commit(f"batch/{batch} é", df)
        assert not roll.commit(f"batch/{batch} é", df)
        if batch in (2, 3):
            assert roll.compact()
            assert not roll.commit("batch/0 é", df)
    for key, n in live.values():
        want[key][0] += 1
        want[key][1] += n or 0
    assert as_dict(roll.totals()) == {k: tuple(v) for k, v in want.items()}
    assert roll.commit("empty", spark.createDataFrame([], schema)) and as_dict(roll.totals()) == {k: tuple(v) for k, v in want.items()}
    with pytest.raises(Exception, match="unknown change"):
        roll.commit("bad", spark.createDataFrame([("upsert", "a", "en", "v1", 1)], "op string, source string, lang string, tokenizer string, n_tokens long"))
    before = as_dict(roll.totals())
    nothing = spark.createDataFrame([(None, "a", "en", "v1", 9), ("insert", "a", "en", "v1", 2)], "op string, source string, lang string, tokenizer string, n_tokens long")
    assert roll.commit("", nothing) and not roll.commit("", nothing)  # an empty id is one, a null op no change
    n, t = before.get(("a", "en", "v1"), (0, 0))
    assert as_dict(roll.totals()) == before | {("a", "en", "v1"): (n + 1, t + 2)}
    assert roll.compact() and not roll.commit("", nothing) and as_dict(roll.totals()) == before | {("a", "en", "v1"): (n + 1, t + 2)}
    assert not (tmp_path / "roll/batches" / f"b{base64.urlsafe_b64encode(b'bad').decode()}").exists()


def test_corpus_totals(spark, tmp_path):
    enc = tokens.encoder(open(VOCAB, "rb").read())
    odd = [(1, "Hello  world's é 漢字 🙂\n\n1234", "s", "en"), (2, None, None, None), (None, "", "s", "en"), (3, "again", "t", None), (3, "again", "t", None), (2, "again", "u", "fr"), (9, "x" * 70_000, "s", "en"), (5, "<|endoftext|>", "s", "en")]
    for i, df in enumerate((spark.createDataFrame([(*r, "c", 0) for r in odd], "doc_id long, text string, source string, lang string, copy string, row int"), spark.read.parquet(f"{SF}/documents.parquet"))):
        best = {}
        for r in df.collect():
            key, at = r.text or "", (r.doc_id is None, r.doc_id or 0)
            if key not in best or at < best[key][0]:
                best[key] = (at, r.source, r.lang)
        want = Counter(), Counter()
        for t, (_, source, lang) in best.items():
            for name, n in (("words", len(re.findall(r"[^\x20\x09-\x0D]+", t))), ("byte_bpe_50k", len(enc.encode_ordinary(t)))):
                want[0][source, lang, name] += 1
                want[1][source, lang, name] += n
        got = as_dict(tokens.corpus_totals(df, VOCAB, f"file://{tmp_path}/c{i}"))
        assert got == {k: (n, want[1][k]) for k, n in want[0].items()}
    assert tokens.corpus_totals(df.limit(0), VOCAB, f"file://{tmp_path}/empty").count() == 0


def test_every_row_counts(spark):
    enc, want = tokens.encoder(open(VOCAB, "rb").read()), Counter()
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        for name, n in (("words", len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))), ("byte_bpe_50k", len(enc.encode_ordinary(r.text or "")))):
            want[r.source, r.lang, name, "n_docs"] += 1
            want[r.source, r.lang, name, "n_tokens"] += n
    got = as_dict(queries.op1_token_counts(spark, SF))
    assert got == {k[:3]: (n, want[*k[:3], "n_tokens"]) for k, n in want.items() if k[3] == "n_docs"}
