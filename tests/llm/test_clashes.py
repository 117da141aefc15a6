"""Cases of nulls, clashing names, odd types, forged digests and long texts that the other tests do not have."""

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from digestlake.llm import near_dup, quality, secrets, toxicity
from digestlake.llm import words as W
from digestlake.llm.bpe import Memory, Pieces
from digestlake.llm.components import united


def test_representatives_with_odd_columns(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (1, None), (2, "a b c d e f"), (3, None), (None, "x y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"_gone": F.lit(1), "there": F.lit(2), "own_id": F.lit("o"), "TURN": F.lit(0), "a.b": F.lit(1.5), "m": F.create_map(F.lit("k"), F.lit(1)), "s": F.struct(F.lit(1).alias("x"), F.create_map(F.lit(1), F.lit(2)).alias("y"))})
    kept = near_dup.representatives(docs)
    assert kept.columns == docs.columns
    assert sorted((repr(r["doc_id"]), repr(r["text"])) for r in kept.collect()) == [("1", "None"), ("3", "None"), ("None", "'x y'")]


def test_equal_sets_need_equal_digests():
    a, b = np.arange(5, dtype=np.uint64), np.array([0, 1, 2, 3, 5], np.uint64)
    assert near_dup.set_digest(a) == near_dup.set_digest(a.copy()) != near_dup.set_digest(b) and len(near_dup.set_digest(a)) == 2


def test_later_links_unite_components(spark):
    labels = spark.createDataFrame([(1, 1), (2, 1), (5, 5), (6, 5), (8, 8), (9, 8)], "id long, component long")
    links = spark.createDataFrame([(6, 2), (20, 9), (30, 31)], "a long, b long")
    assert {r["id"]: r["component"] for r in united(labels, links).collect()} == {1: 1, 2: 1, 5: 1, 6: 1, 8: 8, 9: 8, 20: 8, 30: 30, 31: 30}


@pytest.mark.parametrize("stretch", [64, 1000])
def test_words_by_stretches(monkeypatch, stretch):
    r = random.Random(1)
    texts = [("".join(r.choice("ab \n") for _ in range(3000)) + "x" * 900 + " end").encode(), b"", b" ", b"abc", b"y" * 300]
    whole = W.Words(texts, W.EXACT_BYTES, proofs=True)
    W._powers.cache_clear(), W._first_proof_weights.cache_clear()
    monkeypatch.setattr(W, "STRETCH", stretch)
    parts = W.Words(texts, W.EXACT_BYTES, proofs=True)
    W._powers.cache_clear(), W._first_proof_weights.cache_clear()
    assert all(np.array_equal(getattr(whole, f), getattr(parts, f)) for f in ("start", "end", "name", "proof", "first", "offset"))
    assert [whole.raw[a:b] for a, b in zip(whole.start, whole.end)] == b" ".join(texts).split()


def test_words_of_one_name_stay_apart():
    memory = Memory()
    name, proof = np.array([7], np.uint64), np.array([1], np.uint64)
    memory.put(name, proof, np.array([42]))
    assert memory.get(name, proof)[1].tolist() == [] and memory.get(name, proof + np.uint64(1))[1].tolist() == [0]
    morse = "a"
    for _ in range(12):  # numbers that multiply by powers of one odd number clash on such words, whatever the number
        morse += morse.translate(str.maketrans("ab", "ba"))
    other = morse.translate(str.maketrans("ab", "ba"))
    pieces = Pieces([f"{morse} {other} {morse}"])
    assert len(pieces.names) == 2 and pieces.word[0] == pieces.word[2] != pieces.word[1]


def test_many_matches_in_one_text(spark):
    r = random.Random(3)
    parts = [r.choice(["%016x" % r.getrandbits(64), "AKIA" + "Q" * 16, "password=" + "x" * 12, "http://a.bc", "z" * 19 + "1", "é"]) for _ in range(3000)]
    rows = [(1, " ".join(parts)), (2, (" " * 300).join(parts[:200]))]
    got = {x["doc_id"]: x for x in secrets.secret_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    assert sorted(map(tuple, got.values())) == sorted(con.sql(secrets.ORACLE).fetchall())
    masked = {x["doc_id"]: x["text"] for x in secrets.masked(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, text in rows:
        spans = sorted((int(a), int(b)) for _, a, b in (s.split(":") for s in got[k]["spans"].split(",")))
        out, at = "", 0
        for a, b in spans:
            if a >= at:
                out += text[at:a] + secrets.MASK
            at = max(at, b)
        assert masked[k] == out + text[at:]


def test_votes_against_brute_force():
    r = np.random.default_rng(0)
    counts = r.poisson(1.0, (300, quality.TERMS)).astype(np.float32) * 3
    counts[5] = 0
    labels = r.integers(0, 2, 200)
    model = quality.fit(counts[:200], labels)
    told = []
    for c in counts:
        v = model.project(c[None])[0]
        cosines = sorted(((-round(float(v @ x) * 1e6), k) for k, x in enumerate(model.vectors)))[: quality.NEIGHBOURS]
        w = [max(1e-3, min(1, -s / 1e6)) ** quality.SHARPNESS for s, _ in cosines]
        told.append(sum(x * labels[k] for x, (_, k) in zip(w, cosines)) / sum(w) if c.any() else labels.mean())
    assert np.mean(np.abs(model.score(counts) - told) < 1e-3) > 0.98 and model.score(counts)[5] == pytest.approx(labels.mean())


def test_ftrl_against_brute_force():
    r = np.random.default_rng(1)
    sets = [np.unique(r.integers(0, 30, 6)).astype(np.int32) for _ in range(120)]
    y = np.array([float(3 in s.tolist()) for s in sets])
    z, n = {}, {}
    share = {toxicity.SPACE: 0.0}
    weight = lambda j: 0.0 if abs(z.get(j, 0.0)) <= share.get(j, toxicity.L1) else -(z[j] - np.sign(z[j]) * share.get(j, toxicity.L1)) / ((toxicity.BETA + n[j] ** 0.5) / toxicity.ALPHA + toxicity.L2)
    for _ in range(toxicity.EPOCHS):
        for s, label in zip(sets, y):
            at = [*s.tolist(), toxicity.SPACE]
            w = {j: weight(j) for j in at}
            g = 1 / (1 + np.exp(-sum(w.values()))) - label
            for j in at:
                rate = ((n.get(j, 0.0) + g * g) ** 0.5 - n.get(j, 0.0) ** 0.5) / toxicity.ALPHA
                z[j] = z.get(j, 0.0) + g - rate * w[j]
                n[j] = n.get(j, 0.0) + g * g
    model = toxicity.fit(sets, y)
    told = {j: weight(j) for j in range(30) if weight(j)}
    assert dict(zip(model.place.tolist(), np.round(model.weight, 4).tolist())) == pytest.approx({j: round(float(w), 4) for j, w in told.items()}, abs=1e-3) and 3 in told
