"""Whole calls, walks with a bound, long ranges, groups without a key, tables without a marker, answers of live sources."""

import gzip
import io
import json
import random
import tarfile

import duckdb
import pytest
from pyspark.sql import functions as F

from digestlake.functions import bloom
from digestlake.operators import identity, intervals, lookup, recipes, resolve, verdicts
from digestlake.sources import answers, descent, tables

COORDS = "finding_id long, coords array<struct<scheme:string,digest:string>>"


def told_walk(seeds, findings, hops, cap):
    out = []
    for query, *coord in seeds:
        frontier, seen, held = {tuple(coord)}, {tuple(coord)}, {}
        for hop in range(hops):
            met = {}
            for c in sorted(frontier):
                for f in sorted(f for f, cs in findings.items() if c in cs):
                    met.setdefault(f, c)
            fresh = sorted(((c, f) for f, c in met.items() if f not in held))[: cap - len(held)]
            held |= {f: (hop, *c) for c, f in fresh}
            frontier = {c for _, f in fresh for c in findings[f]} - seen
            seen |= frontier
            if len(held) >= cap or not frontier:
                break
        out += [(query, hop, s, d, f) for f, (hop, s, d) in held.items()]
    return sorted(out)


@pytest.mark.parametrize("cap", [1, 3, 7, 1000])
def test_a_walk_is_bounded_in_each_hop(spark, cap):
    r = random.Random(4)
    findings = {k: sorted({(r.choice(["md5", "sha1"]), r.choice("abcdefgh")) for _ in range(2)}) for k in range(40)}
    seeds = [(k, s, d) for k, (s, d) in enumerate([("md5", "a"), ("sha1", "b"), ("md5", "z"), ("md5", "a")])]
    got = identity.walk(spark.createDataFrame(seeds, "query_id long, scheme string, digest string"), spark.createDataFrame(list(findings.items()), COORDS), cap=cap)
    assert sorted((x["query_id"], x["hop"], x["scheme"], x["digest"], x["finding_id"]) for x in got.collect()) == told_walk(seeds, findings, identity.MAX_HOPS, cap)


def test_resolve_tells_collisions_and_errors(spark):
    a, b, c = "a" * 64, "b" * 64, "c" * 32
    findings = spark.createDataFrame([(1, [("md5", c), ("sha256", a)]), (2, [("md5", c), ("sha256", b)]), (3, [("sha256", a), ("sha1", "d" * 40)])], COORDS)
    asked = spark.createDataFrame([(1, c), (2, a), (3, "nonsense"), (4, "sha1:" + "e" * 40), (5, None)], "query_id long, text string")
    told, found = resolve.resolve(asked, findings)
    rows = {x["query_id"]: x for x in told.collect()}
    assert (rows[1]["clusters"], rows[1]["collision"], rows[2]["collision"]) == (2, True, False)
    assert rows[3]["error"] and rows[3]["clusters"] == 0 and rows[4]["error"] is None and rows[4]["clusters"] == 0 and 5 in rows
    assert {tuple(x["finding_ids"]) for x in found.where("query_id = 1").collect()} == {(1, 3), (2,)}


def test_scan_of_containers(spark):
    raw = io.BytesIO()
    with tarfile.open(fileobj=raw, mode="w") as t:
        for k in range(3):
            info = tarfile.TarInfo(f"m{k}")
            info.size = 100
            t.addfile(info, io.BytesIO(bytes([65 + k]) * 100))
    import hashlib

    sha = lambda k: hashlib.sha256(bytes([65 + k]) * 100).hexdigest()
    files = spark.createDataFrame([("x.tar.gz", gzip.compress(raw.getvalue())), ("small", b"abc"), ("empty", None)], "path string, content binary")
    witnesses = spark.createDataFrame([(1, None, sha(0))], "row_id long, sha1 string, sha256 string")
    key = spark.createDataFrame([(sha(1),)], "d string").select(F.lit(sha(1)).alias("key"))
    from digestlake.functions.digests import bloom_key

    words = bloom.build(key.select(bloom_key(F.lit("sha256"), F.col("key")).alias("key")), "key", 7, 1024)
    got = {x["path"]: x for x in resolve.scan(files, witnesses, {"corpus": (words, 7, 1024)}).collect()}
    assert [got[f"x.tar.gz!x.tar!m{k}"]["class"] for k in range(3)] == ["identified", "membership", "unknown"]
    top = got["x.tar.gz"]
    assert (top["total"], top["known"], top["unknown"], top["floor"]) == (3, 2, 1, 0) and got["small"]["class"] == "floor" and got["empty"]["class"] == "floor"


def test_members_beyond_the_bound_are_told(monkeypatch):
    raw = io.BytesIO()
    with tarfile.open(fileobj=raw, mode="w") as t:
        for k in range(5):
            t.addfile(tarfile.TarInfo(f"m{k}"), io.BytesIO())
    monkeypatch.setattr(descent, "MAX_MEMBERS", 3)
    rows = descent.walk("x.tar", raw.getvalue())
    assert len(rows) == 3 and "3 members" in rows[0][-1]


def test_ranges_of_any_length_meet(spark):
    r = random.Random(2)
    span = lambda: (lambda a, n: (a, a + n))(r.randrange(1 << 34), r.choice([0, 1, 5, 64, 1000, 1 << 20, 1 << 33]))
    left, right = [(r.randrange(2), k, *span()) for k in range(150)], [(r.randrange(2), k, *span()) for k in range(150)]
    got = intervals.overlaps(spark.createDataFrame(left, "f long, lid long, a long, b long"), spark.createDataFrame(right, "f long, rid long, a long, b long"), "f", 64)
    told = [(f, x, y, max(a, c), min(b, d)) for f, x, a, b in left for g, y, c, d in right if f == g and max(a, c) < min(b, d)]
    assert sorted(map(tuple, got.collect())) == sorted(told) and told


def test_numbers_follow_any_order(spark):
    rows = [(f"https://h/{k % 17}", k) for k in range(500)] + [(None, -1)]
    got = lookup.numbered(spark.createDataFrame(rows, "url string, k long"), ["url", "k"], "n")
    assert [x["n"] for x in got.orderBy(F.col("url").asc_nulls_first(), "k").collect()] == list(range(501))


def test_trees_of_any_depth(spark):
    members = spark.createDataFrame([(k, k - 1 if k else None, 0, "node" if k < 20 else "unknown") for k in range(15)], "member_id long, parent_id long, ord long, class string")
    assert verdicts.tree_paths(members).count() == 15 and verdicts.ancestors(members).count() == 15 * 14 // 2


def test_groups_without_a_key(spark):
    files = spark.createDataFrame([(None, "a", "0" * 40, False), (None, "b", "1" * 40, False), ("r", "a", "0" * 40, False)], "root string, path string, blob string, executable boolean")
    assert {x["root"] for x in recipes.git_trees(files).collect()} == {None, "r"}


def test_a_table_without_marker_is_refused(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.write_sorted(spark.createDataFrame([("ab",)], "key string"), path, "key", 1)
    with pytest.raises(ValueError, match="to the end"):
        tables.read_keys(spark, path, "key", ["ab"])
    tables.mark(spark, path, "r1", 1)
    assert tables.read_keys(spark, path, "key", ["ab"]).count() == 1


def test_answers_of_live_sources(spark):
    d = "ab" * 20
    many = json.dumps({"results": [{"version": {"versionKey": {"system": "CARGO", "name": f"n{k}", "version": "1"}}} for k in range(12)]})
    places = json.dumps({"result": [{"name": f"f{k}", "path": "/p"} for k in range(7)]})
    rows = [("deps.dev", 200, many), ("deps.dev", 404, None), ("deps.dev", 200, '{"results": []}'), ("deps.dev", 500, "x"), ("circl", 200, '{"message": "no"}'), ("circl", 200, '{"MD5": "AB"}'), ("snapshot", 200, places), ("rekor", 200, '["u"]'), ("rekor", 200, "[]"), ("other", 200, "{}")]
    frame = spark.createDataFrame([(s, "sha1", d, n, b) for s, n, b in rows], "source string, scheme string, digest string, status int, body string")
    got = answers.findings(frame).collect()
    by = lambda s, hit: [x for x in got if x["source"] == s and x["hit"] is hit]
    assert len(got) == 9 and len(by("deps.dev", False)) == 2 and len(by("deps.dev", None)) == 1
    claims = by("deps.dev", True)[0]["claims"]
    assert len(claims) == 11 and claims[0]["statement"] == "cargo: n0@1" and claims[10]["statement"] == "… and 2 more results"
    assert by("circl", True)[0]["claims"][0]["statement"] == "present in hashlookup corpus" and by("circl", True)[0]["coords"][0]["digest"] == "ab" and len(by("circl", False)) == 1
    assert [len(by("snapshot", True)[0]["claims"]), by("rekor", True)[0]["claims"][0]["statement"], len(by("rekor", False))] == [7, "1 signing event in the transparency log", 1]
    asked = {(x["source"], x["url"]) for x in answers.requests(spark.createDataFrame([("sha1", d)], "scheme string, digest string")).collect()}
    assert len(asked) == 5 and ("snapshot", f"https://snapshot.debian.org/mr/file/{d}/info") in asked


def test_sql_of_the_walk_holds_without_its_bound():
    """In the tables of the comparison no query of the walk comes to the bound of findings."""
    from digestlake.plans import catalogue

    con = duckdb.connect()
    con.sql("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    most = con.sql(f"SELECT max(n) FROM (SELECT count(*) AS n FROM ({catalogue.ORACLES['crosswalk_walk']}) GROUP BY query_id)").fetchall()[0][0]
    assert most < identity.MAX_EVIDENCE
