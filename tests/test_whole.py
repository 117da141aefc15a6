"""Queries on small tables with large groups: nothing may be left out."""

import datetime
import gzip
import hashlib
from pathlib import Path

import duckdb

from digestlake.operators import recipes
from digestlake.plans import catalogue
from digestlake.streaming import incremental
from tests.test_lake import ar, archive, cpio


def documents(spark, folder, texts) -> str:
    rows = [(k, f"s{k % 3}", "en", text) for k, text in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, source string, lang string, text string").coalesce(1).write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    return str(folder)


def against_sql(spark, name, folder):
    con = duckdb.connect()
    for path in Path(folder).iterdir():
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}/*.parquet'")
    df, told = catalogue.QUERIES[name](spark, folder), con.sql(catalogue.ORACLES[name])
    at = [told.columns.index(c) for c in df.columns]
    found = sorted(map(tuple, df.collect()))
    assert found == sorted(tuple(r[k] for k in at) for r in told.fetchall())
    return [dict(zip(df.columns, r)) for r in found]


def sharing(prefix: str, n: int) -> list[str]:
    """n texts whose md5 starts with the prefix."""
    found, k = [], 0
    while len(found) < n:
        if hashlib.md5(f"text {k}".encode()).hexdigest().startswith(prefix):
            found.append(f"text {k}")
        k += 1
    return found


def test_weak_collisions_beyond_a_thousand_copies(spark, tmp_path):
    a, b, c = sharing("abc", 3)
    rows = against_sql(spark, "weak_collisions", documents(spark, tmp_path, [a] * 1_001 + [b, c, "other"]))
    assert ("abc", 3, True) in [(r["weak"], r["clusters"], r["collision"]) for r in rows]


def test_identity_clusters_beyond_a_thousand_copies(spark, tmp_path):
    rows = against_sql(spark, "identity_clusters", documents(spark, tmp_path, ["one", *["many"] * 1_200, "one", "alone"]))
    assert sorted({r["findings"] for r in rows}) == [1, 2, 1_200] and len(rows) == 1_203


def test_crosswalk_walks_from_every_digest_to_the_last_hop(spark, tmp_path):
    a, b, c = sharing("abc", 3)
    rows = against_sql(spark, "crosswalk_walk_all", documents(spark, tmp_path, [a, b, "x", c, c]))
    assert {r["query_id"] for r in rows} == {0, 1, 3} and {"query_id": 1, "finding_id": 14, "hop": 4} in rows


def test_point_lookup_of_every_digest(spark, tmp_path):
    folder = documents(spark, tmp_path, ["one", "two", "three", "two", "two"])
    spark.createDataFrame([("two",), ("absent",)], "html string").coalesce(1).write.parquet(f"{folder}/pages.parquet")
    rows = against_sql(spark, "point_lookup_capped", folder)
    assert {(r["doc_id"], r["pos"], r["total"]) for r in rows} == {(0, 1, 1), (1, 1, 3), (2, 1, 1), (3, 2, 3)}


def test_recipes_of_containers_in_containers():
    held, other = bytes(range(256)) * 40, b"not held " * 90
    inner = gzip.compress(archive({"held": held, "other": other}), 6, mtime=0)
    data = archive({"first": other, "a.tar.gz": inner, "deb": ar({"x.cpio": cpio({"held": held, "other": other})}), "again.tar.gz": inner, "held.gz": gzip.compress(held, 9, mtime=0)})
    digest = hashlib.sha256(held).hexdigest()
    recipe, residue = recipes.mint(data, "x.tar", {digest: "u"})
    assert [r["sha256"] for r in recipes.refs_of(recipe)] == [digest] * 4
    assert recipes.rebuilt(recipe, {digest: held}, residue) == data
    nothing, rest = recipes.mint(data, "x.tar", {})
    assert nothing["kind"] == "splice" and not list(recipes.refs_of(nothing)) and rest == data


def test_believed_misses_are_counted(spark, tmp_path):
    day = datetime.datetime(2024, 1, 1)
    schema = "backend string, coordinate string, hit boolean, fetched_at timestamp"
    rows = [("b", f"c{k % 5_000}", False, day) for k in range(6_000)] + [("b", "hit", True, day), ("b", None, False, day), ("b", "late", False, day + datetime.timedelta(days=30))]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = incremental.believed_misses(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination(60)
    assert [(r["backend"], r["misses"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [("b", 5_000)]
