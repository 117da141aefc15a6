from pyspark.sql import functions as F

from digestlake.functions import claims, digests

ABC = {
    "md5": "900150983cd24fb0d6963f7d28e17f72",
    "sha1": "a9993e364706816aba3e25717850c26c9cd0d89d",
    "sha256": "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad",
    "sha1_git": "f2ba8f84ab5c1bce84a7b441cb1959cfc7093b7f",
    "blake2s256": "508c5e8c327c14e2e1a72ba34eeb452f37458b209ed63a294d999b4c86675982",
}


def test_six_schemes(spark):
    made = spark.createDataFrame([(b"abc",)], "c binary").select(*[v.alias(k) for k, v in digests.digest_columns(F.col("c")).items()]).first()
    assert {k: made[k] for k in ABC} == ABC
    assert len(made["sha512"]) == 128


def test_parse_forms_and_rejects(spark):
    cases = {
        " sha256:" + ABC["sha256"].upper(): ("sha256", ABC["sha256"]),
        "sha-1:" + ABC["sha1"]: ("sha1", ABC["sha1"]),
        "swh:1:cnt:" + ABC["sha1_git"]: ("sha1_git", ABC["sha1_git"]),
        "VGMT4NSHA2AWVOR6EVYXQUGCNSONBWE5": ("sha1", ABC["sha1"]),
        "sha256-ungWv48Bz+pBQUDeXa4iI7ADYaOWF3qctBD/YfIAFa0=": ("sha256", ABC["sha256"]),
        ABC["md5"]: ("md5", ABC["md5"]),
        "blake2s:" + ABC["blake2s256"]: ("blake2s256", ABC["blake2s256"]),
        "crc32:00": (None, None), "sha1:00": (None, None), "zz": (None, None), "": (None, None), "abc": (None, None),
    }
    rows = spark.createDataFrame([(k,) for k in cases], "t string").withColumn("c", digests.parse_coord(F.col("t"))).collect()
    for r in rows:
        assert (r["c"]["scheme"], r["c"]["digest"]) == cases[r["t"]], r
        assert (r["c"]["error"] is None) == (r["c"]["scheme"] is not None)


def test_claims(spark):
    row = spark.createDataFrame([("the%20fox%20%281%29%zz%", "fedora-core-4-updates", "rpmfusion-nonfree", "x")], "p string, a string, b string, c string")
    got = row.select(
        claims.percent_decoded(F.col("p")).alias("p"), claims.witness_display(F.col("a"))["human"].alias("a"), claims.witness_display(F.col("b"))["human"].alias("b"), claims.witness_display(F.col("c"))["human"].alias("c"),
        claims.census(F.lit("i"), F.col("p")).alias("told"), claims.human_size(F.lit(1536)).alias("s"), claims.evr(F.lit("0"), F.lit("1"), F.lit("2")).alias("e"), claims.evr(F.lit("3"), F.lit("1"), F.lit("2")).alias("e3"),
    ).first()
    assert got["p"] == "the fox (1)%zz%" and got["a"] == "Fedora Core 4 updates" and got["b"] == "RPM Fusion nonfree" and got["c"] == "x"
    assert got["told"]["url"] == "https://archive.org/download/i/the%20fox%20%281%29%zz%"
    assert (got["s"], got["e"], got["e3"]) == ("1.5 KiB", "1-2", "3:1-2")
