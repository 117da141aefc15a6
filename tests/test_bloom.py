import hashlib

import pytest

from digestlake.functions import bloom


def keys(spark, names):
    return spark.createDataFrame([(n,) for n in names], "key string")


def test_golden_file(spark):
    names = ["A9993E364706816ABA3E25717850C26C9CD0D89D", "DA39A3EE5E6B4B0D3255BFEF95601890AFD80709", "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"]
    m, k = bloom.size_for(100, 0.01)
    data = bloom.file_bytes(bloom.build(keys(spark, names), "key", k, m), 100, 0.01, k, m, 3)
    assert hashlib.sha256(data).hexdigest() == "593635f214df50af3fe42b41b3c86fa6ca6c79c312a66818ed748435982bc6ae"
    assert bloom.parsed(data)["n_elements"] == 3
    for broken in (data[:40], data[:-8], b"\2" + data[1:]):
        with pytest.raises(ValueError):
            bloom.parsed(broken)


def test_fold_keeps_members_and_joins_find_them(spark, monkeypatch):
    m, k = bloom.size_for(1000, 0.01)
    assert m == 9586
    members = keys(spark, [f"MEMBER{i:04}" for i in range(1000)])
    half = bloom.folded(bloom.build(members, "key", k, m), m)
    asked = members.unionByName(keys(spark, [f"ABSENT{i:05}" for i in range(2000)]))
    count = lambda: {r["key"][:6]: r["n"] for r in bloom.probed(asked, "key", half, k, m // 2).where("hit").groupBy("key").count().selectExpr("substr(key, 1, 6) AS key").groupBy("key").count().withColumnRenamed("count", "n").collect()}
    by_broadcast = count()
    assert by_broadcast["MEMBER"] == 1000 and 0 < by_broadcast["ABSENT"] < 1000
    monkeypatch.setattr(bloom, "BROADCAST_BYTES", 1)
    assert count() == by_broadcast
    with pytest.raises(ValueError):
        bloom.folded(half, m // 2)
