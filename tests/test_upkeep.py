"""Tables published, listed and dropped; filters from lists; updates of both vendors; entries that cannot be read; checksums by table."""

import io
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from digestlake.functions import bloom, digests
from digestlake.operators import etl, observations
from digestlake.sources import descent, tables


def written(spark, path, n, complete=True):
    spark.range(n).write.parquet(path)
    if complete:
        tables.mark(spark, path, f"r{n}", 1)


def test_published_listed_and_dropped(spark, tmp_path):
    root = str(tmp_path / "tables")
    assert tables.listed(spark, root) == []
    written(spark, f"{root}/a", 3)
    written(spark, f"{root}/b", 5)
    written(spark, f"{root}/half", 2, complete=False)
    assert [(f["name"], f["revision"]) for f in tables.listed(spark, root)] == [("a", "r3"), ("b", "r5"), ("half", None)]
    with pytest.raises(ValueError):
        tables.published(spark, f"{root}/half", f"{root}/a")
    assert tables.opened(spark, f"{root}/a").count() == 3
    tables.published(spark, f"{root}/b", f"{root}/a")
    tables.published(spark, f"{root}/a", f"{root}/c")
    assert tables.opened(spark, f"{root}/c").count() == 5
    assert [f["name"] for f in tables.listed(spark, root)] == ["c", "half"]
    assert all(f["files"] and f["bytes"] for f in tables.listed(spark, root))
    assert tables.dropped(spark, root, "half") and not tables.dropped(spark, root, "half")
    for name in ("", "../c", ".c"):
        with pytest.raises(ValueError):
            tables.dropped(spark, root, name)


def test_filters_from_lists(spark, tmp_path):
    lines = ["%064x" % k for k in range(300)]
    (tmp_path / "one").write_text("\n".join(lines[:200]).upper() + "\n\n")
    (tmp_path / "two").write_text("\n".join(" " + x + "\t" for x in lines[199:]))
    data = bloom.from_lists(spark, [str(tmp_path / "one"), str(tmp_path / "two")], "sha256", 0.001)
    found = bloom.parsed(data)
    assert found["n"] == found["n_elements"] == 301
    at = bloom.positions([x.encode() for x in lines], found["k"], found["m"])
    assert ((found["words"][at >> 6] >> (at & 63).astype("u8")) & 1).all()
    (tmp_path / "three").write_text("abc\n")
    with pytest.raises(Exception, match="not a digest of sha256: abc"):
        bloom.from_lists(spark, [str(tmp_path / "three")], "sha256", 0.001)
    (tmp_path / "four").write_text("\n")
    for path, scheme in (("four", "sha256"), ("one", "sha512")):
        with pytest.raises(ValueError):
            bloom.from_lists(spark, [str(tmp_path / path)], scheme, 0.001)


def test_installed_filters_smallest_first(spark, tmp_path):
    assert bloom.installed(spark, str(tmp_path / "none")) == []
    for name, n in (("big", 5000), ("small", 10)):
        m, k = bloom.size_for(n, 0.01)
        words = bloom.build(spark.range(n).select(F.sha1(F.col("id").cast("string")).alias("key")), "key", k, m)
        (tmp_path / f"{name}.sha1.bloom").write_bytes(bloom.file_bytes(words, n, 0.01, k, m, n + 1))
    (tmp_path / "notes.txt").write_text("no filter")
    found = bloom.installed(spark, str(tmp_path))
    assert [(f["name"], f["scheme"], f["n"], f["n_elements"]) for f in found] == [("small", "sha1", 10, 11), ("big", "sha1", 5000, 5001)]
    (tmp_path / "cut.md5.bloom").write_bytes(b"abc")
    with pytest.raises(ValueError, match="too short"):
        bloom.installed(spark, str(tmp_path))


def test_updates_of_both_vendors():
    section = lambda kind, n: struct.pack("<II", kind, n) + b"x" * n
    one = b"DMA\0" + section(0, 32) + section(1, 100)
    two = b"DMA\0" + section(0, 16)
    assert [p for _, p in descent.microcode_parts(one + two)] == [one, two]
    for bad in (one[:-1], one + b"abc", b"DMA\0" + section(2, 8), one + two + section(1, 4)[:-2], b""):
        assert descent.microcode_parts(bad) == []
    head = lambda body, total, flags=1, date=0x06152019: struct.pack("<9I", 1, 7, date, 0x650, 0, 1, flags, body, total)
    old, new = head(0, 0).ljust(2048, b"o"), head(3000, 4096).ljust(4096, b"n")
    assert [p for _, p in descent.microcode_parts(old + new)] == [old, new]
    for bad in (head(4096, 4096).ljust(4096), head(0, 3000).ljust(3000), head(0, 0, 256).ljust(2048), head(0, 0, 1, 0x13152019).ljust(2048), head(0, 0, 1, 0x06152100).ljust(2048)):
        assert descent.microcode_parts(bad) == []


def test_entry_that_cannot_be_read_says_why():
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        z.writestr("good", b"a" * 100)
        z.writestr("bad", b"b" * 100)
    data = packed.getvalue().replace(b"b" * 100, b"c" * 100)
    names = [c.split()[0] for c in descent.SCHEMA.split(", ")]
    rows = [dict(zip(names, r, strict=True)) for r in descent.walk("z", data)]
    assert [(r["path"], r["size"]) for r in rows] == [("z", len(data)), ("z!good", 100), ("z!bad", None)]
    assert rows[2]["sha256"] is None and "CRC" in rows[2]["note"] and rows[1]["note"] is None


def test_checksum_by_table(spark):
    table = [(k * 2654435761 + 12345) % 2**32 for k in range(256)]

    def told(content):
        first = second = 0
        for byte in content:
            first = (first + table[byte]) % 2**32
            second = (second + first) % 2**32
        return struct.pack("<II", first, second).hex()

    contents = [b"", b"a", bytes(range(256)) * 5000, None]
    rows = spark.createDataFrame([(k, c) for k, c in enumerate(contents)], "id int, content binary")
    found = {r["id"]: r["c"] for r in rows.select("id", digests.table_checksum(F.col("content"), table).alias("c")).collect()}
    assert found == {k: None if c is None else told(c) for k, c in enumerate(contents)}
    with pytest.raises(ValueError):
        digests.table_checksum(F.col("content"), table[:255])


def test_counts_of_an_empty_index_and_orc_columns(spark, tmp_path):
    assert observations.stats(spark.createDataFrame([], "path string, size long")).collect() == [(0, 0)]
    assert etl.counters(spark.createDataFrame([(1,), (None,)], "a int"), {"one": F.col("a") == 1}).collect() == [(2, 1)]
    spark.range(4).select(F.col("id").alias("a"), F.sha1(F.col("id").cast("string")).alias("sha1")).write.orc(str(tmp_path / "o"))
    columns = tables.columns_of(spark, str(tmp_path / "o"), "sha1")
    assert columns.columns == ["sha1"] and columns.distinct().count() == 4
