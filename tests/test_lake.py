"""Identity, verdicts, descent, recipes, tables, streams: cases with known answers."""

import gzip
import hashlib
import io
import lzma
import struct
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from digestlake.operators import identity, intervals, observations, recipes, verdicts
from digestlake.sources import binaries, descent, tables
from digestlake.streaming import incremental

A, B, M = "a" * 64, "b" * 64, "c" * 32


def findings(spark, *rows):
    return spark.createDataFrame([(n, [{"scheme": s, "digest": d} for s, d in cs]) for n, cs in rows], "finding_id long, coords array<struct<scheme:string,digest:string>>")


def resolve(spark, rows, scheme, digest):
    known = findings(spark, *rows)
    asked = spark.createDataFrame([(1, scheme, digest)], "query_id long, scheme string, digest string")
    evidence = identity.walk(asked, known)
    found = identity.clusters(evidence, known, asked)
    return found.orderBy("cluster").collect(), identity.statuses(found, evidence, asked).first()


def test_weak_ambiguity(spark):
    found, status = resolve(spark, [(1, [("md5", M), ("sha256", A)]), (2, [("md5", M), ("sha256", B)])], "md5", M)
    assert len(found) == 2 and all(c["primary"] and c["anchored"] for c in found) and status["collision"]


def test_crosswalk_reaches_a_second_witness(spark):
    found, status = resolve(spark, [(1, [("sha1_git", "d" * 40), ("sha256", A)]), (2, [("sha256", A), ("md5", M)])], "sha1_git", "d" * 40)
    assert [c["finding_ids"] for c in found] == [[1, 2]] and not status["collision"]


def test_contradicted_answer_is_not_primary(spark):
    known = findings(spark, (1, [("sha256", B), ("sha1", "e" * 40)]))
    asked = spark.createDataFrame([(1, "sha256", A)], "query_id long, scheme string, digest string")
    evidence = spark.createDataFrame([(1, 0, "sha256", A, 1)], "query_id long, hop long, scheme string, digest string, finding_id long")
    found = identity.clusters(evidence, known, asked).first()
    assert not found["primary"] and (("sha256", A) not in [(c["scheme"], c["digest"]) for c in found["coords"]])


def test_answer_without_coordinates_joins_the_query(spark):
    known = findings(spark, (1, [("sha256", A)]), (2, []))
    asked = spark.createDataFrame([(1, "sha256", A)], "query_id long, scheme string, digest string")
    evidence = spark.createDataFrame([(1, 0, "sha256", A, 1), (1, 0, "sha256", A, 2)], "query_id long, hop long, scheme string, digest string, finding_id long")
    assert [c["finding_ids"] for c in identity.clusters(evidence, known, asked).collect()] == [[1, 2]]


def archive(files: dict, mode: str = "w") -> bytes:
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode=mode, format=tarfile.USTAR_FORMAT) as t:
        for name, body in files.items():
            info = tarfile.TarInfo(name)
            info.size = len(body)
            t.addfile(info, io.BytesIO(body))
    return out.getvalue()


def cpio(files: dict) -> bytes:
    out = b""
    for name, body in [*files.items(), ("TRAILER!!!", b"")]:
        head = b"070701" + b"".join(b"%08X" % v for v in (1, 0o100644, 0, 0, 1, 0, len(body), 0, 0, 0, 0, len(name) + 1, 0)) + name.encode() + b"\0"
        head += b"\0" * (-len(head) % 4)
        out += head + body + b"\0" * (-len(body) % 4)
    return out


def ar(files: dict) -> bytes:
    out = b"!<arch>\n"
    for name, body in files.items():
        out += f"{name + '/':<16}{0:<12}{0:<6}{0:<6}{'100644':<8}{len(body):<10}`\n".encode() + body + b"\n" * (len(body) % 2)
    return out


def rpm(files: dict) -> bytes:
    header = b"\x8e\xad\xe8\1" + bytes(4) + struct.pack(">II", 0, 0)
    return b"\xed\xab\xee\xdb" + bytes(92) + header * 2 + gzip.compress(cpio(files))


def microcode(size: int, signature: int) -> bytes:
    return struct.pack("<9I", 1, 7, 0x01022020, signature, 0, 1, 0, size - 48, size) + bytes(size - 36)


def leaves(data: bytes, name: str, policy: str = "full") -> dict:
    rows = descent.walk(name, data, policy)
    inner = {r[2] for r in rows}
    return {r[5]: r[10] for r in rows if r[1] not in inner and r[4]}


def test_containers():
    files = {"a.txt": b"hello " * 20, "d/b.txt": b"world"}
    sha = {k: hashlib.sha256(v).hexdigest() for k, v in files.items()}
    tar = archive(files)
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as out:
        for k, v in files.items():
            out.writestr(k, v)
    flat = {"a.txt": files["a.txt"], "b": b"xyz"}
    assert set(leaves(tar, "x.tar").values()) == set(sha.values()) == set(leaves(z.getvalue(), "x.zip").values())
    assert set(leaves(gzip.compress(tar), "x.tgz")) == {f"x.tgz!x.tar!{k}" for k in files}
    assert set(leaves(lzma.compress(tar), "x.tar.xz").values()) == set(sha.values())
    assert set(leaves(ar(flat), "x.a")) == {"x.a!a.txt", "x.a!b"} and set(leaves(cpio(flat), "x.cpio")) == {"x.cpio!a.txt", "x.cpio!b"}
    assert set(leaves(rpm(flat), "x.rpm")) == {"x.rpm!payload!payload~unpacked!a.txt", "x.rpm!payload!payload~unpacked!b"}
    assert "x.img!segment-2" in {r[5] for r in descent.walk("x.img", cpio(flat) + bytes(512) + gzip.compress(b"more"), "full")}
    assert len(leaves(microcode(2048, 0x650) + microcode(4096, 0x651), "ucode")) == 2 and not leaves(microcode(2048, 0x650) + b"\xff" * 300, "ucode")
    assert leaves(tar, "x.tar", "cheap") == {} and len(leaves(z.getvalue(), "x.zip", "cheap")) == 2 and leaves(z.getvalue(), "x.zip", "none") == {}
    broken = descent.walk("x.gz", gzip.compress(tar)[:-20], "full")
    assert len(broken) == 1 and broken[0][-1]


def test_fat_image():
    image = bytearray(64 * 512)
    image[0:3] = b"\xeb\x3c\x90"
    struct.pack_into("<HBHBHHBH", image, 11, 512, 1, 1, 1, 16, 64, 0xF8, 1)
    image[54:59] = b"FAT12"
    image[510:512] = b"\x55\xaa"
    image[512:518] = bytes([0xF8, 0xFF, 0xFF, 0xFF, 0x0F, 0])
    image[1024:1056] = b"HELLO   TXT" + bytes(15) + struct.pack("<HI", 2, 5)
    image[1536:1541] = b"hello"
    assert leaves(bytes(image), "disk.img") == {"disk.img!HELLO.TXT": hashlib.sha256(b"hello").hexdigest()}


def test_iso_image():
    def record(name: bytes, lba: int, size: int, flags: int) -> bytes:
        body = bytearray(33 + len(name) + (1 - len(name) % 2))
        body[0], body[25], body[32] = len(body), flags, len(name)
        struct.pack_into("<I", body, 2, lba)
        struct.pack_into("<I", body, 10, size)
        body[33 : 33 + len(name)] = name
        return bytes(body)

    image = bytearray(20 * 2048)
    image[16 * 2048 : 16 * 2048 + 7] = b"\1CD001\1"
    struct.pack_into("<H", image, 16 * 2048 + 128, 2048)
    image[16 * 2048 + 156 : 16 * 2048 + 156 + 34] = record(b"\0", 18, 2048, 2)
    image[17 * 2048 : 17 * 2048 + 6] = b"\xffCD001"
    listing = record(b"\0", 18, 2048, 2) + record(b"\1", 18, 2048, 2) + record(b"A.TXT;1", 19, 5, 0)
    image[18 * 2048 : 18 * 2048 + len(listing)] = listing
    image[19 * 2048 : 19 * 2048 + 5] = b"hello"
    assert leaves(bytes(image), "x.iso") == {"x.iso!A.TXT": hashlib.sha256(b"hello").hexdigest()}


@pytest.mark.parametrize("wrapped", [False, True])
def test_recipe_round_trip(wrapped):
    files = {f"f{k}": bytes([k]) * 100 * (k + 1) for k in range(5)}
    data = gzip.compress(archive(files), 6, mtime=0) if wrapped else archive(files)
    claimed = {hashlib.sha256(v).hexdigest(): "u" for v in list(files.values())[:3]}
    recipe, residue = recipes.mint(data, "x.tar.gz" if wrapped else "x.tar", claimed)
    blobs = {hashlib.sha256(v).hexdigest(): v for v in files.values()}
    assert recipes.rebuilt(recipe, blobs, residue) == data and len(list(recipes.refs_of(recipe))) == 3
    with pytest.raises(KeyError):
        recipes.rebuilt(recipe, {}, residue)
    with pytest.raises(ValueError):
        recipes.rebuilt(recipe, blobs, residue[:-1] + b"?")
    whole, rest = recipes.mint(data, "x", {hashlib.sha256(data).hexdigest(): "u"})
    assert whole["kind"] == "ref" and not rest


def test_git_tree(spark):
    rows = [("one", "hi.txt", "45b983be36b73c0788dc9cbcb76cbb80fc7bb057", False)]
    got = recipes.git_trees(spark.createDataFrame(rows, "root string, path string, blob string, executable boolean")).first()
    assert got["tree"] == "b0e66a8a93b83161375f18dcdc9e9329af61e04f"


def test_sorted_table_is_pruned(spark, tmp_path):
    rows = spark.range(500).select(F.sha2(F.col("id").cast("string"), 256).alias("sha256"), "id").union(spark.sql("SELECT CAST(NULL AS STRING), 500L"))
    path = str(tmp_path / "t")
    assert tables.revision(spark, path) is None
    tables.write_sorted(rows, path, "sha256")
    tables.mark(spark, path, "r1", 17)
    key = hashlib.sha256(b"7").hexdigest()
    found = tables.read_keys(spark, path, "sha256", [key])
    assert [r["id"] for r in found.collect()] == [7] and tables.revision(spark, path) == "r1"
    plan = found._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and f"sha256,{key[:16]}" in plan.split("PushedFilters")[-1]
    wanted = spark.createDataFrame([(key,)], "sha256 string")
    assert tables.join_keys(spark.read.parquet(path), wanted, "sha256").count() == 1


def test_rescan_and_replay(spark):
    state = spark.createDataFrame([("a", 1, 1), ("b", 2, 1), ("gone", 3, 1)], "path string, size long, mtime long")
    seen = spark.createDataFrame([("a", 1, 1), ("b", 2, 9), ("new", 5, 1), ("empty", 0, 1)], "path string, size long, mtime long")
    actions = {r["path"]: r["action"] for r in observations.rescanned(seen, state).collect()}
    assert actions == {"a": "reuse", "b": "hash", "new": "hash"}
    assert set(r["action"] for r in observations.rescanned(seen, state, rehash=True).collect()) == {"hash"}
    assert [r["path"] for r in observations.stale(state, seen).collect()] == ["gone"] and observations.stale(state, seen, complete=False).count() == 0
    done = spark.createDataFrame([("x", "full", 2, 1), ("y", "full", 2, 1), ("z", "full", 1, 0)], "csha256 string, descent string, members long, schema_version int")
    members = spark.createDataFrame([("x", "full", 0), ("x", "full", 1), ("y", "full", 0), ("z", "full", 0)], "csha256 string, descent string, idx long")
    assert [r["csha256"] for r in observations.replayable(done, members, 1).collect()] == ["x"]


def test_verdict_tiers(spark):
    files = spark.createDataFrame([(1, "s1", "h1"), (2, "s2", "h2"), (3, "s3", "h3")], "file_id long, sha1 string, sha256 string")
    rows = spark.createDataFrame([(1, None, "h1"), (2, "s2", None), (3, "s2", "other"), (4, "s3", "other")], "row_id long, sha1 string, sha256 string")
    got = {r["file_id"]: (r["identified"], r["consistent"]) for r in verdicts.tiers(files, rows).collect()}
    assert got == {1: (1, 0), 2: (0, 1), 3: (0, 0)}


def test_admission_is_greedy(spark):
    rows = spark.createDataFrame([("k", 1, 0, 10), ("k", 2, 5, 15), ("k", 3, 10, 20), ("k", 4, 3, 3), ("q", 1, 5, 15)], "key string, turn int, a long, b long")
    got = {(r["key"], r["turn"]): r["accepted"] for r in intervals.admitted(rows, "key").collect()}
    assert got == {("k", 1): True, ("k", 2): False, ("k", 3): True, ("k", 4): False, ("q", 1): True}


def test_stream_of_files(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a").write_bytes(b"hello")
    (folder / "empty").write_bytes(b"")
    run = lambda: incremental.into_state(incremental.arriving_files(spark, str(folder)), str(tmp_path / "state"), str(tmp_path / "check")).awaitTermination()
    run()
    (folder / "b").write_bytes(b"more")
    run()
    got = {r["path"][-1]: r["sha256"] for r in incremental.current(spark, str(tmp_path / "state")).collect()}
    assert got == {"a": hashlib.sha256(b"hello").hexdigest(), "b": hashlib.sha256(b"more").hexdigest()}


def rpm_with_header(names, digests) -> bytes:
    lists = {1118: (8, ["/usr/", "/etc/"]), 1117: (8, names), 1035: (8, digests), 1116: (4, [k % 2 for k in range(len(names))]), 5011: (4, [8])}
    index, store = b"", b""
    for tag, (kind, values) in lists.items():
        store += bytes(-len(store) % 4)
        index += struct.pack(">4I", tag, kind, len(store), len(values))
        store += b"".join(v.encode() + b"\0" for v in values) if kind == 8 else struct.pack(f">{len(values)}I", *values)
    empty = b"\x8e\xad\xe8\1" + bytes(4) + struct.pack(">II", 0, 0)
    return b"\xed\xab\xee\xdb" + bytes(92) + empty + b"\x8e\xad\xe8\1" + bytes(4) + struct.pack(">II", len(lists), len(store)) + index + store


def test_binary_metadata(spark):
    good = rpm_with_header(["a", "b", "d"], [A.upper(), B, ""])
    field = lambda n, v: bytes([n << 3 | 2, len(v)]) + v if isinstance(v, bytes) else bytes([n << 3, v])
    mapping = field(1, b"bin/x.dll\0") + field(2, 9) + field(5, bytes(range(20)))
    body = field(1, mapping) + field(1, field(1, b"folder") + field(2, 0) + field(5, bytes(20)))
    manifest = struct.pack("<II", binaries.MAPPINGS_MAGIC, len(body)) + body
    files = spark.createDataFrame([("x.rpm", good), ("y.rpm", rpm_with_header(["a"], [A, B])), ("z.rpm", b"?" * 200)], "path string, content binary")
    got = {(r["source"], r["path"], r["scheme"], r["digest"]) for r in binaries.stated_files(files, binaries.rpm_files).collect()}
    assert got == {("x.rpm", "/usr/a", "sha256", A), ("x.rpm", "/etc/b", "sha256", B), ("y.rpm", None, None, None), ("z.rpm", None, None, None)}
    assert binaries.manifest_files(manifest) == [("bin/x.dll", 9, bytes(range(20)).hex())]
