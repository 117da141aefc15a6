"""Containers as trees of members: what each archive or filesystem image holds, at any depth, with digests.

A parser turns bytes into (name, bytes) members; errors in one container become a note on it and end only its
own walk. One root is walked by one task, so that a lost executor repeats whole roots.
"""

import bz2
import gzip
import hashlib
import io
import lzma
import struct
import tarfile
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: How deep containers are entered, and how many members one root may have.
MAX_DEPTH, MAX_MEMBERS = 16, 1_000_000
SCHEMA = "root string, member_id long, parent_id long, ord long, depth int, path string, kind string, size long, md5 string, sha1 string, sha256 string, sha1_git string, sha512 string, blake2s256 string, note string"
WRAPPERS = ("gzip", "xz", "zstd", "bzip2")
#: What a cheap walk enters: formats with a table of contents. A full one enters all that has a parser.
CHEAP = ("zip", "iso9660", "fat")
Members = Iterator[tuple[str, bytes]]


class Unreadable(bytes):
    """Stands for the content of a member that is listed but cannot be read, for a stated reason."""

    why = ""


def sniffed(data: bytes, name: str) -> str:
    starts = [(b"!<arch>\n", "ar"), (b"\x1f\x8b", "gzip"), (b"\xfd7zXZ\0", "xz"), (b"\x28\xb5\x2f\xfd", "zstd"), (b"PK\3\4", "zip"), (b"\xed\xab\xee\xdb", "rpm"), (b"070701", "cpio"), (b"070702", "cpio")]
    for magic, kind in starts:
        if data.startswith(magic):
            return kind
    if data[:3] == b"BZh" and data[3:4].isdigit():
        return "bzip2"
    for offset, magic, kind in ((257, b"ustar", "tar"), (0, b"hsqs", "squashfs"), (0, b"7z\xbc\xaf\x27\x1c", "7z"), (1024, b"\xe2\xe1\xf5\xe0", "erofs"), (32769, b"CD001", "iso9660")):
        if data[offset : offset + len(magic)] == magic:
            return kind
    return "fat" if boot_sector(data) else "microcode" if microcode_parts(data) else "file"


def boot_sector(data: bytes) -> bool:
    if len(data) < 512 or data[510:512] != b"\x55\xaa" or data[0] not in (0xEB, 0xE9):
        return False
    sector, per_cluster, reserved = struct.unpack_from("<HBH", data, 11)
    sane = sector in (512, 1024, 2048, 4096) and per_cluster in (1, 2, 4, 8, 16, 32, 64, 128) and reserved and data[16] in (1, 2) and data[21] >= 0xF0
    return bool(sane) and b"FAT" in (data[54:57], data[82:85])


def unwrap(data: bytes, kind: str) -> bytes:
    if kind == "zstd":
        import zstandard

        return zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read()
    return {"gzip": gzip.decompress, "xz": lzma.decompress, "bzip2": bz2.decompress}[kind](data)


def unwrapped(name: str, kind: str) -> str:
    from digestlake.functions.containers import UNWRAPPED

    for suffix, instead in UNWRAPPED[kind]:
        if name.lower().endswith(suffix):
            return name[: -len(suffix)] + instead
    return name + "~unpacked"


def tar_members(data: bytes) -> Members:
    with tarfile.open(fileobj=io.BytesIO(data)) as t:
        for m in t:
            if m.isreg():
                yield m.name, t.extractfile(m).read()


def zip_members(data: bytes) -> Members:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for m in z.infolist():
            if not m.is_dir():
                try:
                    yield m.filename, z.read(m)
                except Exception as error:  # an entry that cannot be read is there all the same
                    nothing = Unreadable()
                    nothing.why = f"{type(error).__name__}: {error}"
                    yield m.filename, nothing


def ar_members(data: bytes) -> Members:
    at, long_names = 8, b""
    while at + 60 <= len(data):
        name, size = data[at : at + 16].rstrip(), int(data[at + 48 : at + 58])
        body = data[at + 60 : at + 60 + size]
        if len(body) < size:
            raise ValueError("truncated ar member")
        at += 60 + size + size % 2
        if name == b"//":
            long_names = body
        elif name.startswith(b"#1/"):
            n = int(name[3:])
            yield body[:n].rstrip(b"\0").decode(errors="replace"), body[n:]
        elif name not in (b"/", b"/SYM64/"):
            if name[:1] == b"/" and name[1:].isdigit():
                name = long_names[int(name[1:]) :].split(b"\n")[0]
            yield name.rstrip(b"/").decode(errors="replace"), body


def rpm_payload(data: bytes) -> int:
    """Where the payload starts: after the lead and two headers, of which the first is padded to eight bytes."""
    at = 96
    for padded in (True, False):
        if data[at : at + 3] != b"\x8e\xad\xe8":
            raise ValueError("no rpm header")
        entries, size = struct.unpack_from(">II", data, at + 8)
        at += 16 + 16 * entries + size
        at += -at % 8 if padded else 0
    return at


def cpio_members(data: bytes) -> Members:
    """Of the new ASCII format. What follows the trailer, zero padding left out, is a member of its own."""
    at = 0
    while at + 110 <= len(data):
        if data[at : at + 6] not in (b"070701", b"070702"):
            raise ValueError("no cpio header")
        field = lambda k: int(data[at + 6 + 8 * k : at + 14 + 8 * k], 16)
        mode, size, n = field(1), field(6), field(11)
        name = data[at + 110 : at + 110 + n - 1].decode(errors="replace")
        begin = at + 110 + n
        begin += -begin % 4
        at = begin + size
        at += -at % 4
        if name == "TRAILER!!!":
            rest = data[at:].lstrip(b"\0")
            if rest:
                yield "segment-2", rest
            return
        if mode & 0o170000 == 0o100000:
            yield name, data[begin : begin + size]
    raise ValueError("cpio without trailer")


def iso_members(data: bytes) -> Members:
    """ISO 9660 with Rock Ridge names; files in several extents are put together; El Torito images are members too."""
    volume, catalog = None, None
    for sector in range(16, 64):
        d = data[sector * 2048 : sector * 2048 + 2048]
        if d[1:6] != b"CD001" or d[0] == 255:
            break
        if d[0] == 1 and volume is None:
            volume = d
        if d[0] == 0 and d[7:30] == b"EL TORITO SPECIFICATION":
            catalog = struct.unpack_from("<I", d, 71)[0]
    if volume is None:
        raise ValueError("no primary volume")
    block = struct.unpack_from("<H", volume, 128)[0]
    seen = set()

    def walk(lba: int, size: int, prefix: str, depth: int) -> Members:
        if lba in seen or depth > 32:
            return
        seen.add(lba)
        raw, at, parts = data[lba * block : lba * block + size], 0, b""
        while at < len(raw):
            n = raw[at]
            if n == 0:
                at += -at % block or block
                continue
            record = raw[at : at + n]
            at += n
            extent, length = struct.unpack_from("<I", record, 2)[0], struct.unpack_from("<I", record, 10)[0]
            flags, ident = record[25], record[33 : 33 + record[32]]
            if ident in (b"\0", b"\1"):
                continue
            name = rock_ridge(record) or ident.split(b";")[0].rstrip(b".").decode(errors="replace")
            if flags & 2:
                yield from walk(extent, length, f"{prefix}{name}/", depth + 1)
                continue
            parts += data[extent * block : extent * block + length]
            if not flags & 0x80:
                yield prefix + name, parts
                parts = b""

    yield from walk(*struct.unpack_from("<I4xI", volume, 158), "", 0)
    if catalog is not None:
        entries = data[catalog * 2048 : catalog * 2048 + 2048]
        for k in range(1, 64):
            e = entries[32 * k : 32 * k + 32]
            if len(e) < 32 or e[0] not in (0x88, 0x90, 0x91):
                break
            if e[0] == 0x88:
                count, lba = struct.unpack_from("<HI", e, 6)
                yield f"[boot]/image-{k}", data[lba * 2048 : lba * 2048 + max(count, 1) * 512]


def rock_ridge(record: bytes) -> str:
    at = 33 + record[32] + (1 - record[32] % 2)
    name = b""
    while at + 4 <= len(record) and record[at + 2]:
        if record[at : at + 2] == b"NM":
            name += record[at + 5 : at + record[at + 2]]
        at += record[at + 2]
    return name.decode(errors="replace")


def fat_members(data: bytes) -> Members:
    """FAT12, 16 and 32 with long names."""
    sector, per_cluster, reserved, tables, roots, total, _, fat_size = struct.unpack_from("<HBHBHHBH", data, 11)
    fat_size = fat_size or struct.unpack_from("<I", data, 36)[0]
    total = total or struct.unpack_from("<I", data, 32)[0]
    root_at = (reserved + tables * fat_size) * sector
    first = root_at + -(-roots * 32 // sector) * sector
    cluster = per_cluster * sector
    count = (total * sector - first) // cluster
    bits = 12 if count < 4085 else 16 if count < 65525 else 32
    table = data[reserved * sector : (reserved + fat_size) * sector]

    def following(c: int) -> int:
        if bits == 12:
            pair = struct.unpack_from("<H", table, c * 3 // 2)[0]
            return pair >> 4 if c % 2 else pair & 0xFFF
        return struct.unpack_from("<H", table, 2 * c)[0] if bits == 16 else struct.unpack_from("<I", table, 4 * c)[0] & 0x0FFFFFFF

    def chain(c: int) -> bytes:
        out, seen = [], set()
        while 2 <= c < count + 2:
            if c in seen:
                raise ValueError("cluster loop")
            seen.add(c)
            out.append(data[first + (c - 2) * cluster : first + (c - 1) * cluster])
            c = following(c)
        return b"".join(out)

    def walk(raw: bytes, prefix: str, depth: int) -> Members:
        long_name: dict[int, str] = {}
        for at in range(0, len(raw), 32):
            e = raw[at : at + 32]
            if len(e) < 32 or e[0] == 0:
                return
            if e[0] == 0xE5 or (e[11] & 8 and e[11] != 15):
                long_name = {}
                continue
            if e[11] == 15:
                long_name[e[0] & 63] = (e[1:11] + e[14:26] + e[28:32]).decode("utf-16-le", errors="replace").split("\0")[0].rstrip("￿")
                continue
            base, ext = e[:8].rstrip().decode("latin-1"), e[8:11].rstrip().decode("latin-1")
            name = "".join(long_name[k] for k in sorted(long_name)) or (f"{base}.{ext}" if ext else base)
            long_name = {}
            start = struct.unpack_from("<H", e, 26)[0] | (struct.unpack_from("<H", e, 20)[0] << 16 if bits == 32 else 0)
            if name in (".", ".."):
                continue
            if e[11] & 16:
                if depth < 32:
                    yield from walk(chain(start), f"{prefix}{name}/", depth + 1)
            else:
                yield prefix + name, chain(start)[: struct.unpack_from("<I", e, 28)[0]]

    root = chain(struct.unpack_from("<I", data, 44)[0]) if bits == 32 else data[root_at : root_at + roots * 32]
    yield from walk(root, "", 0)


#: The mark of the second vendor's containers, and the bounds of an archive and of one update of the first.
CONTAINER_MARK, MAX_UPDATES, MAX_UPDATE_BYTES = b"DMA\0", 8192, 32 << 20


def update_at(data: bytes, at: int) -> tuple[str, int]:
    """Name and size of the update whose 48-byte header lies here; size 0 if it is none."""
    if at + 48 > len(data):
        return "", 0
    version, revision, date, signature, _, loader, flags, body, total = struct.unpack_from("<9I", data, at)
    size = total or 2048
    sane = version == 1 and loader == 1 and flags < 256 and valid_date(date)
    fits = size % 1024 == 0 and (body or 2000) + 48 <= size <= MAX_UPDATE_BYTES
    return f"{signature:08x}-{revision:08x}-{flags:02x}", size if sane and fits else 0


def container_at(data: bytes, at: int) -> tuple[str, int]:
    """Name and size of the container whose mark lies here: sections of type 0 or 1, each with its size, up to the next mark or the end."""
    end = at + 4 if data.startswith(CONTAINER_MARK, at) else len(data) + 1
    while end < len(data) and not data.startswith(CONTAINER_MARK, end):
        if end + 8 > len(data):
            return "", 0
        kind, size = struct.unpack_from("<II", data, end)
        end = end + 8 + size if kind < 2 else len(data) + 1
    return f"container-{at:08x}", end - at if end <= len(data) else 0


def microcode_parts(data: bytes) -> list[tuple[str, bytes]]:
    """Updates of either vendor that lie end to end and fill the file exactly, each by the sizes that it states; else none."""
    part_at = container_at if data.startswith(CONTAINER_MARK) else update_at
    parts, at = [], 0
    while at < len(data):
        name, size = part_at(data, at)
        if not 0 < size <= len(data) - at or len(parts) == MAX_UPDATES:
            return []
        parts.append((name, data[at : at + size]))
        at += size
    return parts


def valid_date(packed: int) -> bool:
    """Month, day and year as decimal digits in half-bytes."""
    text = f"{packed:08x}"
    return text.isdigit() and 1 <= int(text[:2]) <= 12 and 1 <= int(text[2:4]) <= 31 and 1990 <= int(text[4:]) <= 2099


PARSERS: dict[str, Callable[[bytes], Members]] = {"tar": tar_members, "zip": zip_members, "ar": ar_members, "cpio": cpio_members, "iso9660": iso_members, "fat": fat_members, "microcode": lambda d: iter(microcode_parts(d)), "rpm": lambda d: iter([("payload", d[rpm_payload(d) :])])}


def walk(root: str, data: bytes, policy: str = "full", known: Callable[[str], bool] = lambda sha256: False) -> list[tuple]:
    """Rows of SCHEMA for a file and all members below it. policy: none, cheap or full; content that is known is not entered."""
    rows: list[list] = []

    def add(path: str, name: str, content: bytes, parent: int | None, ord_: int, depth: int) -> None:
        if len(rows) >= MAX_MEMBERS:
            rows[0][-1] = f"cut off after {MAX_MEMBERS} members"
            return
        if isinstance(content, Unreadable):
            rows.append([root, len(rows), parent, ord_, depth, path, "file", *[None] * 7, content.why])
            return
        kind, me = sniffed(content, name), len(rows)
        sha256 = hashlib.sha256(content).hexdigest()
        git = hashlib.sha1(b"blob %d\0" % len(content) + content).hexdigest()
        rows.append([root, me, parent, ord_, depth, path, kind, len(content), hashlib.md5(content).hexdigest(), hashlib.sha1(content).hexdigest(), sha256, git, hashlib.sha512(content).hexdigest(), hashlib.blake2s(content).hexdigest(), None])
        enters = policy == "full" and (kind in PARSERS or kind in WRAPPERS) or policy == "cheap" and kind in CHEAP
        if not enters or (depth and known(sha256)):
            return
        if depth >= MAX_DEPTH:
            rows[me][-1] = "too deep"
            return
        try:
            below = iter([(unwrapped(name.rsplit("/", 1)[-1], kind), unwrap(content, kind))]) if kind in WRAPPERS else PARSERS[kind](content)
            for k, (child, inside) in enumerate(below):
                add(f"{path}!{child}", child, inside, me, k, depth + 1)
        except Exception as error:  # what was read so far stays
            rows[me][-1] = f"{type(error).__name__}: {error}"

    add(root, root, data, None, 0, 0)
    return [tuple(r) for r in rows]


def descend(files: DataFrame, policy: str = "full") -> DataFrame:
    """The member trees of files (path string, content binary)."""
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}
    types = [kinds[c.split()[1]] for c in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                rows = walk(path, content or b"", policy)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), types, strict=True)], names)

    return files.select("path", "content").mapInArrow(run, SCHEMA)


def listing(spark, root: str) -> DataFrame:
    """Files under a folder: path, size, mtime, content; links are not followed."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).selectExpr("path", "length AS size", "modificationTime AS mtime", "content")
