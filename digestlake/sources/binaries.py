"""Binary metadata that states digests of files: rpm headers and depot manifests."""

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Header tags, and digest algorithms by their numbers.
FILE_DIGESTS, DIR_INDEXES, BASE_NAMES, DIR_NAMES, DIGEST_ALGO = 1035, 1116, 1117, 1118, 5011
ALGORITHMS = {1: "md5", 2: "sha1", 8: "sha256", 10: "sha512"}
#: Fixed value: what a depot manifest's section of mappings begins with.
MAPPINGS_MAGIC = 0x71F617D0
INT_CODES = {3: "H", 4: "I"}


def header_at(data: bytes, at: int) -> tuple[dict, int]:
    """Tags of one rpm header structure, and where it ends: numbers and lists of strings."""
    if data[at : at + 3] != b"\x8e\xad\xe8":
        raise ValueError("no rpm header")
    entries, size = struct.unpack_from(">II", data, at + 8)
    store, tags = at + 16 + 16 * entries, {}
    for k in range(entries):
        tag, kind, offset, count = struct.unpack_from(">4I", data, at + 16 + 16 * k)
        if kind in INT_CODES:
            tags[tag] = list(struct.unpack_from(f">{count}{INT_CODES[kind]}", data, store + offset))
        elif kind in (6, 8, 9):
            tags[tag] = [x.decode(errors="replace") for x in data[store + offset : store + size].split(b"\0", count)[:count]]
    return tags, store + size


def rpm_files(data: bytes) -> list[tuple[str, str, str]]:
    """(path, scheme, digest) of the files with a digest that an rpm's header states. The lists must be of one length."""
    _, end = header_at(data, 96)
    tags, _ = header_at(data, end + -end % 8)
    digests, names, places = tags.get(FILE_DIGESTS, []), tags.get(BASE_NAMES, []), tags.get(DIR_INDEXES, [])
    if not len(digests) == len(names) == len(places):
        raise ValueError("file lists of different lengths")
    scheme = ALGORITHMS.get(tags.get(DIGEST_ALGO, [1])[0])
    return [(tags[DIR_NAMES][d] + n, scheme, x.lower()) for n, d, x in zip(names, places, digests, strict=True) if x and scheme]


def varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return value, at


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and values of a protobuf message; groups are not read."""
    at = 0
    while at < len(data):
        key, at = varint(data, at)
        if key & 7 == 0:
            value, at = varint(data, at)
        elif key & 7 == 2:
            size, at = varint(data, at)
            value, at = data[at : at + size], at + size
        elif key & 7 in (1, 5):
            size = 8 if key & 7 == 1 else 4
            value, at = int.from_bytes(data[at : at + size], "little"), at + size
        else:
            raise ValueError("unknown field kind")
        yield key >> 3, value


def manifest_files(data: bytes) -> list[tuple[str, int, str]]:
    """(path, size, sha1) of the files that a depot manifest maps; directories have no digest, or one of zeros, and are left out."""
    magic, size = struct.unpack_from("<II", data)
    if magic != MAPPINGS_MAGIC:
        raise ValueError("no depot manifest")
    found = []
    for number, value in fields(data[8 : 8 + size]):
        if number == 1:
            own = dict(fields(value))
            digest = own.get(5, b"")
            if len(digest) == 20 and any(digest):
                found.append((own.get(1, b"").rstrip(b"\0").decode(errors="replace"), own.get(2, 0), digest.hex()))
    return found


def stated_files(files: DataFrame, read) -> DataFrame:
    """source, path, scheme, digest, error of files (path, content): read is rpm_files or one of its kind; what cannot be read has an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["source", "path", "scheme", "digest", "error"]
        for b in batches:
            rows = []
            for source, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                try:
                    rows += [(source, *r, None) for r in read(content)]
                except (ValueError, IndexError, KeyError, struct.error) as error:
                    rows.append((source, None, None, None, str(error)))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(5)], names)

    return files.select("path", "content").mapInArrow(run, "source string, path string, scheme string, digest string, error string")


def manifest_rows(data: bytes) -> list[tuple[str, str, str]]:
    return [(path, "sha1", digest) for path, _, digest in manifest_files(data)]
