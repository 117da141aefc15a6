"""What a file is, by its first bytes and its name, as columns."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Kinds by the hex of their first bytes, in the order in which they are tried.
MAGIC = [
    ("ar", "213C617263683E0A"), ("gzip", "1F8B"), ("xz", "FD377A585A00"), ("zstd", "28B52FFD"), ("bzip2", "425A68"), ("zip", "504B0304"),
    ("rpm", "EDABEEDB"), ("cpio", "303730373031"), ("cpio", "303730373032"), ("tar", ""), ("squashfs", "68737173"), ("7z", "377ABCAF271C"),
]
#: Suffixes of wrappers, and what stands in their place once unwrapped.
UNWRAPPED = {"gzip": [(".tgz", ".tar"), (".gz", "")], "xz": [(".txz", ".tar"), (".xz", "")], "zstd": [(".tzst", ".tar"), (".zst", "")], "bzip2": [(".tbz2", ".tar"), (".tbz", ".tar"), (".bz2", "")]}


def sniff(head: Column, name: Column) -> Column:
    """The container kind of binary content, by magic; an .iso by its name; a FAT image by its boot sector; else 'file'."""
    hexed = F.hex(F.substring(head, 1, 16))
    at = lambda offset, n: F.hex(F.substring(head, offset + 1, n))
    tests = []
    for kind, magic in MAGIC:
        test = hexed.startswith(magic) if magic else (F.octet_length(head) > 262) & (at(257, 5) == "7573746172")
        tests.append((kind, test & hexed.rlike("^.{6}3[0-9]") if kind == "bzip2" else test))
    tests += [("erofs", at(1024, 4) == "E2E1F5E0"), ("iso9660", F.lower(name).endswith(".iso")), ("fat", looks_like_fat(head))]
    made = F.when(tests[0][1], tests[0][0])
    for kind, test in tests[1:]:
        made = made.when(test, kind)
    return made.otherwise("file")


def _le(head: Column, offset: int, n: int) -> Column:
    """A little-endian number of n bytes."""
    byte = lambda k: F.conv(F.hex(F.substring(head, offset + k + 1, 1)), 16, 10).cast("long")
    value = byte(0)
    for k in range(1, n):
        value = value + byte(k) * 256**k
    return value


def looks_like_fat(head: Column) -> Column:
    """A boot sector that makes sense as a whole: jump, geometry and type string."""
    text = lambda offset: F.substring(head, offset + 1, 3) == F.lit(b"FAT")
    jump = F.hex(F.substring(head, 1, 1)).isin("EB", "E9")
    geometry = _le(head, 11, 2).isin(512, 1024, 2048, 4096) & _le(head, 13, 1).isin(1, 2, 4, 8, 16, 32, 64, 128)
    tables = (_le(head, 14, 2) != 0) & _le(head, 16, 1).isin(1, 2) & (_le(head, 21, 1) >= 0xF0)
    return F.coalesce((F.octet_length(head) >= 512) & (F.hex(F.substring(head, 511, 2)) == "55AA") & jump & geometry & tables & (text(54) | text(82)), F.lit(False))


def unwrapped_name(name: Column, kind: Column) -> Column:
    """What the content of a compressed file is called."""
    made = F.concat(name, F.lit("~unpacked"))
    for wrapper, suffixes in UNWRAPPED.items():
        for suffix, instead in reversed(suffixes):
            made = F.when((kind == wrapper) & F.lower(name).endswith(suffix), F.concat(F.substring(name, F.lit(1), F.length(name) - len(suffix)), F.lit(instead))).otherwise(made)
    return made


def mirror_split(url: Column) -> Column:
    """struct<base, path>: a download link cut before its pool or dists directory, else after its host."""
    base = F.when(url.contains("/pool/"), F.regexp_extract(url, "^(.*?)/pool/", 1)).when(url.contains("/dists/"), F.regexp_extract(url, "^(.*?)/dists/", 1)).otherwise(F.regexp_extract(url, "^([a-z]+://[^/]+)", 1))
    return F.struct(F.concat(base, F.lit("/")).alias("base"), F.substring(url, F.length(base) + 2, F.length(url)).alias("path"))
