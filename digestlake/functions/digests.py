"""Digest coordinates as columns: computing them, parsing what people write for them, and spelling them."""

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Digest lengths in bytes, and the names that each scheme goes by.
DIGEST_BYTES = {"md5": 16, "sha1": 20, "sha256": 32, "sha512": 64, "sha1_git": 20, "blake2s256": 32}
ALIASES = {
    "md5": "md5", "sha1": "sha1", "sha-1": "sha1", "sha256": "sha256", "sha-256": "sha256", "sha512": "sha512", "sha-512": "sha512",
    "sha1_git": "sha1_git", "sha1-git": "sha1_git", "git": "sha1_git", "blake2s256": "blake2s256", "blake2s": "blake2s256",
}
#: Schemes whose digests say that contents are the same; the others only look up.
IDENTITY_GRADE = ("sha256", "sha512", "blake2s256")
#: Content below this many bytes is never attributed.
IDENTITY_FLOOR = 32
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
BLANKS = " \t\n\r\x0b\x0c"


@F.pandas_udf(StringType())
def blake2s256(content: pd.Series) -> pd.Series:
    return content.map(lambda x: None if x is None else hashlib.blake2s(x).hexdigest())


def as_bytes(content: Column) -> Column:
    return F.encode(content, "utf-8")


def git_blob(content: Column, bits: int = 160) -> Column:
    """The git object id of binary content: the digest of 'blob <length>', a zero byte and the content."""
    framed = F.concat(as_bytes(F.concat(F.lit("blob "), F.octet_length(content).cast("string"))), F.unhex(F.lit("00")), content)
    return F.sha1(framed) if bits == 160 else F.sha2(framed, bits)


def digest_columns(content: Column, blake: bool = True) -> dict[str, Column]:
    """scheme -> lower-case hex of binary content."""
    made = {"md5": F.md5(content), "sha1": F.sha1(content), "sha256": F.sha2(content, 256), "sha512": F.sha2(content, 512), "sha1_git": git_blob(content)}
    return made | ({"blake2s256": blake2s256(content)} if blake else {})


def coords_of(columns: dict[str, str]) -> Column:
    """Array of struct<scheme, digest> from columns by scheme; nulls are left out, order is by scheme name and digest."""
    each = F.array(*[F.struct(F.lit(s).alias("scheme"), F.col(c).alias("digest")) for s, c in columns.items()])
    return F.array_sort(F.filter(each, lambda x: x["digest"].isNotNull()))


def display(coord: Column) -> Column:
    return F.concat_ws(":", coord["scheme"], coord["digest"])


def scheme_of(name: Column) -> Column:
    """The scheme that a prefix names, in any case; null if none."""
    known = F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair])
    return F.try_element_at(known, F.lower(name))


def digest_chars(scheme: Column) -> Column:
    known = F.create_map(*[F.lit(x) for s, n in DIGEST_BYTES.items() for x in (s, 2 * n)])
    return F.try_element_at(known, scheme)


def base32_hex(text: Column) -> Column:
    """Hex of 32 base-32 characters (20 bytes), by five-bit groups."""
    bits = F.concat_ws("", F.transform(F.split(text, ""), lambda c: F.lpad(F.conv((F.instr(F.lit(BASE32), c) - 1).cast("string"), 10, 2), 5, "0")))
    return F.concat_ws("", F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.lpad(F.lower(F.conv(F.substring(bits, i * 20 + 1, F.lit(20)), 2, 16)), 5, "0")))


def parse_coord(text: Column) -> Column:
    """struct<scheme, digest, error> of a written digest: SWHID, SRI, scheme:hex, bare base-32 sha1, or bare hex by length.

    What cannot be read has a null scheme and digest, and an error.
    """
    s = F.trim(text, F.lit(BLANKS))
    hexed = lambda x: F.when(F.trim(x, F.lit(BLANKS)).rlike("^([0-9A-Fa-f]{2})*$"), F.lower(F.trim(x, F.lit(BLANKS))))
    swh = s.startswith("swh:1:cnt:")
    sri_scheme = scheme_of(F.substring_index(s, "-", 1))
    sri_text = F.substring(s, F.instr(s, "-") + 1, F.length(s))
    canonical = sri_text.rlike("^([A-Za-z0-9+/]{4})*([A-Za-z0-9+/][AQgw]==|[A-Za-z0-9+/]{2}[AEIMQUYcgkosw048]=)?$")
    sri_hex = F.when(canonical, F.lower(F.hex(F.try_to_binary(sri_text, F.lit("base64")))))
    sri = s.contains("-") & ~s.contains(":") & sri_scheme.isNotNull() & (F.length(sri_hex) == digest_chars(sri_scheme))
    prefixed = s.contains(":")
    prefix = scheme_of(F.substring_index(s, ":", 1))
    after = hexed(F.substring(s, F.instr(s, ":") + 1, F.length(s)))
    base32 = s.rlike("^[A-Z2-7]{32}$") & ~s.rlike("^[0-9A-Fa-f]{32}$")
    bare = hexed(s)
    by_length = F.try_element_at(F.create_map(*[F.lit(x) for pair in ((32, "md5"), (40, "sha1"), (64, "sha256"), (128, "sha512")) for x in pair]), F.length(bare))
    made = lambda scheme, digest: F.struct(scheme.alias("scheme"), digest.alias("digest"))
    found = (
        F.when(swh, made(F.lit("sha1_git"), hexed(F.substring(s, 11, F.length(s)))))
        .when(F.coalesce(sri, F.lit(False)), made(sri_scheme, sri_hex))
        .when(prefixed, made(prefix, after))
        .when(base32, made(F.lit("sha1"), base32_hex(s)))
        .otherwise(made(by_length, bare))
    )
    good = (F.length(found["digest"]) == digest_chars(found["scheme"])).eqNullSafe(F.lit(True))
    error = F.when(found["scheme"].isNull() & prefixed & ~swh, "unknown scheme").when(found["digest"].isNull(), "not valid hex").when(found["scheme"].isNull(), "length names no scheme").otherwise("wrong length")
    return F.struct(F.when(good, found["scheme"]).alias("scheme"), F.when(good, found["digest"]).alias("digest"), F.when(~good, error).alias("error"))


def bloom_key(scheme: Column, digest: Column) -> Column:
    """How filters spell a digest: sha1 and md5 in upper case, sha256 in lower; no other scheme has a key."""
    return F.when(scheme.isin("sha1", "md5"), F.upper(digest)).when(scheme == "sha256", F.lower(digest))


def valid_hex(text: Column, chars: int) -> Column:
    """Lower-case hex of exactly so many characters, else null."""
    return F.when(text.rlike(f"^[0-9A-Fa-f]{{{chars}}}$"), F.lower(text))


def shard(digest: Column) -> Column:
    """The partition of a digest: its first nibble; null digests go to the last one."""
    return F.coalesce(F.substring(digest, 1, 1), F.lit("znull"))


def table_checksum(data: Column, table: list[int]) -> Column:
    """Hex of two little-endian 32-bit sums: of the table's numbers for the bytes, and of that sum after each byte. Null stays null.

    The 256 numbers are those of the format that is to be written, and a parameter.
    """
    numbers = np.array(table, np.uint32)
    if numbers.shape != (256,):
        raise ValueError("need a number for each of 256 bytes")

    @F.pandas_udf("string")
    def sums(values: pd.Series) -> pd.Series:
        def of(content: bytes) -> str:
            first = second = 0
            for at in range(0, len(content), 1 << 20):
                steps = np.cumsum(numbers[np.frombuffer(content[at : at + (1 << 20)], np.uint8)], dtype=np.uint64) + np.uint64(first)
                first, second = int(steps[-1]) & 0xFFFFFFFF, (second + int(steps.sum())) & 0xFFFFFFFF
            return (first.to_bytes(4, "little") + second.to_bytes(4, "little")).hex()

        return pd.Series([None if v is None else of(v) for v in values], index=values.index, dtype=object)

    return sums(data)
