"""Bloom filters of a fixed file format: sizing, bit positions, building, folding, merging, probing, files.

Positions need unsigned 64-bit arithmetic that wraps, which Spark's signed numbers do not have: they are computed by
numpy over Arrow batches, and everything after that, bits, words, folds, counts, by DataFrame functions.
"""

import math
import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from digestlake.functions.digests import bloom_key

#: The hash, its modulus and multiplier, and the header of six little-endian words.
FNV_START, FNV_PRIME = np.uint64(0xCBF29CE484222325), np.uint64(0x100000001B3)
MODULUS, MULTIPLIER = np.uint64(2**64 - 87), np.uint64(18446744073709550147)
HEADER = struct.Struct("<QQdQQQ")
VERSION = 1
#: Filters up to this size are broadcast to be probed; larger ones are probed by joining positions to words.
BROADCAST_BYTES = 64 << 20


def size_for(n: int, p: float) -> tuple[int, int]:
    """Bits and positions per key for n keys at false-positive rate p."""
    if n <= 0 or not 0 < p < 1:
        raise ValueError(f"need n > 0 and 0 < p < 1, got {n} and {p}")
    m = math.ceil(n * -math.log(p) / math.log(2) ** 2)
    return m, max(1, math.floor(m / n * math.log(2) + 0.5))


def fnv1(keys: list[bytes]) -> np.ndarray:
    sizes = np.fromiter(map(len, keys), np.int64, len(keys))
    h = np.full(len(keys), FNV_START, np.uint64)
    raw = np.frombuffer(b"".join(keys), np.uint8)
    start = np.cumsum(sizes) - sizes
    for k in range(int(sizes.max(initial=0))):
        live = np.flatnonzero(sizes > k)
        h[live] = (h[live] * FNV_PRIME) ^ raw[start[live] + k]
    return h


def positions(keys: list[bytes], k: int, m: int) -> np.ndarray:
    """One row of k bit positions per key, in the order of probing."""
    h, out = fnv1(keys) % MODULUS, np.empty((len(keys), k), np.int64)
    for j in range(k):
        h = (h * MULTIPLIER) % MODULUS
        out[:, j] = (h % np.uint64(m)).astype(np.int64)
    return out


def positions_of(key: Column, k: int, m: int) -> Column:
    @F.pandas_udf("array<bigint>")
    def find(keys: pd.Series) -> pd.Series:
        known = keys.notna()
        out = pd.Series([None] * len(keys), index=keys.index, dtype=object)
        out[known] = pd.Series(list(positions([x.encode() for x in keys[known]], k, m)), index=keys.index[known], dtype=object)
        return out

    return find(key)


def build(keys: DataFrame, column: str, k: int, m: int) -> DataFrame:
    """word, bits: the filter's words that are not zero. The OR of single bits is combined before the shuffle."""
    bit = keys.select(F.explode(positions_of(F.col(column), k, m)).alias("bit"))
    return bit.groupBy(F.floor(F.col("bit") / 64).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 AS int))")).alias("bits"))


def bits_of(words: DataFrame) -> DataFrame:
    """bit: every position that is set."""
    each = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.getbit(F.col("bits"), i) == 1)
    return words.select(F.explode(F.transform(each, lambda i: F.col("word") * 64 + i)).alias("bit"))


def folded(words: DataFrame, m: int) -> DataFrame:
    """The filter of half the bits; a key that was in stays in. An odd m cannot be halved."""
    if m % 2:
        raise ValueError(f"cannot fold: bit count {m} is odd")
    bit = bits_of(words).select((F.col("bit") % (m // 2)).alias("bit"))
    return bit.groupBy(F.floor(F.col("bit") / 64).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 AS int))")).alias("bits"))


def merged(*filters: DataFrame) -> DataFrame:
    """The union of filters of equal size: word by word OR."""
    every = filters[0]
    for f in filters[1:]:
        every = every.unionByName(f)
    return every.groupBy("word").agg(F.bit_or("bits").alias("bits"))


def fill(words: DataFrame, m: int) -> float:
    """The share of bits that are set; to the power of k it is the false-positive rate of a folded filter."""
    set_bits = words.agg(F.coalesce(F.sum(F.bit_count("bits")), F.lit(0))).first()[0]
    return set_bits / m


def probed(rows: DataFrame, column: str, words: DataFrame, k: int, m: int, name: str = "hit") -> DataFrame:
    """rows with whether the key is probably in the filter; null keys are not.

    A filter up to BROADCAST_BYTES is broadcast as bytes. A larger one is not moved: distinct keys' positions are joined to its
    words, and a key is in if all its positions are.
    """
    if m / 8 <= BROADCAST_BYTES:
        held = rows.sparkSession.sparkContext.broadcast(assembled(words, m))

        @F.pandas_udf("boolean")
        def check(keys: pd.Series) -> pd.Series:
            table = np.frombuffer(held.value, "<u8")
            known = keys.notna().to_numpy()
            out = np.zeros(len(keys), bool)
            at = positions([x.encode() for x in keys[known]], k, m)
            out[known] = ((table[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).all(axis=1)
            return pd.Series(out, index=keys.index)

        return rows.withColumn(name, check(F.col(column)))
    keys = rows.select(column).where(F.col(column).isNotNull()).distinct()
    asked = keys.select(column, F.explode(positions_of(F.col(column), k, m)).alias("bit"))
    met = asked.withColumn("word", F.floor(F.col("bit") / 64)).join(words, "word", "left")
    is_set = F.coalesce(F.getbit(F.col("bits"), (F.col("bit") % 64).cast("int")) == 1, F.lit(False))
    told = met.groupBy(column).agg(F.bool_and(is_set).alias(name))
    return rows.join(told, column, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def assembled(words: DataFrame, m: int) -> bytes:
    """All words of a filter, as bytes; only for filters of a size that the driver can hold."""
    table = np.zeros(-(-m // 64), np.uint64)
    rows = words.toPandas()
    table[rows["word"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64).view(np.uint64)
    return table.astype("<u8").tobytes()


def file_bytes(words: DataFrame, n: int, p: float, k: int, m: int, n_elements: int) -> bytes:
    """The filter as a file. n_elements counts insertions, repeated keys included."""
    return HEADER.pack(VERSION, n, p, k, m, n_elements) + assembled(words, m)


def parsed(data: bytes, what: str = "filter") -> dict:
    """Header fields and the words, or what is wrong with the file."""
    if len(data) < HEADER.size:
        raise ValueError(f"{what}: too short")
    version, n, p, k, m, n_elements = HEADER.unpack_from(data)
    if version & 0xFF != VERSION:
        raise ValueError(f"{what}: unsupported version {version}")
    if len(data) < HEADER.size + -(-m // 64) * 8:
        raise ValueError(f"{what}: truncated")
    return {"n": n, "p": p, "k": k, "m": m, "n_elements": n_elements, "words": np.frombuffer(data, "<u8", -(-m // 64), HEADER.size)}


#: The schemes that lists of digests may have, with the length of their hex form.
LISTED = {"md5": 32, "sha1": 40, "sha256": 64}


def listed_keys(spark: SparkSession, paths: list[str], scheme: str) -> DataFrame:
    """key: the digests of text files of one a line, in the scheme's written form. Blank lines count for nothing; any other is an error."""
    if scheme not in LISTED:
        raise ValueError(f"no lists of {scheme}")
    line = F.regexp_replace("value", r"^\s+|\s+$", "")
    good = line.rlike(f"^[0-9A-Fa-f]{{{LISTED[scheme]}}}$")
    wrong = F.raise_error(F.concat(F.lit(f"not a digest of {scheme}: "), line))
    return spark.read.text(paths).where(line != "").select(F.when(good, bloom_key(F.lit(scheme), F.lower(line))).otherwise(wrong).alias("key"))


def from_lists(spark: SparkSession, paths: list[str], scheme: str, p: float) -> bytes:
    """The file of a filter sized for the lines of these lists, repeated ones included."""
    keys = listed_keys(spark, paths, scheme)
    n = keys.where("key is not null").count()
    if not n:
        raise ValueError("the lists hold no digest")
    m, k = size_for(n, p)
    return file_bytes(build(keys, "key", k, m), n, p, k, m, n)


def installed(spark: SparkSession, path: str) -> list[dict]:
    """name, scheme, bytes, n and n_elements of the filters NAME.SCHEME.bloom in a folder, the smallest first, as they are to be asked.

    Headers alone are read.
    """
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs, found = at.getFileSystem(spark._jsc.hadoopConfiguration()), []
    for entry in fs.listStatus(at) if fs.exists(at) else []:
        parts = entry.getPath().getName().rsplit(".", 2)
        if len(parts) != 3 or parts[2] != "bloom":
            continue
        stream = fs.open(entry.getPath())
        try:
            head = bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream, min(HEADER.size, entry.getLen())))
        finally:
            stream.close()
        if len(head) < HEADER.size:
            raise ValueError(f"{entry.getPath()}: too short")
        version, n, _, _, _, n_elements = HEADER.unpack(head)
        if version & 0xFF != VERSION:
            raise ValueError(f"{entry.getPath()}: unsupported version {version}")
        found.append({"name": parts[0], "scheme": parts[1], "bytes": entry.getLen(), "n": n, "n_elements": n_elements})
    return sorted(found, key=lambda f: (f["bytes"], f["name"], f["scheme"]))
