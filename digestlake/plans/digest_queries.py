"""Queries on coordinates, claims, filters."""

from pyspark.sql import functions as F

from digestlake.functions import bloom, claims, containers, digests
from digestlake.operators import etl, lookup, verdicts
from digestlake.plans.registry import Catalogue

C = Catalogue()
#: A filter for the queries: sized for a million keys at one in ten thousand.
FILTER_M, FILTER_K = bloom.size_for(1_000_000, 1e-4)
EVEN_M = FILTER_M + FILTER_M % 2
POSITIONS = "list_transform(range(1, {k} + 1), lambda j: CAST(list_reduce(list_concat([h % 18446744073709551529::UHUGEINT], range(0, j)::UHUGEINT[]), lambda x, y: ((x * 18446744073709550147::UHUGEINT) % 18446744073709551616::UHUGEINT) % 18446744073709551529::UHUGEINT) % {m} AS BIGINT))"
FNV = "list_reduce(list_concat([14695981039346656037::UHUGEINT], list_transform(range(1, length({key}) + 1), lambda i: ord({key}[i])::UHUGEINT)), lambda x, y: xor((x * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT, y))"


def positions_sql(source: str, key: str, k: int, m: int, extra: str = "") -> str:
    """Bit positions of a key column in DuckDB, in 128-bit arithmetic."""
    return f"SELECT {extra}{key} AS key, {POSITIONS.format(k=k, m=m)} AS positions FROM (SELECT *, {FNV.format(key=key)} AS h FROM ({source}))"


@C.query("""SELECT doc_id, md5(text) AS md5, sha1(text) AS sha1, sha256(text) AS sha256,
 sha1(concat('blob ', octet_length(encode(text)))::BLOB || '\\x00'::BLOB || encode(text)) AS sha1_git,
 sha256(concat('blob ', octet_length(encode(text)))::BLOB || '\\x00'::BLOB || encode(text)) AS sha256_git, CAST(octet_length(encode(text)) AS BIGINT) AS size FROM documents""")
def coords_documents(t):
    raw = digests.as_bytes(F.col("text"))
    made = digests.digest_columns(raw, blake=False)
    return t.documents.select("doc_id", made["md5"].alias("md5"), made["sha1"].alias("sha1"), made["sha256"].alias("sha256"), made["sha1_git"].alias("sha1_git"), digests.git_blob(raw, 256).alias("sha256_git"), F.octet_length("text").cast("long").alias("size"))


@C.query()
def coords_all_schemes(t):
    made = digests.digest_columns(digests.as_bytes(F.col("text")))
    return t.documents.select("doc_id", *[v.alias(k) for k, v in made.items()])


@C.query("""WITH d AS (SELECT doc_id, sha256(text) AS h256, sha1(text) AS h1, md5(text) AS h5, sha1(concat('blob ', octet_length(encode(text)))::BLOB || '\\x00'::BLOB || encode(text)) AS g FROM documents)
SELECT doc_id, form, scheme, digest, error FROM (
 SELECT doc_id, 'bare256' AS form, 'sha256' AS scheme, h256 AS digest, NULL AS error FROM d
 UNION ALL SELECT doc_id, 'upper1', 'sha1', h1, NULL FROM d
 UNION ALL SELECT doc_id, 'prefixed5', 'md5', h5, NULL FROM d
 UNION ALL SELECT doc_id, 'swhid', 'sha1_git', g, NULL FROM d
 UNION ALL SELECT doc_id, 'sri', 'sha256', h256, NULL FROM d
 UNION ALL SELECT doc_id, 'alias', 'sha1_git', g, NULL FROM d
 UNION ALL SELECT doc_id, 'short', NULL, NULL, 'length names no scheme' FROM d
 UNION ALL SELECT doc_id, 'unknown', NULL, NULL, 'unknown scheme' FROM d
 UNION ALL SELECT doc_id, 'mismatch', NULL, NULL, 'wrong length' FROM d
 UNION ALL SELECT doc_id, 'nothex', NULL, NULL, 'not valid hex' FROM d)""")
def coord_parse(t):
    raw = digests.as_bytes(F.col("text"))
    d = t.documents.select("doc_id", F.sha2(raw, 256).alias("h256"), F.sha1(raw).alias("h1"), F.md5(raw).alias("h5"), digests.git_blob(raw).alias("g"))
    forms = {
        "bare256": F.concat(F.lit("  "), F.col("h256")), "upper1": F.upper("h1"), "prefixed5": F.concat(F.lit("MD5:"), F.col("h5")), "swhid": F.concat(F.lit("swh:1:cnt:"), F.col("g")),
        "sri": F.concat(F.lit("sha256-"), F.base64(F.unhex("h256"))), "alias": F.concat(F.lit("git:"), F.upper("g")), "short": F.substring("h256", 1, 30), "unknown": F.concat(F.lit("crc:"), F.col("h5")),
        "mismatch": F.concat(F.lit("sha1:"), F.col("h5")), "nothex": F.concat(F.lit("zz"), F.col("h5")),
    }
    each = d.select("doc_id", F.explode(F.array(*[F.struct(F.lit(k).alias("form"), v.alias("input")) for k, v in forms.items()])).alias("f")).select("doc_id", "f.form", "f.input")
    return each.withColumn("c", digests.parse_coord(F.col("input"))).select("doc_id", "form", "c.scheme", "c.digest", "c.error")


@C.query()
def coord_parse_base32(t):
    raw = F.unhex(F.sha1(digests.as_bytes(F.col("text"))))
    digits = F.concat_ws("", F.transform(F.sequence(F.lit(1), F.lit(20)), lambda i: F.lpad(F.conv(F.hex(F.substring(raw, i, F.lit(1))), 16, 2), 8, "0")))
    spelled = F.concat_ws("", F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.substring(F.lit(digests.BASE32), F.conv(F.substring(digits, i * 5 + 1, F.lit(5)), 2, 10).cast("int") + 1, F.lit(1))))
    return t.documents.select("doc_id", F.hex(raw).alias("sha1"), spelled.alias("base32")).withColumn("c", digests.parse_coord(F.col("base32"))).select("doc_id", "sha1", "base32", "c.scheme", "c.digest")


@C.query("SELECT doc_id, octet_length(encode(text)) < 32 AS below_floor, CASE WHEN octet_length(encode(text)) < 32 THEN 'floor' ELSE 'unknown' END AS class FROM documents")
def identity_floor(t):
    size = F.octet_length("text")
    return t.documents.select("doc_id", (size < digests.IDENTITY_FLOOR).alias("below_floor"), verdicts.classify(F.lit(True), size, F.lit(False), F.lit(False), F.lit(False)).alias("class"))


@C.query("""SELECT doc_id, 'sha256' AS scheme, sha256(text) AS key FROM documents UNION ALL SELECT doc_id, 'sha1', upper(sha1(text)) FROM documents
 UNION ALL SELECT doc_id, 'md5', upper(md5(text)) FROM documents UNION ALL SELECT doc_id, 'sha512', NULL FROM documents""")
def bloom_keys(t):
    made = digests.digest_columns(digests.as_bytes(F.col("text")), blake=False)
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("scheme"), made[s].alias("digest")) for s in ("sha256", "sha1", "md5", "sha512")]))
    return t.documents.select("doc_id", each.alias("c")).select("doc_id", "c.scheme", digests.bloom_key(F.col("c.scheme"), F.col("c.digest")).alias("key"))


@C.query(f"SELECT doc_id, key, unnest(positions) AS bit, unnest(range(0, {FILTER_K})) AS n FROM ({positions_sql('SELECT doc_id, sha256(text) AS sha256 FROM documents', 'sha256', FILTER_K, FILTER_M, 'doc_id, ')})")
def bloom_positions(t):
    keys = t.documents.select("doc_id", F.sha2("text", 256).alias("key"))
    return keys.select("doc_id", "key", F.posexplode(bloom.positions_of(F.col("key"), FILTER_K, FILTER_M)).alias("n", "bit")).select("doc_id", "key", "bit", F.col("n").cast("long").alias("n"))


def _filter_sql(m: int) -> str:
    return f"SELECT DISTINCT unnest(positions) AS bit FROM ({positions_sql('SELECT sha256(text) AS sha256 FROM documents WHERE doc_id % 2 = 0', 'sha256', FILTER_K, m)})"


def _even_filter(t, m):
    return bloom.build(t.documents.where("doc_id % 2 = 0").select(F.sha2("text", 256).alias("key")), "key", FILTER_K, m)


@C.query(f"SELECT bit FROM ({_filter_sql(FILTER_M)})")
def bloom_build(t):
    return bloom.bits_of(_even_filter(t, FILTER_M))


@C.query(f"""WITH f AS ({_filter_sql(FILTER_M)}), p AS ({positions_sql('SELECT doc_id, sha256(text) AS sha256 FROM documents', 'sha256', FILTER_K, FILTER_M, 'doc_id, ')}),
 s AS (SELECT list(bit) AS bits FROM f) SELECT doc_id, list_has_all(bits, positions) AS hit FROM p, s""")
def bloom_membership(t):
    rows = t.documents.select("doc_id", F.sha2("text", 256).alias("key"))
    return bloom.probed(rows, "key", _even_filter(t, FILTER_M), FILTER_K, FILTER_M).select("doc_id", "hit")


@C.query(f"SELECT DISTINCT bit % {EVEN_M // 2} AS bit FROM ({_filter_sql(EVEN_M)})")
def bloom_fold(t):
    return bloom.bits_of(bloom.folded(_even_filter(t, EVEN_M), EVEN_M))


@C.query(f"""SELECT DISTINCT unnest(positions) AS bit FROM ({positions_sql('SELECT sha256(text) AS sha256 FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT sha256(html) FROM pages', 'sha256', FILTER_K, FILTER_M)})""")
def bloom_merge(t):
    pages = bloom.build(t.pages.select(F.sha2("html", 256).alias("key")), "key", FILTER_K, FILTER_M)
    return bloom.bits_of(bloom.merged(_even_filter(t, FILTER_M), pages))


@C.query(f"""WITH f AS ({_filter_sql(FILTER_M)}), p AS ({positions_sql('SELECT doc_id, source, sha256(text) AS sha256 FROM documents', 'sha256', FILTER_K, FILTER_M, 'source, ')}),
 s AS (SELECT list(bit) AS bits FROM f) SELECT source, count(*) FILTER (list_has_all(bits, positions)) AS hits, count(*) AS probed FROM p, s GROUP BY source""")
def filter_hits_per_source(t):
    rows = t.documents.select("source", F.sha2("text", 256).alias("key"))
    return bloom.probed(rows, "key", _even_filter(t, FILTER_M), FILTER_K, FILTER_M).groupBy("source").agg(F.count_if("hit").alias("hits"), F.count("*").alias("probed"))


@C.query("SELECT sha256(text) AS key FROM documents UNION SELECT sha256(html) FROM pages")
def bloom_key_union(t):
    return etl.key_union(t.documents.select(F.sha2("text", 256).alias("a")), "a", t.pages.select(F.sha2("html", 256).alias("b")), "b")


WITNESS = "CASE s_suppkey % 8 WHEN 0 THEN 'debian-sid' WHEN 1 THEN 'debian-bookworm-security' WHEN 2 THEN 'ubuntu-zesty-updates' WHEN 3 THEN 'ubuntu-noble' WHEN 4 THEN 'kali-rolling' WHEN 5 THEN 'fedora-core-4-updates' WHEN 6 THEN 'opensuse' ELSE 'other-repo-x' END"


@C.query(f"""WITH s AS (SELECT s_suppkey, s_name, {WITNESS} AS witness FROM supplier)
SELECT s_suppkey, witness, CASE witness WHEN 'debian-sid' THEN 'https://deb.debian.org/debian' WHEN 'debian-bookworm-security' THEN 'https://security.debian.org/debian-security'
 WHEN 'ubuntu-zesty-updates' THEN 'https://old-releases.ubuntu.com/ubuntu' WHEN 'ubuntu-noble' THEN 'https://archive.ubuntu.com/ubuntu' ELSE 'https://http.kali.org/kali' END AS base,
 CASE witness WHEN 'fedora-core-4-updates' THEN 'Fedora Core 4 updates' WHEN 'opensuse' THEN 'openSUSE' ELSE replace(witness, '-', ' ') END AS human,
 CASE witness WHEN 'fedora-core-4-updates' THEN 'fedora' ELSE split_part(witness, '-', 1) END AS backend,
 CASE witness WHEN 'opensuse' THEN 'openSUSE' ELSE witness END AS medium,
 upper(witness[1]) || split_part(witness, '-', 1)[2:] || ' ' || CASE WHEN witness LIKE '%-%' THEN substr(witness, strpos(witness, '-') + 1) ELSE '' END || ' ships these bytes as ' || s_name || ' 1.0 (amd64)' AS statement FROM s""")
def archive_base_url(t):
    s = t.supplier.select("s_suppkey", "s_name", F.expr(WITNESS).alias("witness"))
    w = F.col("witness")
    shown = claims.witness_display(w)
    told = claims.deb(w, F.col("s_name"), F.lit("1.0"), F.lit("amd64"), F.lit("pool/x.deb"))
    return s.select("s_suppkey", "witness", claims.archive_base(w).alias("base"), shown["human"].alias("human"), shown["backend"].alias("backend"), claims.media_name(w).alias("medium"), told["statement"].alias("statement"))


@C.query("""SELECT p_partkey, 'scholarly file: "' || p_name || '" (' || p_size || ')' || CASE WHEN p_partkey % 3 = 0 THEN ', ' || p_brand ELSE '' END ||
 CASE WHEN p_partkey % 2 = 0 THEN ', doi:10.1/' || p_partkey WHEN p_partkey % 5 = 0 THEN ', arXiv:' || p_partkey ELSE '' END AS statement,
 CASE WHEN p_partkey % 7 = 0 THEN 'https://web/' || p_partkey WHEN p_partkey % 2 = 0 THEN 'https://doi.org/10.1/' || p_partkey WHEN p_partkey % 5 = 0 THEN 'https://arxiv.org/abs/' || p_partkey END AS url FROM part""")
def scholarly_claims(t):
    k = F.col("p_partkey").cast("string")
    when = lambda n, c: F.when(F.col("p_partkey") % n == 0, c)
    made = claims.scholarly(F.col("p_name"), F.col("p_size"), when(3, F.col("p_brand")), when(2, F.concat(F.lit("10.1/"), k)), when(5, k), when(7, F.concat(F.lit("https://web/"), k)))
    return t.part.select("p_partkey", made["statement"].alias("statement"), made["url"].alias("url"))


@C.query("""SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'https://crates.io/crates/' || o_orderpriority || '/' || o_orderkey WHEN 1 THEN 'https://central.sonatype.com/artifact/g.' || o_orderstatus || '/a:b/' || o_orderkey END AS url FROM orders""")
def registry_urls(t):
    system = F.when(F.col("o_orderkey") % 3 == 0, "CARGO").when(F.col("o_orderkey") % 3 == 1, "MAVEN").otherwise("APT")
    name = F.when(system == "MAVEN", F.concat(F.lit("g."), F.col("o_orderstatus"), F.lit(":a:b"))).otherwise(F.col("o_orderpriority"))
    return t.orders.select("o_orderkey", claims.registry_url(system, name, F.col("o_orderkey").cast("string")).alias("url"))


@C.query("""WITH f AS (SELECT page_id, url, CASE page_id % 5 WHEN 0 THEN 'a.tgz' WHEN 1 THEN 'B.TAR.GZ' WHEN 2 THEN 'c.iso' WHEN 3 THEN 'd.zst' ELSE 'e' END AS name, CASE page_id % 5 WHEN 0 THEN '1F8B' WHEN 1 THEN '1F8B08' WHEN 2 THEN '00' WHEN 3 THEN '28B52FFD' ELSE '425A6839' END AS head FROM pages)
SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'gzip' WHEN 1 THEN 'gzip' WHEN 2 THEN 'iso9660' WHEN 3 THEN 'zstd' ELSE 'bzip2' END AS kind,
 CASE page_id % 5 WHEN 0 THEN 'a.tar' WHEN 1 THEN 'B.TAR' WHEN 2 THEN 'c.iso~unpacked' WHEN 3 THEN 'd' ELSE 'e~unpacked' END AS inner_name,
 split_part(url, '/', -1) AS leaf, CASE WHEN length(url) >= 1024 THEN printf('%.1f KiB', length(url) / 1024.0) ELSE printf('%.1f B', length(url) * 1.0) END AS shown FROM f""")
def sniffed_kinds(t):
    pick = lambda *xs: F.element_at(F.array(*map(F.lit, xs)), (F.col("page_id") % 5 + 1).cast("int"))
    name, head = pick("a.tgz", "B.TAR.GZ", "c.iso", "d.zst", "e"), F.unhex(pick("1F8B", "1F8B08", "00", "28B52FFD", "425A6839"))
    f = t.pages.select("page_id", "url", name.alias("name"), head.alias("head")).withColumn("kind", containers.sniff(F.col("head"), F.col("name")))
    return f.select("page_id", "kind", containers.unwrapped_name(F.col("name"), F.col("kind")).alias("inner_name"), claims.leaf(F.col("url")).alias("leaf"), claims.human_size(F.length("url")).alias("shown"))


@C.query("""SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'http://h/debian/' WHEN page_id % 3 = 1 THEN 'http://h/u/' ELSE 'https://h.org/' END AS base, CASE WHEN page_id % 3 = 0 THEN 'pool/x/' || page_id WHEN page_id % 3 = 1 THEN 'dists/y' ELSE 'z/' || page_id END AS path,
 'a b+' || page_id || '%zz' AS decoded FROM pages""")
def link_parts(t):
    k = F.col("page_id")
    url = F.when(k % 3 == 0, F.concat(F.lit("http://h/debian/pool/x/"), k)).when(k % 3 == 1, F.lit("http://h/u/dists/y")).otherwise(F.concat(F.lit("https://h.org/z/"), k))
    cut = containers.mirror_split(url)
    return t.pages.select("page_id", cut["base"].alias("base"), cut["path"].alias("path"), claims.percent_decoded(F.concat(F.lit("a%20b+"), k, F.lit("%zz"))).alias("decoded"))


@C.query("""SELECT 'sha256' AS scheme, file_id, d AS digest FROM (SELECT doc_id AS file_id, sha256(text) AS d, doc_id % 3 AS k FROM documents) WHERE k = 0 UNION ALL
 SELECT 'sha1', doc_id, sha1(text) FROM documents WHERE doc_id % 3 = 1 UNION ALL SELECT 'md5', doc_id, md5(text) FROM documents WHERE doc_id % 3 = 2""")
def strongest_coordinate(t):
    made = digests.digest_columns(digests.as_bytes(F.col("text")), blake=False)
    k = F.col("doc_id") % 3
    wide = t.documents.select(F.col("doc_id").alias("file_id"), made["md5"].alias("md5"), F.when(k <= 1, made["sha1"]).alias("sha1"), F.when(k == 0, made["sha256"]).alias("sha256"))
    return lookup.strongest(lookup.unpivoted(wide, ["md5", "sha1", "sha256"], ["file_id"]), ["file_id"], "scheme", ["sha256", "sha512", "sha1", "md5"])
