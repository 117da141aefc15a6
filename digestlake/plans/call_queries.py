"""Queries on whole calls: resolving digests, scanning files, reading the answers of live sources."""

from pyspark.sql import functions as F

from digestlake.operators import resolve
from digestlake.plans.registry import Catalogue
from digestlake.sources import answers

C = Catalogue()


@C.query("""WITH d AS (SELECT doc_id, md5(text) AS m, sha256(text) AS s FROM documents),
g AS (SELECT m, count(DISTINCT s) AS n FROM d GROUP BY m),
a AS (SELECT doc_id * 2 AS query_id, 'md5' AS scheme, m AS digest, m, NULL AS error FROM d UNION ALL SELECT doc_id * 2 + 1, NULL, NULL, NULL, 'wrong length' FROM d)
SELECT query_id, scheme, digest, error, CAST(coalesce(n, 0) AS BIGINT) AS clusters, coalesce(n, 0) > 1 AS collision, false AS truncated FROM a LEFT JOIN g USING (m)""")
def resolve_digests(t):
    """Every document's md5, in capitals with its scheme, and as many that cannot be read; findings state md5 and sha256 of each distinct text."""
    d = t.documents.select("doc_id", F.md5("text").alias("md5"), F.sha2("text", 256).alias("sha256")).where("md5 is not null")
    asked = d.select((F.col("doc_id") * 2).alias("query_id"), F.concat(F.lit(" MD5:"), F.upper("md5")).alias("text")).unionByName(d.select((F.col("doc_id") * 2 + 1).alias("query_id"), F.lit("sha1:abcd").alias("text")))
    coord = lambda s: F.struct(F.lit(s).alias("scheme"), F.col(s).alias("digest"))
    findings = d.groupBy("md5", "sha256").agg(F.min("doc_id").alias("finding_id")).select("finding_id", F.array(coord("md5"), coord("sha256")).alias("coords"))
    return resolve.resolve(asked, findings)[0]


@C.query("""WITH f AS (SELECT 'd/' || doc_id AS path, octet_length(encode(text)) AS size, sha256(text) AS s, sha1(text) AS h, doc_id FROM documents),
r AS (SELECT s FROM f WHERE doc_id % 3 = 0), w AS (SELECT h FROM f WHERE doc_id % 3 = 1)
SELECT path, CAST(size AS BIGINT) AS size, s AS sha256, CASE WHEN size < 32 THEN 'floor' WHEN s IN (SELECT s FROM r) THEN 'identified' WHEN h IN (SELECT h FROM w) THEN 'consistent' ELSE 'unknown' END AS class FROM f""")
def scan_files(t):
    """Documents as files; a third has a witness of its sha256, a third one of its sha1."""
    raw = F.encode(F.coalesce("text", F.lit("")), "utf-8")
    d = t.documents.select("doc_id", raw.alias("content"))
    files = d.select(F.concat(F.lit("d/"), F.col("doc_id").cast("string")).alias("path"), "content")
    k, none = F.col("doc_id") % 3, F.lit(None).cast("string")
    rows = d.where(k < 2).select(F.col("doc_id").alias("row_id"), F.when(k == 1, F.sha1("content")).otherwise(none).alias("sha1"), F.when(k == 0, F.sha2("content", 256)).otherwise(none).alias("sha256"))
    return resolve.scan(files, rows).select("path", "size", "sha256", "class")


@C.query("""SELECT 'circl' AS source, md5(text) AS digest, true AS hit, 'known file: ' || source || ', ' || n_chars || ' bytes [nsrl]' AS statement, NULL AS url, 2 AS coords FROM documents WHERE text IS NOT NULL
UNION ALL SELECT 'swh', sha1(text), true, 'archived source blob, ' || n_chars || ' bytes', 'https://archive.softwareheritage.org/swh:1:cnt:' || doc_id, 2 FROM documents WHERE text IS NOT NULL
UNION ALL SELECT 'deps.dev', sha1(text), true, 'npm: ' || source || '@' || doc_id || ', published 2024-01-02', 'https://www.npmjs.com/package/' || source || '/v/' || doc_id, 0 FROM documents WHERE text IS NOT NULL
UNION ALL SELECT 'snapshot', sha1(text), true, source || ' in debian/pool (first seen 20240102T000000Z)', 'https://snapshot.debian.org/archive/debian/20240102T000000Z/pool/' || source, 0 FROM documents WHERE text IS NOT NULL
UNION ALL SELECT 'rekor', sha256(text), true, '2 signing events in the transparency log', 'https://search.sigstore.dev/?hash=' || sha256(text), 0 FROM documents WHERE text IS NOT NULL
UNION ALL SELECT 'rekor', md5(text), false, NULL, NULL, 0 FROM documents WHERE text IS NOT NULL""")
def source_answers(t):
    """Answers of the five live sources made up from documents: the first claim of each, and how many digests it states."""
    d = t.documents.where("text is not null").withColumns({"md5": F.md5("text"), "sha1": F.sha1("text"), "sha256": F.sha2("text", 256)})
    source, n, k = F.col("source"), F.col("n_chars").cast("string"), F.col("doc_id").cast("string")
    field = lambda **x: F.to_json(F.struct(*[v.alias(key.replace("_DASH_", "-")) for key, v in x.items()]))
    version = F.struct(F.struct(F.lit("NPM").alias("system"), source.alias("name"), k.alias("version")).alias("versionKey"), F.lit("2024-01-02T03:04:05Z").alias("publishedAt"))
    place = F.struct(source.alias("name"), F.lit("/pool").alias("path"), F.lit("20240102T000000Z").alias("first_seen"))
    told = [
        ("circl", "md5", field(FileName=source, FileSize=n, db=F.lit("nsrl"), MD5=F.upper("md5"), SHA_DASH_1=F.upper("sha1"))),
        ("swh", "sha1", field(swhid=F.concat(F.lit("swh:1:cnt:"), k), length=F.col("n_chars"), checksums=F.struct("sha1", "sha256"))),
        ("deps.dev", "sha1", field(results=F.array(F.struct(version.alias("version"))))),
        ("snapshot", "sha1", field(result=F.array(place))),
        ("rekor", "sha256", F.lit('["a", "b"]')),
        ("rekor", "md5", F.lit("[]")),
    ]
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("source"), F.lit(c).alias("scheme"), F.col(c).alias("digest"), F.lit(200).alias("status"), body.alias("body")) for s, c, body in told]))
    found = answers.findings(d.select(each.alias("a")).select("a.*"))
    first = F.try_element_at("claims", F.lit(1))
    return found.select("source", "digest", "hit", first["statement"].alias("statement"), first["url"].alias("url"), F.size("coords").alias("coords"))
