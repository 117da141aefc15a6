"""Queries on parsed documents, containers, recipes and trees."""

import gzip
import io
import tarfile
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import functions as F

from digestlake.functions import digests
from digestlake.operators import recipes
from digestlake.plans.registry import Catalogue
from digestlake.sources import descent, parsers

C = Catalogue()


@C.query("""SELECT doc_id, 'sha256' AS scheme, sha256(text) AS digest, 'f' || doc_id || '.txt' AS filename FROM documents
UNION ALL SELECT doc_id, 'md5', md5(text), 'g ' || doc_id FROM documents UNION ALL SELECT doc_id, 'sha1', sha1(text), 'h' || doc_id FROM documents""")
def checksum_parser(t):
    k = F.col("doc_id").cast("string")
    text = F.concat(F.lit("# list\n-----BEGIN PGP SIGNED MESSAGE-----\n"), F.sha2("text", 256), F.lit("  f"), k, F.lit(".txt\n"), F.upper(F.md5("text")), F.lit(" *g "), k, F.lit("\r\nSHA1 (h"), k, F.lit(") = "), F.sha1("text"), F.lit("\nabc  short\n"))
    return parsers.checksum_rows(t.documents.select("doc_id", text.alias("text")), "text", ["doc_id"])


@C.query("""SELECT doc_id, 'p' || doc_id AS name, '1:2.' || (doc_id % 7) AS version, lang AS arch, 'pool/' || source || '/x.deb' AS filename, sha256(text) AS sha256, sha1(text) AS sha1, md5(text) AS md5, NULL::VARCHAR AS sha512 FROM documents""")
def stanza_parser(t):
    k = F.col("doc_id").cast("string")
    text = F.concat_ws("\n", F.concat(F.lit("Package: p"), k), F.concat(F.lit("Version: 1:2."), F.col("doc_id") % 7), F.concat(F.lit("Architecture: "), "lang"), F.concat(F.lit("Filename: pool/"), "source", F.lit("/x.deb")), F.lit("Description: a\n more: text"), F.concat(F.lit("MD5sum: "), F.md5("text")), F.concat(F.lit("SHA1: "), F.sha1("text")), F.concat(F.lit("SHA256: "), F.sha2("text", 256)), F.lit("\nPackage: virtual"))
    return parsers.package_stanzas(t.documents.select("doc_id", text.alias("text")), "text", ["doc_id"])


@C.query("""SELECT doc_id, 's' || doc_id AS name, '3' AS version, unnest(['a.tar', 'b.dsc']) AS filename, unnest([sha256(text), sha256(lang)]) AS sha256, unnest([md5(text), NULL]) AS md5 FROM documents""")
def source_stanza_parser(t):
    k = F.col("doc_id").cast("string")
    text = F.concat(F.lit("Package: s"), k, F.lit("\nVersion: 3\nFiles:\n "), F.md5("text"), F.lit(" 10 a.tar\nChecksums-Sha256:\n "), F.sha2("text", 256), F.lit(" 10 a.tar\n "), F.sha2("lang", 256), F.lit(" 7 b.dsc\n"))
    return parsers.source_stanzas(t.documents.select("doc_id", text.alias("text")), "text", ["doc_id"])


@C.query("""SELECT 'n' || doc_id AS name, '1.' || doc_id AS version, 'https://x/' || doc_id AS loc, sha256(text) AS sha256 FROM documents WHERE doc_id % 3 <> 0""")
def formula_parser(t):
    k = F.col("doc_id").cast("string")
    sha = F.when(F.col("doc_id") % 3 != 0, F.sha2("text", 256))
    one = F.struct(F.concat(F.lit("n"), k).alias("name"), F.struct(F.concat(F.lit("1."), k).alias("stable")).alias("versions"), F.struct(F.struct(F.concat(F.lit("https://x/"), k).alias("url"), sha.alias("checksum")).alias("stable")).alias("urls"))
    return parsers.formulae(t.documents.select(F.to_json(F.array(one)).alias("json")), "json")


@C.query("""SELECT 'a' || doc_id AS filename, CASE WHEN doc_id % 2 = 0 THEN 'https://m/sha256/' || doc_id ELSE 'https://h/a' || doc_id END AS loc, sha256(text) AS sha256 FROM documents WHERE doc_id % 5 <> 0""")
def flat_source_parser(t):
    k = F.col("doc_id").cast("string")
    urls = F.filter(F.array(F.concat(F.lit("https://h/a"), k), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("https://m/sha256/"), k))), lambda u: u.isNotNull())
    mode = F.when(F.col("doc_id") % 5 == 0, "recursive")
    one = F.struct(F.lit("url").alias("type"), urls.alias("urls"), F.concat(F.lit("sha256-"), F.base64(F.unhex(F.sha2("text", 256)))).alias("integrity"), mode.alias("outputHashMode"))
    return parsers.flat_sources(t.documents.select(F.to_json(F.struct(F.array(one).alias("sources"))).alias("json")), "json")


@C.query("""SELECT page_id, url FROM pages WHERE page_id % 4 = 0 AND page_id % 3 <> 0""")
def kept_captures(t):
    k = F.col("page_id")
    rows = t.pages.select("page_id", "url", F.when(k % 3 == 0, 404).otherwise(200).alias("fetch_status"), F.md5("html").alias("content_digest"), F.when(k % 4 == 0, "application/pdf").when(k % 4 == 1, "text/html").when(k % 4 == 2, None).otherwise("application/xhtml+xml").alias("mime"), F.lit(None).cast("string").alias("content_truncated"))
    return parsers.kept_captures(rows).select("page_id", "url")


def _archives(t):
    """A container of each conversation's turns: tar, gzipped tar or zip by its id."""
    turns = t.conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("turns"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = []
            for conv, turns in zip(b.column("conv_id").to_pylist(), b.column("turns").to_pylist(), strict=True):
                out = io.BytesIO()
                if conv % 3 == 2:
                    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
                        for x in turns:
                            z.writestr(zipfile.ZipInfo(f"turn-{x['turn']}.txt"), x["text"] or "")
                else:
                    with tarfile.open(fileobj=out, mode="w", format=tarfile.USTAR_FORMAT) as tar:
                        for x in turns:
                            body = (x["text"] or "").encode()
                            info = tarfile.TarInfo(f"talk/turn-{x['turn']}.txt")
                            info.size = len(body)
                            tar.addfile(info, io.BytesIO(body))
                made.append(gzip.compress(out.getvalue(), 6, mtime=0) if conv % 3 == 1 else out.getvalue())
            names = [f"c{conv}" + (".tar", ".tar.gz", ".zip")[conv % 3] for conv in b.column("conv_id").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(made, pa.binary())], ["path", "content"])

    return turns.mapInArrow(pack, "path string, content binary")


@C.query("""SELECT 'c' || conv_id || ['.tar', '.tar.gz', '.zip'][conv_id % 3 + 1] AS root, CASE WHEN conv_id % 3 = 1 THEN 2 ELSE 1 END AS depth, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS size, sha256(coalesce(text, '')) AS sha256, md5(coalesce(text, '')) AS md5,
 'c' || conv_id || CASE conv_id % 3 WHEN 0 THEN '.tar!talk/' WHEN 1 THEN '.tar.gz!c' || conv_id || '.tar!talk/' ELSE '.zip!' END || 'turn-' || turn || '.txt' AS path FROM conversations""")
def descend_members(t):
    members = descent.descend(_archives(t))
    inner = members.select("root", F.col("parent_id").alias("member_id")).where("member_id is not null").distinct()
    return members.join(inner, ["root", "member_id"], "left_anti").select("root", "depth", "size", "sha256", "md5", "path")


@C.query()
def recipe_mint(t):
    archives = _archives(t)
    members = descent.descend(archives).where("depth > 0 and size >= 32").select("root", "sha256", F.concat(F.lit("https://blobs/"), "sha256").alias("url")).distinct()
    made = recipes.minted(archives, members)
    return made.select("path", F.sha2("recipe", 256).alias("recipe"), F.length("recipe").cast("long").alias("size"), "fetchable", "left")


@C.query()
def git_tree(t):
    name = F.concat(F.col("role"), F.lit("/"), F.col("turn").cast("string"))
    rows = t.conversations.select(F.col("conv_id").alias("root"), name.alias("path"), digests.git_blob(F.encode(F.coalesce("text", F.lit("")), "utf-8")).alias("blob"), F.lit(False).alias("executable"))
    return recipes.git_trees(rows)
