"""Documents that state digests, as rows: checksum lists, package stanzas, JSON listings, dumps of JSON lines, tabular dumps, rpm metadata."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: schemes by the number of hex digits in a checksum document.
WIDTHS = {32: "md5", 40: "sha1", 64: "sha256", 128: "sha512"}
FORMULA = "array<struct<name:string,versions:struct<stable:string>,urls:struct<stable:struct<url:string,checksum:string>>>>"
SOURCES = "struct<sources:array<struct<type:string,urls:array<string>,integrity:string,outputHashMode:string>>>"


def checksum_rows(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """scheme, digest, filename from lines '<hex>  <file>' and 'NAME (file) = <hex>'; signature blocks and other lines give none."""
    line = docs.select(*keep, F.explode(F.split(text, "\r?\n")).alias("line"))
    plain, tagged = r"^([0-9A-Fa-f]{32,128})[ \t]+\*?(.+?)\s*$", r"^[A-Za-z0-9/-]+ ?\((.+)\) ?= ?([0-9A-Fa-f]{32,128})\s*$"
    is_plain = F.col("line").rlike(plain)
    hexed = F.lower(F.when(is_plain, F.regexp_extract("line", plain, 1)).otherwise(F.regexp_extract("line", tagged, 2)))
    name = F.when(is_plain, F.regexp_extract("line", plain, 2)).otherwise(F.regexp_extract("line", tagged, 1))
    scheme = F.try_element_at(F.create_map(*[F.lit(x) for pair in WIDTHS.items() for x in pair]), F.length(hexed))
    return line.select(*keep, scheme.alias("scheme"), hexed.alias("digest"), name.alias("filename")).where("scheme is not null")


def fields_of(stanza: Column) -> Column:
    """A map of the single-line fields of an RFC 822 stanza; the first of a name holds."""
    lines = F.filter(F.split(stanza, "\n"), lambda x: x.rlike("^[A-Za-z0-9-]+:"))
    pairs = F.transform(lines, lambda x: F.struct(F.substring_index(x, ":", 1).alias("k"), F.trim(F.substring(x, F.instr(x, ":") + 1, F.length(x))).alias("v")))
    first = F.filter(pairs, lambda p: F.element_at(F.filter(pairs, lambda q: q["k"] == p["k"]), 1)["v"] == p["v"])
    return F.map_from_entries(F.array_distinct(first))


def package_stanzas(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """One row for each package stanza with a SHA256: name, version, arch, filename and its four digests."""
    stanza = docs.select(*keep, F.explode(F.split(text, "\n\n+")).alias("s")).where(F.col("s").contains("SHA256:")).select(*keep, fields_of(F.col("s")).alias("f"))
    pick = lambda k, name: F.try_element_at("f", F.lit(k)).alias(name)
    return stanza.select(*keep, pick("Package", "name"), pick("Version", "version"), pick("Architecture", "arch"), pick("Filename", "filename"), pick("SHA256", "sha256"), pick("SHA1", "sha1"), pick("MD5sum", "md5"), pick("SHA512", "sha512")).where("filename is not null")


def source_stanzas(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """name, version, filename, sha256, md5 from source stanzas: an md5 belongs to the sha256 of the same file in its stanza."""
    stanza = docs.select(*keep, F.explode(F.split(text, "\n\n+")).alias("s")).where(F.col("s").contains("Checksums-Sha256:"))

    def block(field: str) -> Column:
        body = F.regexp_extract(F.concat(F.col("s"), F.lit("\n")), f"(?m)^{field}:\\s*\\n((?: .*\\n)+)", 1)
        lines = F.filter(F.transform(F.split(body, "\n"), lambda x: F.split(F.trim(x), r"\s+")), lambda x: F.size(x) == 3)
        return F.transform(lines, lambda x: F.struct(x[2].alias("filename"), x[0].alias("digest")))

    taken = stanza.select(*keep, fields_of(F.col("s")).alias("f"), block("Files").alias("md5s"), block("Checksums-Sha256").alias("files"))
    rows = taken.select(*keep, F.try_element_at("f", F.lit("Package")).alias("name"), F.try_element_at("f", F.lit("Version")).alias("version"), "md5s", F.explode("files").alias("c"))
    md5 = F.element_at(F.filter("md5s", lambda m: m["filename"] == F.col("c.filename"))["digest"], 1)
    return rows.select(*keep, "name", "version", F.col("c.filename").alias("filename"), F.col("c.digest").alias("sha256"), F.when(F.size(F.filter("md5s", lambda m: m["filename"] == F.col("c.filename"))) > 0, md5).alias("md5"))


def formulae(docs: DataFrame, json: str) -> DataFrame:
    """name, version, loc, sha256 of a JSON array of formulae with a stable download."""
    f = docs.select(F.explode(F.from_json(json, FORMULA)).alias("f"))
    return f.select("f.name", F.col("f.versions.stable").alias("version"), F.col("f.urls.stable.url").alias("loc"), F.lower("f.urls.stable.checksum").alias("sha256")).where("sha256 rlike '^[0-9a-f]{64}$'")


def flat_sources(docs: DataFrame, json: str) -> DataFrame:
    """filename, loc, sha256 of flat url sources with an SRI integrity; a link that holds the digest is preferred."""
    s = docs.select(F.explode(F.from_json(json, SOURCES)["sources"]).alias("s")).where("s.type = 'url' and coalesce(s.outputHashMode, 'flat') = 'flat' and s.integrity like 'sha256-%'")
    digest = F.lower(F.hex(F.try_to_binary(F.substring("s.integrity", 8, 100), F.lit("base64"))))
    addressed = F.filter("s.urls", lambda u: u.contains("/sha256/"))
    link = F.when(F.size(addressed) > 0, F.element_at(addressed, 1)).otherwise(F.element_at("s.urls", 1))
    first = F.element_at("s.urls", 1)
    return s.select(F.element_at(F.split(first, "/"), -1).alias("filename"), link.alias("loc"), digest.alias("sha256")).where(F.length("sha256") == 64)


def active_files(spark: SparkSession, path: str) -> DataFrame:
    """File entities of a dump of JSON lines: bad lines and entities that are not active go; the first web-archive link is kept apart."""
    schema = "state string, ident string, sha256 string, sha1 string, md5 string, size long, mimetype string, urls array<struct<url:string,rel:string>>, release_ids array<string>"
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path).where("state = 'active'")
    archived = F.filter("urls", lambda u: u["rel"] == "webarchive")
    return rows.withColumn("wayback_url", F.when(F.size(archived) > 0, F.element_at(archived["url"], 1))).drop("state")


def authors(contribs: Column) -> Column:
    """Names of authors in order; a raw name stands in where no display name is known."""
    mine = F.filter(contribs, lambda c: F.coalesce(c["role"], F.lit("author")) == "author")
    return F.filter(F.transform(F.array_sort(mine), lambda c: F.coalesce(c["display_name"], c["raw_name"])), lambda n: n.isNotNull())


def dump(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A tab-separated dump; - is null."""
    return spark.read.option("sep", "\t").option("nullValue", "-").option("quote", "").schema(schema).csv(path)


def write_dump(rows: DataFrame, path: str) -> None:
    """Distinct rows as a tab-separated dump; a separator or line break within a value must not be published."""
    bad = F.exists(F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in rows.columns]), lambda x: x.rlike("[\t\n]"))
    broken = rows.where(bad).limit(1).collect()
    if broken:
        raise ValueError(f"separator within a value: {broken[0].asDict()}")
    rows.distinct().write.option("sep", "\t").option("nullValue", "-").option("quote", "").option("compression", "gzip").csv(path)


def kept_captures(captures: DataFrame) -> DataFrame:
    """Captures worth keeping: status 200, with digest and type, whole, and no web page."""
    return captures.where("fetch_status = 200 and content_digest is not null and mime is not null and content_truncated is null and mime not in ('text/html', 'application/xhtml+xml')")


def rpm_packages(spark: SparkSession, path: str) -> DataFrame:
    """pkgid, scheme, name, evr, arch, location of a repository's primary metadata."""
    from digestlake.functions.claims import evr

    rows = spark.read.format("xml").option("rowTag", "package").load(path)
    v = "version"
    return rows.select(F.lower("checksum._VALUE").alias("pkgid"), F.col("checksum._type").alias("scheme"), "name", evr(F.col(f"{v}._epoch").cast("string"), F.col(f"{v}._ver").cast("string"), F.col(f"{v}._rel").cast("string")).alias("evr"), "arch", F.col("location._href").alias("location")).where("arch in ('x86_64', 'noarch') and location not like '%${%'")
