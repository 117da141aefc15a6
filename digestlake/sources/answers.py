"""Live sources without the wire: what to ask each for a digest, and what its answer says, as findings.

Requests and answers are rows. Whoever may reach the network sends the requests (scheduling and quotas are theirs) and hands the
answers back with their status; files of recorded answers do as well. A 404, or an answer that names nothing, is a definite miss.
"""

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from digestlake.functions.claims import claim, registry_url

#: Results of which each is stated; the rest is counted.
PACKAGES_SHOWN, LOCATIONS_SHOWN = 10, 5
CLAIM = "array<struct<statement:string,url:string>>"
COORD = "array<struct<scheme:string,digest:string>>"


@dataclass(frozen=True)
class Source:
    """A live source: the schemes it can be asked by, its request, and its answer as columns of claims and coordinates."""

    name: str
    schemes: tuple[str, ...]
    request: Callable[[Column, Column], Column]
    claims: Callable[[Column, Column], Column]
    coords: Callable[[Column], Column]


def _none(kind: str) -> Column:
    return F.array().cast(kind)


def _request(method: str, url: Column, body: Column | None = None) -> Column:
    return F.struct(F.lit(method).alias("method"), url.alias("url"), (F.lit(None).cast("string") if body is None else body).alias("body"))


def _stated(items: Column, shown: int, each: Callable[[Column], Column], more: str) -> Column:
    """Claims of the first items, those that can be read, and how many more there are."""
    made = F.filter(F.transform(F.slice(items, 1, shown), each), lambda c: c["statement"].isNotNull())
    rest = F.when(F.size(items) > shown, F.array(claim(F.format_string(f"… and %s more {more}", F.size(items) - shown), F.lit(None).cast("string")))).otherwise(_none(CLAIM))
    return F.concat(made, rest)


PACKAGES = "struct<results:array<struct<version:struct<versionKey:struct<system:string,name:string,version:string>,publishedAt:string>>>>"


def _package_claims(body: Column, _: Column) -> Column:
    def each(r: Column) -> Column:
        key = r["version"]["versionKey"]
        published = F.coalesce(F.concat(F.lit(", published "), F.substring(r["version"]["publishedAt"], 1, 10)), F.lit(""))
        return claim(F.concat(F.lower(key["system"]), F.lit(": "), key["name"], F.lit("@"), key["version"], published), registry_url(key["system"], key["name"], key["version"]))

    return _stated(F.coalesce(F.from_json(body, PACKAGES)["results"], F.array().cast("array<struct<version:struct<versionKey:struct<system:string,name:string,version:string>,publishedAt:string>>>")), PACKAGES_SHOWN, each, "results")


def _field(body: Column, path: str) -> Column:
    return F.get_json_object(body, path)


def _known_file_claims(body: Column, _: Column) -> Column:
    nothing = F.lit(None).cast("string")
    name, size, base = _field(body, "$.FileName"), _field(body, "$.FileSize"), F.coalesce(_field(body, "$.db"), _field(body, "$.source"))
    told = F.concat(F.lit("known file: "), name, F.coalesce(F.concat(F.lit(", "), size, F.lit(" bytes")), F.lit("")), F.coalesce(F.concat(F.lit(" ["), base, F.lit("]")), F.lit("")))
    product = F.concat(F.lit("product: "), _field(body, "$.ProductCode.ProductName"))
    parents = F.concat(F.lit("appears in "), _field(body, "$['hashlookup:parent-total']"), F.lit(" parent package(s)"))
    made = F.filter(F.array(*[claim(x, nothing) for x in (told, product, parents)]), lambda c: c["statement"].isNotNull())
    plain = F.array(claim(F.lit("present in hashlookup corpus"), nothing))
    empty = _field(body, "$.message").isNotNull() & name.isNull()
    return F.when(empty, _none(CLAIM)).otherwise(F.when(F.size(made) == 0, plain).otherwise(made))


def _coords_at(paths: dict[str, str]) -> Callable[[Column], Column]:
    def find(body: Column) -> Column:
        each = [F.struct(F.lit(scheme).alias("scheme"), F.lower(_field(body, path)).alias("digest")) for scheme, path in paths.items()]
        return F.filter(F.array(*each), lambda c: c["digest"].isNotNull())

    return find


def _blob_claims(body: Column, _: Column) -> Column:
    length = F.coalesce(_field(body, "$.length"), F.lit("0"))
    url = F.concat(F.lit("https://archive.softwareheritage.org/"), F.coalesce(_field(body, "$.swhid"), F.lit("")))
    return F.array(claim(F.concat(F.lit("archived source blob, "), length, F.lit(" bytes")), url))


LOCATIONS = "struct<result:array<struct<name:string,path:string,archive_name:string,first_seen:string>>>"


def _location_claims(body: Column, digest: Column) -> Column:
    def each(r: Column) -> Column:
        archive, seen = F.coalesce(r["archive_name"], F.lit("debian")), F.coalesce(r["first_seen"], F.lit(""))
        told = F.concat(r["name"], F.lit(" in "), archive, r["path"], F.lit(" (first seen "), seen, F.lit(")"))
        return claim(told, F.concat(F.lit("https://snapshot.debian.org/archive/"), archive, F.lit("/"), seen, r["path"], F.lit("/"), r["name"]))

    found = F.coalesce(F.from_json(body, LOCATIONS)["result"], F.array().cast("array<struct<name:string,path:string,archive_name:string,first_seen:string>>"))
    raw = F.array(claim(F.lit("raw bytes by hash"), F.concat(F.lit("https://snapshot.debian.org/file/"), digest)))
    return F.when(F.size(found) > 0, F.concat(_stated(found, LOCATIONS_SHOWN, each, "locations"), raw)).otherwise(_none(CLAIM))


def _signing_claims(body: Column, digest: Column) -> Column:
    n = F.size(F.coalesce(F.from_json(body, "array<string>"), F.array().cast("array<string>")))
    told = F.concat(n.cast("string"), F.lit(" signing event"), F.when(n == 1, "").otherwise("s"), F.lit(" in the transparency log"))
    return F.when(n > 0, F.array(claim(told, F.concat(F.lit("https://search.sigstore.dev/?hash="), digest)))).otherwise(_none(CLAIM))


#: Addresses, fields and schemes of the public services.
SOURCES = [
    Source(
        "deps.dev", ("md5", "sha1", "sha256", "sha512"),
        lambda scheme, digest: _request("GET", F.concat(F.lit("https://api.deps.dev/v3/query?hash.type="), F.upper(scheme), F.lit("&hash.value="), F.url_encode(F.base64(F.unhex(digest))))),
        _package_claims, lambda body: _none(COORD),
    ),
    Source(
        "circl", ("md5", "sha1", "sha256", "sha512"),
        lambda scheme, digest: _request("GET", F.concat(F.lit("https://hashlookup.circl.lu/lookup/"), scheme, F.lit("/"), digest)),
        _known_file_claims, _coords_at({"md5": "$.MD5", "sha1": "$['SHA-1']", "sha256": "$['SHA-256']", "sha512": "$['SHA-512']"}),
    ),
    Source(
        "swh", ("sha1", "sha256", "sha1_git", "blake2s256"),
        lambda scheme, digest: _request("GET", F.concat(F.lit("https://archive.softwareheritage.org/api/1/content/"), scheme, F.lit(":"), digest, F.lit("/"))),
        _blob_claims, _coords_at({s: f"$.checksums.{s}" for s in ("sha1", "sha256", "sha1_git", "blake2s256")}),
    ),
    Source(
        "snapshot", ("sha1",),
        lambda scheme, digest: _request("GET", F.concat(F.lit("https://snapshot.debian.org/mr/file/"), digest, F.lit("/info"))),
        _location_claims, lambda body: _none(COORD),
    ),
    Source(
        "rekor", ("sha1", "sha256", "sha512"),
        lambda scheme, digest: _request("POST", F.lit("https://rekor.sigstore.dev/api/v1/index/retrieve"), F.to_json(F.struct(F.concat(scheme, F.lit(":"), digest).alias("hash")))),
        _signing_claims, lambda body: _none(COORD),
    ),
]


def requests(asked: DataFrame) -> DataFrame:
    """source, scheme, digest, method, url, body: what to send for the asked digests (scheme, digest), to each source that knows the scheme."""
    made = [F.when(F.col("scheme").isin(*s.schemes), F.struct(F.lit(s.name).alias("source"), s.request(F.col("scheme"), F.col("digest")).alias("r"))) for s in SOURCES]
    each = asked.select("scheme", "digest", F.explode(F.filter(F.array(*made), lambda r: r.isNotNull())).alias("x"))
    return each.select("x.source", "scheme", "digest", "x.r.method", "x.r.url", "x.r.body")


def findings(answers: DataFrame) -> DataFrame:
    """answers (source, scheme, digest, status, body) with hit, claims and coords: null where the source failed, which is no answer.

    A status of 404 and an answer that says nothing are misses, with no claims. Rows of unknown sources are left out.
    """
    pick = lambda of: F.coalesce(*[F.when(F.col("source") == s.name, of(s)) for s in SOURCES])
    good, gone = F.col("status").between(200, 299), F.col("status") == 404
    claims = F.when(good, pick(lambda s: s.claims(F.col("body"), F.col("digest")))).when(gone, _none(CLAIM))
    told = answers.where(F.col("source").isin(*[s.name for s in SOURCES])).withColumn("claims", claims)
    hit = F.size("claims") > 0
    coords = F.when(hit, pick(lambda s: s.coords(F.col("body")))).when(F.col("claims").isNotNull(), _none(COORD))
    return told.select("source", "scheme", "digest", F.when(F.col("claims").isNotNull(), hit).alias("hit"), "claims", coords.alias("coords"))
