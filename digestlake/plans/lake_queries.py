"""Queries on lookups, identity, verdicts, state, byte ranges and table builds."""

from pyspark.sql import functions as F

from digestlake.functions import digests
from digestlake.operators import etl, identity, intervals, lookup, observations, verdicts
from digestlake.plans.registry import Catalogue
from digestlake.session import stash

C = Catalogue()
WEAK = 3
#: The point in time that stands for now in the queries on answers.
NOW = "TIMESTAMP '2024-01-20 00:00:00'"


@C.query("""WITH w AS (SELECT sha256(text) AS sha256 FROM documents UNION SELECT sha256(html) FROM pages),
d AS (SELECT sha256(text) AS sha256, doc_id, source FROM documents),
r AS (SELECT d.*, row_number() OVER (PARTITION BY sha256 ORDER BY doc_id) AS pos, count(*) OVER (PARTITION BY sha256) AS total FROM d JOIN w USING (sha256))
SELECT sha256, doc_id, source, pos, total FROM r WHERE pos <= 2""")
def point_lookup_capped(t):
    """Every digest of documents, and those of pages, most of which are absent."""
    table = t.documents.select(F.sha2("text", 256).alias("sha256"), "doc_id", "source")
    return lookup.point_lookup(table, "sha256", table.select("sha256").unionByName(t.pages.select(F.sha2("html", 256).alias("sha256"))), ["doc_id"], 2)


@C.query(f"""WITH m AS (SELECT DISTINCT substr(md5(text), 1, {WEAK}) AS weak_key, sha256(text) AS sha256 FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY weak_key ORDER BY sha256) AS rank FROM m)
SELECT weak_key, sha256, rank, doc_id FROM r JOIN (SELECT sha256(text) AS sha256, doc_id FROM documents) USING (sha256) WHERE rank <= 3""")
def weak_to_strong(t):
    data = t.documents.select(F.sha2("text", 256).alias("sha256"), "doc_id")
    pairs = etl.weak_map(t.documents.select(F.substring(F.md5("text"), 1, WEAK).alias("weak_key"), F.sha2("text", 256).alias("sha256")), "weak_key", "sha256")
    return lookup.weak_to_strong(pairs, pairs, data, "sha256").select("weak_key", "sha256", "rank", "doc_id")


@C.query("""WITH u AS (SELECT doc_id, 'md5' AS scheme, md5(text) AS digest FROM documents UNION ALL SELECT doc_id, 'sha1', sha1(text) FROM documents UNION ALL SELECT doc_id, 'sha256', sha256(text) FROM documents),
q AS (SELECT DISTINCT CASE doc_id % 3 WHEN 0 THEN 'md5' WHEN 1 THEN 'sha1' ELSE 'sha256' END AS scheme, CASE doc_id % 3 WHEN 0 THEN md5(text) WHEN 1 THEN sha1(text) ELSE sha256(text) END AS digest FROM documents)
SELECT scheme, digest, doc_id FROM u JOIN q USING (scheme, digest)""")
def media_by_scheme(t):
    table = t.documents.select("doc_id", F.md5("text").alias("md5"), F.sha1("text").alias("sha1"), F.sha2("text", 256).alias("sha256"))
    pick = F.expr("CASE doc_id % 3 WHEN 0 THEN struct('md5' AS scheme, md5 AS digest) WHEN 1 THEN struct('sha1' AS scheme, sha1 AS digest) ELSE struct('sha256' AS scheme, sha256 AS digest) END")
    return lookup.by_scheme(table.select(pick.alias("q")).select("q.*").distinct(), table, ["md5", "sha1", "sha256"], ["doc_id"])


@C.query("""WITH p AS (SELECT p_partkey, p_name, row_number() OVER (ORDER BY p_partkey) - 1 AS row_id FROM part),
f AS (SELECT l_orderkey, l_linenumber, l_partkey - 1 AS pkg, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) AS pos, count(*) OVER (PARTITION BY l_partkey) AS total FROM lineitem)
SELECT l_orderkey, l_linenumber, pkg, pos, total, p_partkey, p_name FROM f JOIN p ON pkg = row_id WHERE pos <= 40""")
def positional_fk(t):
    packages = lookup.numbered(t.part.select("p_partkey", "p_name"), ["p_partkey"], "row_id")
    files = t.lineitem.select("l_orderkey", "l_linenumber", (F.col("l_partkey") - 1).alias("pkg"))
    return lookup.positional(files, packages, "pkg", "row_id", 40, ["pkg"], ["l_orderkey", "l_linenumber"])


@C.query("""WITH p AS (SELECT p_partkey, row_number() OVER (ORDER BY p_name, p_partkey) - 1 AS row_id FROM part), w AS (SELECT o_orderkey AS pos, o_orderkey % 3000 AS row_id FROM orders)
SELECT pos, row_id, p_partkey, p_partkey IS NOT NULL AS found FROM w LEFT JOIN p USING (row_id)""")
def rows_by_number(t):
    rows = lookup.numbered(t.part.select("p_name", "p_partkey"), ["p_name", "p_partkey"], "row_id").select("p_partkey", "row_id")
    return lookup.rows_at(rows, "row_id", t.orders.select(F.col("o_orderkey").alias("pos"), (F.col("o_orderkey") % 3000).alias("row_id")))


def _findings(t):
    """Three witnesses: all documents by sha256 and md5, odd ones by md5 and sha1, and a weak one that is often wrong."""
    d = t.documents.select("doc_id", F.sha2("text", 256).alias("sha256"), F.md5("text").alias("md5"), F.sha1("text").alias("sha1"), F.substring(F.md5("text"), 1, WEAK).alias("weak"))
    rows = [
        d.select((F.col("doc_id") * 3).alias("finding_id"), digests.coords_of({"sha256": "sha256", "sha1": "weak"}).alias("coords")),
        d.where("doc_id % 2 = 1").select((F.col("doc_id") * 3 + 1).alias("finding_id"), digests.coords_of({"md5": "md5", "sha256": "sha256"}).alias("coords")),
        d.where("doc_id % 4 = 0").select((F.col("doc_id") * 3 + 2).alias("finding_id"), digests.coords_of({"md5": "md5"}).alias("coords")),
    ]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


def _seeds(t):
    """Every distinct md5."""
    return t.documents.groupBy(F.md5("text").alias("digest")).agg(F.min("doc_id").alias("query_id")).select("query_id", F.lit("md5").alias("scheme"), "digest")


FINDINGS_SQL = f"""
s AS (SELECT doc_id * 3 AS finding_id, 'sha256' AS scheme, sha256(text) AS digest FROM documents UNION ALL SELECT doc_id * 3, 'sha1', substr(md5(text), 1, {WEAK}) FROM documents
 UNION ALL SELECT doc_id * 3 + 1, 'md5', md5(text) FROM documents WHERE doc_id % 2 = 1 UNION ALL SELECT doc_id * 3 + 1, 'sha256', sha256(text) FROM documents WHERE doc_id % 2 = 1
 UNION ALL SELECT doc_id * 3 + 2, 'md5', md5(text) FROM documents WHERE doc_id % 4 = 0),
w(query_id, scheme, digest, finding_id, hop) AS (
 SELECT min(doc_id), 'md5', md5(text), NULL::BIGINT, -1 FROM documents GROUP BY md5(text)
 UNION SELECT w.query_id, b.scheme, b.digest, a.finding_id, w.hop + 1 FROM w JOIN s a ON a.scheme = w.scheme AND a.digest = w.digest JOIN s b ON b.finding_id = a.finding_id WHERE w.hop < {{hops}} - 1)"""


WALK_SQL = f"WITH RECURSIVE {FINDINGS_SQL.format(hops=identity.MAX_HOPS)} SELECT query_id, finding_id, CAST(min(hop) AS BIGINT) AS hop FROM w WHERE finding_id IS NOT NULL GROUP BY query_id, finding_id"


@C.query(WALK_SQL)
def crosswalk_walk(t):
    """From every distinct md5, as far as the operator goes, with its bound of findings a query; in the tables that the SQL is run
    over, no query comes to the bound."""
    return identity.walk(_seeds(t), _findings(t)).select("query_id", "finding_id", "hop")


@C.query(WALK_SQL)
def crosswalk_walk_all(t):
    """The same without the bound."""
    return identity.walk(_seeds(t), _findings(t), cap=None).select("query_id", "finding_id", "hop")


@C.query("""WITH g AS (SELECT md5(text) AS m, list(doc_id ORDER BY doc_id) AS ids, any_value(sha256(text)) AS sha256 FROM documents GROUP BY md5(text))
SELECT d.doc_id AS query_id, len(g.ids) AS findings, sha256(array_to_string(g.ids, ',')) AS ids, true AS anchored, true AS "primary" FROM documents d JOIN g ON g.m = md5(d.text)""")
def identity_clusters(t):
    digest = [F.sha2("text", 256).alias("sha256"), F.md5("text").alias("md5"), F.sha1("text").alias("sha1")]
    d = t.documents.select("doc_id", *digest).where(F.col("md5").isNotNull())
    # exact copies state the same: the walk and the clusters are of one finding for each set of digests, which stands for its members
    sets = stash(d.groupBy("sha256", "md5", "sha1").agg(F.min("doc_id").alias("finding_id"), F.collect_list("doc_id").alias("members")), "sets")
    findings = sets.select("finding_id", digests.coords_of({"sha256": "sha256", "md5": "md5", "sha1": "sha1"}).alias("coords"))
    asked = sets.groupBy("md5").agg(F.min("finding_id").alias("query_id")).select("query_id", F.lit("md5").alias("scheme"), F.col("md5").alias("digest"))
    found = identity.clusters(identity.walk(asked, findings, cap=None), findings, asked)
    each = found.select("query_id", "cluster", "anchored", "primary", F.explode("finding_ids").alias("finding_id")).join(sets.select("finding_id", "members"), "finding_id")
    whole = each.groupBy("query_id", "cluster", "anchored", "primary").agg(F.sort_array(F.flatten(F.collect_list("members"))).alias("ids"))
    told = whole.select("query_id", F.size("ids").cast("long").alias("findings"), F.sha2(F.array_join(F.transform("ids", lambda x: x.cast("string")), ","), 256).alias("ids"), "anchored", "primary")
    told = stash(told.join(asked.select("query_id", F.col("digest").alias("md5")), "query_id").drop("query_id"), "told")
    return d.select(F.col("doc_id").alias("query_id"), "md5").join(told, "md5").drop("md5")


@C.query(f"""WITH d AS (SELECT DISTINCT substr(md5(text), 1, {WEAK}) AS weak, sha256(text) AS s FROM documents)
SELECT weak, count(*) AS clusters, count(*) >= 2 AS collision FROM d GROUP BY weak""")
def weak_collisions(t):
    d = t.documents.select("doc_id", F.sha2("text", 256).alias("sha256"), F.substring(F.md5("text"), 1, WEAK).alias("weak"))
    d = stash(d.groupBy("weak", "sha256").agg(F.min("doc_id").alias("doc_id")), "distinct")  # exact copies say the same
    findings = d.select(F.col("doc_id").alias("finding_id"), digests.coords_of({"sha256": "sha256", "md5": "weak"}).alias("coords"))
    asked = d.groupBy("weak").agg(F.min("doc_id").alias("query_id")).select("query_id", F.lit("md5").alias("scheme"), F.col("weak").alias("digest"))
    evidence = stash(identity.walk(asked, findings, hops=1, cap=None), "evidence")
    told = identity.statuses(identity.clusters(evidence, findings, asked), evidence, asked, cap=None)
    return told.join(asked, "query_id").select(F.col("digest").alias("weak"), "clusters", "collision")


@C.query(f"""WITH d AS (SELECT doc_id, substr(md5(text), 1, {WEAK}) AS weak, sha256(text) AS s FROM documents), q AS (SELECT min(s) AS s, weak FROM d GROUP BY weak)
SELECT d.doc_id, d.s <> q.s AS contradicted, CASE WHEN d.s <> q.s THEN 2 ELSE 2 END::BIGINT AS coords FROM d JOIN q USING (weak)""")
def contradiction_filter(t):
    d = t.documents.select("doc_id", F.substring(F.md5("text"), 1, WEAK).alias("weak"), F.sha2("text", 256).alias("s"))
    q = d.groupBy("weak").agg(F.min("s").alias("digest"))
    findings = d.select(F.col("doc_id").alias("finding_id"), digests.coords_of({"sha256": "s", "md5": "weak"}).alias("coords"))
    evidence = d.join(q, "weak").select(F.col("doc_id").alias("finding_id"), F.lit("sha256").alias("scheme"), "digest")
    made = identity.coordinates(evidence, findings)
    asked = F.struct("scheme", "digest")
    return made.select(F.col("finding_id").alias("doc_id"), (~F.array_contains("coords", asked)).alias("contradicted"), F.size("coords").cast("long").alias("coords"))


ROWS_SQL = "SELECT doc_id AS row_id, CASE WHEN doc_id % 3 <> 1 THEN sha256(text) END AS sha256, CASE WHEN doc_id % 3 <> 0 THEN sha1(text) END AS sha1 FROM documents WHERE doc_id % 2 = 0"


@C.query(f"""WITH r AS ({ROWS_SQL}), f AS (SELECT doc_id, sha256(text) AS s, sha1(text) AS h, octet_length(encode(text)) AS size FROM documents),
v AS (SELECT f.*, (SELECT count(*) FROM r WHERE r.sha256 = f.s) AS identified, (SELECT count(*) FROM r WHERE r.sha1 = f.h AND r.sha256 IS NULL) AS consistent FROM f)
SELECT doc_id, identified, consistent, CASE WHEN size < 32 THEN 'floor' WHEN identified > 0 THEN 'identified' WHEN consistent > 0 THEN 'consistent' WHEN doc_id % 7 = 0 THEN 'membership' ELSE 'unknown' END AS class FROM v""")
def verdict_tiers(t):
    return _verdicts(t).select(F.col("file_id").alias("doc_id"), "identified", "consistent", "class")


def _verdicts(t):
    raw = F.encode("text", "utf-8")
    files = t.documents.select(F.col("doc_id").alias("file_id"), F.sha2(raw, 256).alias("sha256"), F.sha1(raw).alias("sha1"), F.octet_length("text").cast("long").alias("size"), F.when(F.col("doc_id") % 7 == 0, F.array(F.lit("corpus"))).otherwise(F.array().cast("array<string>")).alias("matched"))
    rows = t.documents.where("doc_id % 2 = 0").select(F.col("doc_id").alias("row_id"), F.when(F.col("doc_id") % 3 != 1, F.sha2(raw, 256)).alias("sha256"), F.when(F.col("doc_id") % 3 != 0, F.sha1(raw)).alias("sha1"))
    told = verdicts.tiers(files, rows)
    return told.withColumn("class", verdicts.classify(F.lit(True), F.col("size"), F.col("identified") > 0, F.col("consistent") > 0, F.size("matched") > 0))


@C.query(f"""WITH r AS ({ROWS_SQL}), f AS (SELECT doc_id, sha256(text) AS s, sha1(text) AS h, octet_length(encode(text)) AS size FROM documents),
v AS (SELECT doc_id, size, CASE WHEN size < 32 THEN 'floor' WHEN EXISTS (SELECT 1 FROM r WHERE r.sha256 = f.s) THEN 'identified' WHEN EXISTS (SELECT 1 FROM r WHERE r.sha1 = f.h AND r.sha256 IS NULL) THEN 'consistent' WHEN doc_id % 7 = 0 THEN 'membership' ELSE 'unknown' END AS class FROM f)
SELECT count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes, count(*) FILTER (class = 'identified') AS attributed, count(*) FILTER (class = 'consistent') AS consistent, count(*) FILTER (class = 'membership') AS membership_only,
 count(*) FILTER (doc_id % 7 = 0 OR class IN ('identified', 'consistent')) AS known, count(*) FILTER (class = 'unknown') AS unknown, count(*) FILTER (class = 'floor') AS floor FROM v""")
def scan_summary(t):
    return verdicts.summary(_verdicts(t))


@C.query("""WITH m AS (SELECT doc_id AS file_id, CASE doc_id % 4 WHEN 0 THEN 'debs' WHEN 1 THEN 'fedora' WHEN 2 THEN 'swh' ELSE 'none' END AS filter FROM documents),
r AS (SELECT file_id, CASE filter WHEN 'debs' THEN 'debs' WHEN 'fedora' THEN 'rpm-files' ELSE 'swh' END AS backend, CASE WHEN file_id % 8 < 4 THEN 'sha256' ELSE 'sha1' END AS scheme FROM m WHERE filter <> 'none')
SELECT file_id, backend, scheme FROM r WHERE backend <> 'debs'""")
def probe_routing(t):
    pick = F.element_at(F.array(*map(F.lit, ("debs", "fedora", "swh", "none"))), (F.col("doc_id") % 4 + 1).cast("int"))
    base = t.documents.select(F.col("doc_id").alias("file_id"), pick.alias("filter"))
    extra = t.documents.where("doc_id % 4 = 0").select((F.col("doc_id") + 10_000_000).alias("file_id"), F.lit("debs").alias("filter"))
    both = base.unionByName(extra)
    matches = both.withColumn("scheme", F.lit("sha1")).unionByName(both.where("file_id % 8 < 4").withColumn("scheme", F.lit("sha256")))
    routes = t.spark.createDataFrame([("debs", "debs"), ("fedora", "rpm-files"), ("rpm-files", "rpm-files"), ("swh", "swh")], "filter string, backend string")
    cap = t.documents.where("doc_id % 4 = 0").count() * 2 - 1
    return verdicts.probe_routes(matches, routes, cap, ["sha256", "sha512", "sha1", "md5"])


@C.query(f"""WITH o AS (SELECT user_id, event_type, max_by(value >= 10, ts) AS hit, max(ts) AS last_at FROM events GROUP BY user_id, event_type),
q AS (SELECT DISTINCT user_id, e.event_type FROM (SELECT DISTINCT user_id FROM events), (SELECT DISTINCT event_type FROM events) e)
SELECT user_id AS coordinate, event_type AS backend, CASE WHEN hit THEN 'hit' WHEN hit IS NULL THEN 'absent' WHEN floor(epoch({NOW})) - floor(epoch(last_at)) < 259200 THEN 'miss' ELSE 'absent' END AS state FROM q LEFT JOIN o USING (user_id, event_type)""")
def observation_freshness(t):
    store = t.events.groupBy(F.col("event_type").alias("backend"), F.col("user_id").alias("coordinate")).agg(F.max_by(F.col("value") >= 10, "ts").alias("hit"), F.max("ts").alias("fetched_at"))
    asked = t.events.select(F.col("user_id").alias("coordinate")).distinct().crossJoin(F.broadcast(t.events.select(F.col("event_type").alias("backend")).distinct()))
    return observations.probe(asked, store, F.expr(NOW))


def _store(t):
    d = t.documents.select("doc_id", "source", F.md5("text").alias("md5"), F.sha2("text", 256).alias("sha256"))
    return d.select(F.col("source").alias("backend"), F.col("md5").alias("coordinate"), (F.col("doc_id") % 5 != 0).alias("hit"), digests.coords_of({"md5": "md5", "sha256": "sha256"}).alias("coords"), F.concat(F.lit("seen "), F.col("md5")).alias("finding"), F.col("doc_id").alias("fetched_at"))


@C.query("""WITH o AS (SELECT source, md5(text) AS m, sha256(text) AS s, max_by(doc_id % 5 <> 0, doc_id) AS hit FROM documents GROUP BY ALL)
SELECT 'sha256' AS scheme, s AS digest, source AS backend, 'seen ' || m AS finding FROM o WHERE hit""")
def observation_inverted(t):
    empty = _store(t).limit(0)
    store = observations.upserted(empty, _store(t))
    asked = t.documents.select(F.lit("sha256").alias("scheme"), F.sha2("text", 256).alias("digest")).distinct()
    return observations.findings_for(asked, observations.coordinate_index(store), store)


@C.query("""WITH n AS (SELECT 'd/' || doc_id AS path, octet_length(encode(text)) AS size FROM documents WHERE doc_id % 10 <> 3)
SELECT path, CASE WHEN CAST(split_part(path, '/', 2) AS BIGINT) % 10 IN (1, 4) THEN 'hash' ELSE 'reuse' END AS action FROM n WHERE size > 0
UNION ALL SELECT 'd/' || doc_id, 'stale' FROM documents WHERE doc_id % 10 = 3""")
def incremental_rescan(t):
    d, k = t.documents, F.col("doc_id") % 10
    row = lambda mtime: (F.concat(F.lit("d/"), F.col("doc_id").cast("string")).alias("path"), F.octet_length("text").cast("long").alias("size"), mtime.alias("mtime"))
    state = d.where(k != 4).select(*row(F.lit(1)))
    listing = d.where(k != 3).select(*row(F.when(k == 1, 2).otherwise(1)))
    return observations.rescanned(listing, state).select("path", "action").unionByName(observations.stale(state, listing).select("path", F.lit("stale").alias("action")))


@C.query("""SELECT 'f/' || doc_id AS path, CASE doc_id % 10 WHEN 0 THEN 'missing' WHEN 1 THEN 'extra' WHEN 2 THEN 'size' WHEN 3 THEN 'hash' ELSE 'ok' END AS status FROM documents""")
def manifest_verify(t):
    d, k = t.documents, F.col("doc_id") % 10
    path, size, sha = F.concat(F.lit("f/"), F.col("doc_id").cast("string")).alias("path"), F.octet_length("text").cast("long"), F.sha2("text", 256)
    manifest = d.where(k != 1).select(path, size.alias("size"), sha.alias("sha256"))
    listing = d.where(k != 0).select(path, F.when(k == 2, size + 1).otherwise(size).alias("size"), F.when(k == 3, F.lit("0")).otherwise(sha).alias("sha256"))
    return observations.verified(manifest, listing)


@C.query("""WITH c AS (SELECT r_regionkey AS r, n_nationkey AS n, c_custkey AS c FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey),
o AS (SELECT c.*, o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'floor' WHEN o_orderkey % 2 = 0 THEN 'identified' WHEN o_orderkey % 5 = 0 THEN 'membership' ELSE 'unknown' END AS class FROM c JOIN orders ON o_custkey = c),
a AS (SELECT 'r' || r AS container_id, class FROM o UNION ALL SELECT 'n' || n, class FROM o UNION ALL SELECT 'c' || c, class FROM o UNION ALL
 SELECT 'r' || r, 'unknown' FROM c WHERE c NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT 'n' || n, 'unknown' FROM c WHERE c NOT IN (SELECT o_custkey FROM orders))
SELECT container_id, count(*) AS total, count(*) FILTER (class IN ('identified', 'membership')) AS known, count(*) FILTER (class = 'unknown') AS unknown, count(*) FILTER (class = 'floor') AS floor FROM a GROUP BY container_id""")
def container_rollup(t):
    return verdicts.rollups(_tree(t))


def _tree(t):
    tag = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    row = lambda df, me, up, kind, ord_: df.select(me.alias("member_id"), up.alias("parent_id"), kind.alias("class"), F.col(ord_).cast("long").alias("ord"))
    k = F.col("o_orderkey")
    leaf = F.when(k % 7 == 0, "floor").when(k % 2 == 0, "identified").when(k % 5 == 0, "membership").otherwise("unknown")
    parts = [
        row(t.region, tag("r", "r_regionkey"), F.lit(None).cast("string"), F.lit("unknown"), "r_regionkey"), row(t.nation, tag("n", "n_nationkey"), tag("r", "n_regionkey"), F.lit("unknown"), "n_nationkey"),
        row(t.customer, tag("c", "c_custkey"), tag("n", "c_nationkey"), F.lit("unknown"), "c_custkey"), row(t.orders, tag("o", "o_orderkey"), tag("c", "o_custkey"), leaf, "o_orderkey"),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@C.query("""WITH x AS (SELECT 'r' || r_regionkey AS member_id, printf('%010d', r_regionkey) AS path FROM region UNION ALL SELECT 'n' || n_nationkey, printf('%010d/%010d', n_regionkey, n_nationkey) FROM nation
 UNION ALL SELECT 'c' || c_custkey, printf('%010d/%010d/%010d', n_regionkey, n_nationkey, c_custkey) FROM customer JOIN nation ON c_nationkey = n_nationkey
 UNION ALL SELECT 'o' || o_orderkey, printf('%010d/%010d/%010d/%010d', n_regionkey, n_nationkey, c_custkey, o_orderkey) FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON c_nationkey = n_nationkey)
SELECT member_id, row_number() OVER (ORDER BY path) AS place FROM x""")
def tree_order(t):
    paths = verdicts.tree_paths(_tree(t))
    return lookup.numbered(paths, ["path"], "n").select("member_id", (F.col("n") + 1).cast("long").alias("place"))


@C.query("""WITH c AS (SELECT l_orderkey, l_linenumber AS ord, strftime(l_shipdate, '%Y-%m-%d') || l_returnflag AS statement, CASE WHEN l_linenumber % 2 = 0 THEN l_linestatus END AS url FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY url IS NOT NULL DESC, length(statement) DESC, ord, statement DESC, url DESC) AS n FROM c) SELECT l_orderkey, statement, url FROM r WHERE n = 1""")
def best_claim(t):
    rows = t.lineitem.select("l_orderkey", F.col("l_linenumber").alias("ord"), F.concat(F.date_format("l_shipdate", "yyyy-MM-dd"), "l_returnflag").alias("statement"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_linestatus")).alias("url"))
    return verdicts.best_claims(rows, ["l_orderkey"])


@C.query("""WITH f AS (SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN [] ELSE [c_custkey, c_custkey * 1000000] END AS ids FROM customer),
e AS (SELECT c_custkey, unnest(CASE WHEN len(ids) = 0 THEN [NULL] ELSE ids END) AS o_orderkey FROM f) SELECT c_custkey, o_orderkey, o_orderstatus FROM e LEFT JOIN orders USING (o_orderkey)""")
def left_join_exploded(t):
    k = F.col("c_custkey")
    files = t.customer.select("c_custkey", F.when(k % 4 == 0, F.array().cast("array<bigint>")).otherwise(F.array(k, k * 1_000_000)).alias("ids"))
    return etl.exploded_left_join(files, "ids", t.orders.select("o_orderkey", "o_orderstatus"), "o_orderkey").select("c_custkey", "o_orderkey", "o_orderstatus")


@C.query("""SELECT doc_id AS line, CASE WHEN doc_id % 50 = 7 THEN 'short' WHEN doc_id % 50 = 9 THEN 'mismatch' ELSE 'ok' END AS status, md5(text) AS md5, CASE WHEN doc_id % 50 <> 7 THEN sha1(text) END AS sha1 FROM documents""")
def zip_join(t):
    d, k = t.documents, F.col("doc_id")
    left = d.select(k.alias("line"), F.col("source").alias("identifier"), F.col("lang").alias("filename"), F.md5("text").alias("md5"))
    right = d.where(k % 50 != 7).select(k.alias("line"), F.when(k % 50 == 9, F.lit("?")).otherwise(F.col("source")).alias("identifier"), F.col("lang").alias("filename"), F.sha1("text").alias("sha1"))
    return etl.zipped(left, right, "line", ["identifier", "filename"], ["md5"], ["sha1"]).select("line", "status", "md5", "sha1")


@C.query("""WITH p AS (SELECT l_partkey, l_suppkey, min(l_quantity) AS least FROM lineitem GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_orderkey, l_linenumber) AS n FROM lineitem)
SELECT DISTINCT l_partkey, l_suppkey, l_orderkey, least FROM k JOIN p USING (l_partkey, l_suppkey) WHERE n = 1""")
def composite_dedup(t):
    packages = t.lineitem.groupBy("l_partkey", "l_suppkey").agg(F.min("l_quantity").alias("least"))
    first = etl.first_by(t.lineitem.select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber"), ["l_partkey", "l_suppkey"], "l_orderkey", "l_linenumber")
    return etl.composite_join(first, packages, ["l_partkey", "l_suppkey"]).select("l_partkey", "l_suppkey", "l_orderkey", "least")


@C.query("""SELECT sha256(text) AS sha256, count(*) AS n, array_to_string(list(doc_id ORDER BY doc_id), ',') AS ids FROM documents GROUP BY ALL HAVING count(*) > 1""")
def duplicates_report(t):
    return etl.repeated(t.documents.select(F.sha2("text", 256).alias("sha256"), "doc_id"), ["sha256"], "doc_id").select("sha256", "n", F.array_join(F.transform("values", lambda x: x.cast("string")), ",").alias("ids"))


@C.query("""WITH s AS (SELECT l_orderkey, l_returnflag AS scheme, l_partkey, dense_rank() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_partkey) AS variant FROM lineitem)
SELECT l_orderkey, variant, min(l_partkey) FILTER (scheme = 'A') AS A, min(l_partkey) FILTER (scheme = 'N') AS N, min(l_partkey) FILTER (scheme = 'R') AS R FROM s GROUP BY l_orderkey, variant""")
def regroup_pivot(t):
    rows = t.lineitem.select("l_orderkey", F.col("l_returnflag").alias("scheme"), F.col("l_partkey").alias("digest"))
    return etl.regrouped(rows, ["l_orderkey"], ["A", "N", "R"])


@C.query("""WITH r AS (SELECT doc_id, source, lang, row_number() OVER (PARTITION BY sha256(text), lang ORDER BY source, doc_id) AS n FROM documents) SELECT doc_id, source, lang FROM r WHERE n = 1""")
def first_seen_dedup(t):
    rows = t.documents.select("doc_id", "source", "lang", F.sha2("text", 256).alias("s"))
    return etl.first_by(rows, ["s", "lang"], "source", "doc_id").select("doc_id", "source", "lang")


@C.query("""SELECT count(*) AS rows, CAST(sum(CAST('0x' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 8) AS BIGINT)) AS BIGINT) AS sum_o_orderkey,
 CAST(sum(CAST('0x' || substr(md5(o_orderstatus), 1, 8) AS BIGINT)) AS BIGINT) AS sum_o_orderstatus FROM orders""")
def content_signature(t):
    return etl.signature(t.orders, ["o_orderkey", "o_orderstatus"])


@C.query("""WITH g AS (SELECT substr(sha256(text), 1, 1) AS shard, min(sha256(text)) AS lo, max(sha256(text)) AS hi FROM documents GROUP BY 1), w AS (SELECT lo, lag(hi) OVER (ORDER BY lo) AS up FROM g) SELECT count(*) FILTER (lo < up) AS overlapping FROM w""")
def sort_verify(t):
    key = F.sha2("text", 256)
    ranges = t.documents.groupBy(digests.shard(key).alias("shard")).agg(F.min(key).alias("lo"), F.max(key).alias("hi"))
    return etl.out_of_order(ranges, "lo", "hi")


RUNS_SQL = "SELECT l_orderkey, l_linenumber, l_partkey % 500 AS a, l_partkey % 500 + CAST(l_quantity AS BIGINT) AS b FROM lineitem"


def _runs(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 500).alias("a"), (F.col("l_partkey") % 500 + F.col("l_quantity").cast("long")).alias("b"))


@C.query(f"""WITH r AS ({RUNS_SQL}) SELECT x.l_orderkey, x.l_linenumber AS lid, y.l_linenumber AS rid, greatest(x.a, y.a) AS lo, least(x.b, y.b) AS hi FROM r x JOIN r y ON x.l_orderkey = y.l_orderkey AND x.a < y.b AND y.a < x.b WHERE x.l_linenumber % 2 = 0 AND y.l_linenumber % 2 = 1""")
def interval_overlap(t):
    runs = _runs(t)
    left = runs.where("l_linenumber % 2 = 0").withColumnRenamed("l_linenumber", "lid")
    return intervals.overlaps(left, runs.where("l_linenumber % 2 = 1").withColumnRenamed("l_linenumber", "rid"), "l_orderkey", 64)


UNITED_SQL = f"""r AS ({RUNS_SQL}), m AS (SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY l_orderkey ORDER BY a, b, l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM r WHERE b > a),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY l_orderkey ORDER BY a, b, l_linenumber) AS island FROM m), u AS (SELECT l_orderkey, min(a) AS a, max(b) AS b, count(*) AS n FROM i GROUP BY l_orderkey, island)"""


@C.query(f"WITH {UNITED_SQL} SELECT l_orderkey, a, b, n FROM u")
def interval_union(t):
    return intervals.united(_runs(t), "l_orderkey")


TILES_SQL = f"""{UNITED_SQL}, g AS (SELECT l_orderkey, a, b, 'segment' AS kind FROM u UNION ALL
 SELECT l_orderkey, coalesce(lag(b) OVER (PARTITION BY l_orderkey ORDER BY a), 0), a, 'gap' FROM u UNION ALL SELECT l_orderkey, max(b), 600, 'gap' FROM u GROUP BY l_orderkey),
t AS (SELECT l_orderkey, a, b, CASE WHEN kind = 'segment' THEN kind WHEN b - a <= 64 THEN 'inline' ELSE 'residue' END AS kind FROM g WHERE b > a)"""


def _tiles(t):
    united = intervals.united(_runs(t), "l_orderkey")
    return intervals.tiled(united, t.lineitem.select("l_orderkey").distinct().withColumn("size", F.lit(600).cast("long")), "l_orderkey")


@C.query(f"WITH {TILES_SQL} SELECT * FROM t")
def splice_tiling(t):
    return _tiles(t)


@C.query(f"WITH {TILES_SQL} SELECT l_orderkey, CAST(sum(CASE WHEN kind = 'segment' THEN b - a ELSE 0 END) AS BIGINT) AS fetchable, CAST(sum(CASE WHEN kind = 'inline' THEN b - a ELSE 0 END) AS BIGINT) AS inline, CAST(sum(CASE WHEN kind = 'residue' THEN b - a ELSE 0 END) AS BIGINT) AS residue, count(*) FILTER (kind = 'segment') AS segments FROM t GROUP BY l_orderkey")
def coverage(t):
    return intervals.coverage(_tiles(t), ["l_orderkey"])


@C.query()
def interval_admission(t):
    return intervals.admitted(_runs(t).withColumn("turn", F.col("l_linenumber")), "l_orderkey")


@C.query("""SELECT node_id FROM (SELECT 'd' || doc_id AS node_id, sha256(text) AS s, doc_id FROM documents) WHERE doc_id % 10 NOT IN (0, 1) AND s NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 3 = 0) AND doc_id // 10 % 4 <> 2""")
def missing_blobs(t):
    k = F.col("doc_id")
    box = F.floor(k / 10)
    leaf = t.documents.where("doc_id % 10 not in (0, 1)").select(F.concat(F.lit("d"), k).alias("node_id"), F.concat(F.lit("b"), box).alias("parent_id"), F.concat(F.lit("b"), box, F.lit("/"), k).alias("path"), F.sha2("text", 256).alias("sha256"))
    boxes = t.documents.where("doc_id % 10 = 2").select(F.concat(F.lit("b"), box).alias("node_id"), F.lit(None).cast("string").alias("parent_id"), F.concat(F.lit("b"), box).alias("path"), F.concat(F.lit("box"), box).alias("sha256"))
    present = t.documents.where("doc_id % 3 = 0").select(F.sha2("text", 256).alias("sha256")).unionByName(boxes.where(F.substring("node_id", 2, 20).cast("long") % 4 == 2).select("sha256"))
    return intervals.missing(leaf.unionByName(boxes), present).select("node_id")


@C.query()
def longest_run(t):
    entries = t.lineitem.select("l_orderkey", F.col("l_linenumber").cast("long").alias("ord"), F.sha2(F.col("l_partkey").cast("string"), 256).alias("digest"))
    order = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("xs")).where("l_orderkey % 2 = 0")
    run = F.sha2(F.array_join(F.transform(F.slice("xs", 1, 3), lambda x: F.sha2(x["l_partkey"].cast("string"), 256)), ","), 256)
    return intervals.longest_runs(entries, order.select(run.alias("digest")), "l_orderkey")


@C.query("""SELECT count(*) AS files, coalesce(sum(n_chars), 0)::BIGINT AS bytes FROM documents""")
def index_stats(t):
    return observations.stats(t.documents.select("doc_id", F.col("n_chars").alias("size")))


@C.query("""SELECT count(*) AS "rows", count(*) FILTER (url LIKE 'https:%') AS encrypted, count(*) FILTER (html IS NULL OR html = '') AS empty,
count(*) FILTER (length(html) > 2000) AS long FROM pages""")
def harvest_counters(t):
    html = F.col("html")
    return etl.counters(t.pages, {"encrypted": F.col("url").like("https:%"), "empty": html.isNull() | (html == ""), "long": F.length(html) > 2000})
