"""Secret scans with multipart credential linking, in DataFrame functions alone.

Base spans come from three patterns: assignments, access identifiers, long hexadecimal runs. Beside these the text
is searched for weak parts, which say nothing alone: bare secrets (long mixed tokens) and endpoints (URLs and
IPv4 addresses). A weak part is reported only if the parts that complete a credential lie within the same
scope, SCOPE code points to either side: an interval join of the parts of one text by their starts.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from digestlake.llm.tables import id_and_text

#: The patterns of the base spans, and the least lengths of what they match.
ASSIGN = r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
ASSIGN_VALUE = r"""^[A-Za-z_]+["']?\x20*[:=]\x20*["']?(.*)$"""
ACCESS, HEX = "AKIA[A-Z0-9]{14,}", "[0-9a-f]{16,}"
LEAST_VALUE = 12
#: Weak parts: a bare secret is a run of 20 or more with a digit and a letter; an endpoint names a host.
BARE = "[A-Za-z0-9+/=_-]{20,}"
ENDPOINT = r"https?://[A-Za-z0-9.-]+(?::[0-9]{1,5})?|[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?::[0-9]{1,5})?"
SCOPE = 200
KINDS = ["assign", "access", "hex", "bare", "endpoint"]
SPAN = "array<struct<start:int,rank:int,end:int,kind:string>>"


#: Items that one fold of an array takes; a fold of the folds joins them, so that work grows in proportion to matches.
FOLD = 512
#: Code points of a stretch of text out of which pieces are cut.
STRETCH = 256
FAR = 2**30


def bound(value: Column, use) -> Column:
    """use(value), with value evaluated once."""
    return F.transform(F.array(value), use)[0]


def running(items: Column, join, zero: Column, kind: str = "int") -> Column:
    """What join makes of all items before each place of an array, and, as one more item, of all of them.

    Blocks of FOLD items are folded each, then the blocks' results, and these are joined to what is within the blocks.
    """

    def fold(xs: Column) -> Column:
        begin = F.struct(zero.alias("at"), F.array().cast(f"array<{kind}>").alias("before"))
        return F.aggregate(xs, begin, lambda acc, x: F.struct(join(acc["at"], x).alias("at"), F.concat(acc["before"], F.array(acc["at"])).alias("before")))

    def blocks(xs: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(xs) / FOLD).cast("int") - 1, F.lit(0))), lambda k: fold(F.slice(xs, k * FOLD + 1, FOLD)))

    def joined(made: Column) -> Column:
        within = lambda above: F.zip_with(made, above["before"], lambda b, up: F.transform(b["before"], lambda x: join(up, x)))
        return bound(fold(F.transform(made, lambda b: b["at"])), lambda above: F.concat(F.flatten(within(above)), F.array(above["at"])))

    return bound(items, lambda xs: bound(blocks(xs), joined))


def found(text: Column, pattern: str, kind: str, sure: str | None = None) -> Column:
    """Spans of all leftmost non-overlapping matches, in code points. sure: a cheap pattern without which none can be.

    The text is split at the matches; their places follow from the lengths of what lies between.
    """
    between = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    rank = KINDS.index(kind)
    cut = F.zip_with(between, matches, lambda gap, match: F.struct(gap.alias("gap"), F.coalesce(F.length(match), F.lit(0)).alias("size"), (match.isNotNull() & _holds(kind, match)).alias("holds")))

    def placed(cuts: Column) -> Column:
        before = running(F.transform(cuts, lambda x: x["gap"] + x["size"]), lambda x, y: x + y, F.lit(0))
        span = lambda x, at: F.struct(F.struct((at + x["gap"]).alias("start"), F.lit(rank).alias("rank"), (at + x["gap"] + x["size"]).alias("end"), F.lit(kind).alias("kind")).alias("span"), x["holds"].alias("holds"))
        each = F.zip_with(cuts, F.slice(before, 1, F.size(cuts)), span)
        return F.transform(F.filter(each, lambda e: e["holds"]), lambda e: e["span"])

    return F.when(text.rlike(sure or pattern), bound(cut, placed)).otherwise(F.array().cast(SPAN))


def _holds(kind: str, match: Column) -> Column:
    if kind == "assign":
        return F.length(F.regexp_extract(match, ASSIGN_VALUE, 1)) >= LEAST_VALUE
    return match.rlike("[0-9]") & match.rlike("[A-Za-z]") if kind == "bare" else F.lit(True)


def beside(parts: Column, others: dict[str, Column], wanted) -> Column:
    """Those of parts (sorted by start) for which wanted(part, sides) holds, by an interval join with each of others.

    One sweep over the starts of all: sides has, by the name of each of others, the largest start (name_last) and end (name_end)
    of those that start no later than the part, and the least start of those that start later (name_next, negated).
    """
    names = list(others)
    event = lambda which: lambda p: F.struct(p["start"].alias("at"), F.lit(which).alias("which"), p["end"].alias("end"), p.alias("part"))
    events = F.array_sort(F.concat(*[F.transform(others[n], event(k)) for k, n in enumerate(names)], F.transform(parts, event(len(names)))))

    def swept(es: Column) -> Column:
        def side(columns: list[tuple[str, str, int]], items: Column) -> Column:
            keys = [f"{n}_{c}" for n in names for c, _, _ in columns]
            state = lambda e: F.struct(*[F.when(e["which"] == k, sign * e[of]).otherwise(F.lit(-FAR)).alias(f"{n}_{c}") for k, n in enumerate(names) for c, of, sign in columns])
            join = lambda x, y: F.struct(*[F.greatest(x[c], y[c]).alias(c) for c in keys])
            zero = F.struct(*[F.lit(-FAR).alias(c) for c in keys])
            return running(F.transform(items, state), join, zero, "struct<" + ",".join(f"{c}:int" for c in keys) + ">")

        before = side([("last", "at", 1), ("end", "end", 1)], es)
        after = F.reverse(F.slice(side([("next", "at", -1)], F.reverse(es)), 1, F.size(es)))
        met = F.zip_with(F.zip_with(es, F.slice(before, 1, F.size(es)), lambda e, x: F.struct(e.alias("e"), x.alias("x"))), after, lambda p, y: F.struct(p["e"].alias("e"), p["x"].alias("x"), y.alias("y")))
        holds = lambda m: (m["e"]["which"] == len(names)) & wanted(m["e"]["part"], lambda n, c: m["y" if c == "next" else "x"][f"{n}_{c}"])
        return F.transform(F.filter(met, holds), lambda m: m["e"]["part"])

    return bound(events, swept)


def near(part: Column, of, name: str) -> Column:
    """Whether one of the others starts within SCOPE code points of the part's start."""
    return (part["start"] - of(name, "last") <= SCOPE) | (-of(name, "next") - part["start"] <= SCOPE)


def with_spans(rows: DataFrame) -> DataFrame:
    """rows, which must have a text column, with the spans of each kind, base and linked.

    base: assign, access and hex by start, then kind. linked: weak parts by start. A bare secret is linked where an
    access identifier is near and it overlaps no base span; an endpoint where an assignment is near, or an
    access identifier together with a linked or hexadecimal secret.
    """
    text, none = F.col("text"), F.array().cast(SPAN)
    if_any = lambda wanted, spans: F.when(wanted, spans).otherwise(none)
    size = F.size
    first = rows.withColumns({"assign": found(text, ASSIGN, "assign", "[:=]"), "access": found(text, ACCESS, "access", "AKIA"), "hex": found(text, HEX, "hex")})
    first = first.withColumn("base", F.array_sort(F.concat("assign", "access", "hex")))
    secret = lambda p, of: near(p, of, "access") & (of("base", "end") <= p["start"]) & (-of("base", "next") >= p["end"])
    second = first.withColumn("bare", if_any(size("access") > 0, beside(found(text, BARE, "bare"), {"access": F.col("access"), "base": F.col("base")}, secret)))
    completed = lambda p, of: near(p, of, "assign") | near(p, of, "access") & (near(p, of, "bare") | near(p, of, "hex"))
    endpoint = beside(found(text, ENDPOINT, "endpoint", r"://|[0-9]\.[0-9]"), {k: F.col(k) for k in KINDS[:4]}, completed)
    third = second.withColumn("endpoint", if_any((size("access") > 0) | (size("assign") > 0), endpoint))
    return third.withColumn("linked", F.array_sort(F.concat("bare", "endpoint")))


def secret_spans(docs: DataFrame) -> DataFrame:
    """doc_id, assign, access, hex, base, linked for every row of docs: arrays of struct<start, rank, end, kind>.

    Null and empty texts have no spans; repeated rows are searched each; an empty table gives no rows.
    """
    text = id_and_text(docs).withColumn("text", F.coalesce("text", F.lit("")))
    return with_spans(text).select("doc_id", "assign", "access", "hex", "base", "linked")


def listed(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for every row of docs."""
    count = lambda c: F.size(c).cast("long").alias(f"n_{c}")
    spans = secret_spans(docs)
    return spans.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.array_sort(F.concat("base", "linked"))).alias("spans"))


MASK = "[secret]"


def masked(docs: DataFrame) -> DataFrame:
    """The rows and columns of docs with every span, base and linked, replaced in text by MASK; overlapping spans become one.

    An n_chars column follows the text where this changes. Null texts stay null.
    """
    held = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    searched = with_spans(held).select("row", "text", F.array_sort(F.concat("base", "linked")).alias("spans"))
    text = F.col("row.text").cast("string")
    clean = F.when(F.size("spans") == 0, text).otherwise(bound(F.col("spans"), lambda spans: _masked(text, spans)))
    made = searched.withColumn("clean", clean)
    shown = {"text": F.col("clean"), "n_chars": F.when(F.size("spans") == 0, F.col("row.n_chars")).otherwise(F.length("clean"))} if "n_chars" in docs.columns else {"text": F.col("clean")}
    return made.select(*[shown[c].cast(docs.schema[c].dataType).alias(c) if c in shown else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def _masked(text: Column, spans: Column) -> Column:
    """The text with MASK in place of the spans, which are sorted by start. Pieces are cut out of short stretches, since
    to find a place within a text of many bytes takes a walk over all characters before it."""

    def piece(stretches: Column, a: Column, b: Column) -> Column:
        first = F.floor(a / STRETCH).cast("int")
        some = F.array_join(F.slice(stretches, first + 1, F.floor(b / STRETCH).cast("int") - first + 1), "")
        return F.substring(some, a - first * STRETCH + 1, b - a)

    def cut(stretches: Column, upto: Column) -> Column:
        def shown(s: Column, at: Column) -> Column:
            return F.when(s["start"] >= at, F.concat(piece(stretches, at, s["start"]), F.lit(MASK))).otherwise(F.lit(""))

        pieces = F.zip_with(spans, F.slice(upto, 1, F.size(spans)), shown)
        return F.concat(F.array_join(pieces, ""), piece(stretches, F.element_at(upto, -1), F.lit(FAR)))

    ends = running(F.transform(spans, lambda s: s["end"]), F.greatest, F.lit(0))
    return bound(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{STRETCH}}}"), F.lit(0)), lambda stretches: bound(ends, lambda upto: cut(stretches, upto)))


def _oracle() -> str:
    """The report in DuckDB SQL, from the same patterns."""
    quoted = lambda p: "'" + p.replace("'", "''") + "'"
    patterns = dict(zip(KINDS, (ASSIGN, ACCESS, HEX, BARE, ENDPOINT), strict=True))
    cut = " UNION ALL ".join(f"SELECT r, '{k}' AS kind, {n} AS rank, string_split_regex(t, {quoted(p)}) AS gaps, regexp_extract_all(t, {quoted(p)}) AS ms FROM d WHERE regexp_matches(t, {quoted(p)})" for n, (k, p) in enumerate(patterns.items()))
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
cut AS ({cut}),
every AS (SELECT r, kind, rank, ms[i] AS m, list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i-1], lambda x: length(x))), 0) AS a
          FROM cut, unnest(range(1, len(ms) + 1)) AS u(i)),
span AS (SELECT r, kind, rank, CAST(a AS BIGINT) AS a, CAST(a + length(m) AS BIGINT) AS b FROM every
         WHERE CASE kind WHEN 'assign' THEN length(regexp_extract(m, {quoted(ASSIGN_VALUE)}, 1)) >= {LEAST_VALUE} WHEN 'bare' THEN regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Za-z]') ELSE true END),
base AS (SELECT * FROM span WHERE rank < 3),
bare AS (SELECT * FROM span s WHERE kind = 'bare' AND EXISTS (SELECT 1 FROM base o WHERE o.r = s.r AND o.kind = 'access' AND abs(o.a - s.a) <= {SCOPE})
         AND NOT EXISTS (SELECT 1 FROM base o WHERE o.r = s.r AND o.a < s.b AND s.a < o.b)),
secret AS (SELECT r, a FROM bare UNION ALL SELECT r, a FROM base WHERE kind = 'hex'),
endpoint AS (SELECT * FROM span s WHERE kind = 'endpoint' AND (EXISTS (SELECT 1 FROM base o WHERE o.r = s.r AND o.kind = 'assign' AND abs(o.a - s.a) <= {SCOPE})
             OR EXISTS (SELECT 1 FROM base o WHERE o.r = s.r AND o.kind = 'access' AND abs(o.a - s.a) <= {SCOPE}) AND EXISTS (SELECT 1 FROM secret o WHERE o.r = s.r AND abs(o.a - s.a) <= {SCOPE}))),
spans AS (SELECT * FROM base UNION ALL SELECT * FROM bare UNION ALL SELECT * FROM endpoint),
told AS (SELECT r, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
         string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, rank) FILTER (rank < 3) AS base, string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, rank, b) AS spans
         FROM spans GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN told USING (r)"""


ORACLE = _oracle()
