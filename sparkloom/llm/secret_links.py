"""Secret scan with multipart credential linking, DataFrame functions only.

Strong finds are reported as they are. Weak candidates (a long mixed token
or an endpoint address) say little alone; they are joined with access
identifiers, secrets and endpoints by interval within one text, and are
reported only where a complementary part lies within the scope.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common


@dataclass(frozen=True)
class Kind:
    """Matches of pattern whose group has at least ``least`` code points; hint is a substring that each match holds."""

    pattern: str
    least: int
    group: int = 0
    hint: str = ""
    needs: tuple[str, ...] = ()  # patterns that the match must hold as well
    completed_by: tuple[str, ...] = ()  # for weak kinds


#: The order ranks kinds at equal starts.
BASE = {
    "assign": Kind(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, group=1),
    # a run that is too short holds no other match, so the least length can be in the pattern
    "access": Kind(r"AKIA[A-Z0-9]{14,}", 18, hint="AKIA"),
    "hex": Kind(r"[0-9a-f]{16,}", 16),
}
WEAK = {
    "opaque": Kind(r"[A-Za-z0-9+/_-]{20,}={0,2}", 20, needs=("[0-9]", "[A-Z]", "[a-z]"), completed_by=("access", "endpoint")),
    "endpoint": Kind(r"(?:https?|s3|postgres|mysql|redis|amqp)://[A-Za-z0-9._~:@%/-]+", 10, hint="://", completed_by=("access", "assign", "hex")),
}
#: Most code points between the end of one part and the start of the next of one scope.
SCOPE = 200
_KINDS = [*BASE, *WEAK]
_SPAN = "array<struct<start:bigint,rank:int,kind:string,end:bigint>>"


_FOUND = "array<struct<rank:int,kind:string,i:int,gap:bigint,len:bigint,ok:boolean>>"


def _finds(text: Column, name: str, kind: Kind) -> Column:
    """The leftmost non-overlapping matches in order: what lies before each, its length, whether it counts.

    split gives what lies between the matches, regexp_extract_all what is
    matched; all in code points. Texts without a match do neither.
    """
    p = F.lit(kind.pattern)
    parts = F.arrays_zip(F.split(text, kind.pattern, -1).alias("gap"), F.regexp_extract_all(text, p, F.lit(0)).alias("whole"), F.regexp_extract_all(text, p, F.lit(kind.group)).alias("own"))

    def one(x, i):
        ok = F.length(x["own"]) >= kind.least
        for r in kind.needs:
            ok = ok & F.regexp_like(x["whole"], F.lit(r))
        return F.struct(F.lit(_KINDS.index(name)).alias("rank"), F.lit(name).alias("kind"), i.alias("i"), F.length(x["gap"]).cast("long").alias("gap"), F.length(x["whole"]).cast("long").alias("len"), F.coalesce(ok, F.lit(False)).alias("ok"))

    there = F.regexp_like(text, p)
    if kind.hint:
        there = F.contains(text, F.lit(kind.hint)) & there
    # the last gap has no match behind it
    return F.when(there, F.filter(F.transform(parts, one), lambda x: x["len"].isNotNull())).otherwise(F.array().cast(_FOUND))


def finds(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and all matches of each row of docs; a narrow stage."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    d = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.alias("_text"))
    return d.select("doc_id", F.flatten(F.array(*[_finds(F.col("_text"), k, v) for k, v in (BASE | WEAK).items()])).alias("found"))


def link(found: DataFrame, scope: int = SCOPE) -> DataFrame:
    """The interval join: doc_id, base, linked (weak spans completed within the scope).

    Matches become rows: running sums give their places, a weak find that
    overlaps a strong one is that strong one and is left out, and the parts of
    one text are joined as intervals: of each kind the furthest end in front
    and the nearest start behind are running extremes, and they complete what
    lies within ``scope`` code points of them, whatever the parts' lengths. The finds
    are written once with a row number, which is the join's key then:
    repeated rows and null ids stay apart, and a lost executor cannot change
    it. Texts without a match pass by.
    """
    rows = common.written(found.withColumn("_row", F.monotonically_increasing_id()), "finds")
    none = F.array().cast(_SPAN)
    alone = rows.where(F.size("found") == 0).select("doc_id", none.alias("base"), none.alias("linked"))
    parts = rows.where(F.size("found") > 0).select("_row", "doc_id", F.explode("found").alias("m")).repartition("_row").select("_row", "doc_id", "m.*")
    end = F.sum(F.col("gap") + F.col("len")).over(Window.partitionBy("_row", "rank").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    parts = parts.withColumn("end", end).withColumn("start", F.col("end") - F.col("len"))
    strong = F.col("ok") & (F.col("rank") < len(BASE))
    in_order = Window.partitionBy("_row").orderBy("start", "rank")
    before = F.max(F.when(strong, F.col("end"))).over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    # a frame up to the end costs a pass for each row, one from the begin in the other order does not
    backwards = Window.partitionBy("_row").orderBy(F.col("start").desc(), F.col("rank").desc())
    behind = F.min(F.when(strong, F.col("start"))).over(backwards.rowsBetween(Window.unboundedPreceding, -1))
    covered = F.coalesce(before > F.col("start"), F.lit(False)) | F.coalesce(behind < F.col("end"), F.lit(False))
    parts = parts.withColumn("counts", F.when(strong | (F.col("ok") & ~covered), F.col("kind")))
    # of the parts in front the furthest end counts, of those behind the nearest start
    to_here, from_here = (w.rowsBetween(Window.unboundedPreceding, Window.currentRow) for w in (in_order, backwards))
    one = lambda k, c: F.when(F.col("counts") == k, F.col(c))
    in_reach = lambda k: F.coalesce(F.max(one(k, "end")).over(to_here) + scope >= F.col("start"), F.lit(False)) | F.coalesce(F.min(one(k, "start")).over(from_here) <= F.col("end") + scope, F.lit(False))
    parts = parts.select("*", *[in_reach(k).alias(f"_{k}") for k in _KINDS])
    completed = F.lit(False)
    for name, k in WEAK.items():
        other = F.lit(False)
        for c in k.completed_by:
            other = other | F.col(f"_{c}")
        completed = completed | (F.col("counts").eqNullSafe(name) & other)
    span = F.struct("start", "rank", "kind", "end")
    collected = lambda cond: F.sort_array(F.collect_list(F.when(cond, span)))
    joined = parts.groupBy("_row").agg(F.first("doc_id").alias("doc_id"), collected(strong).alias("base"), collected(completed).alias("linked"))
    return alone.unionByName(joined.select("doc_id", "base", "linked"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """One row for each row of docs: doc_id, base and linked spans by start and kind.

    A null or empty text has no spans; long texts are scanned whole. Repeated rows give equal rows; null
    ids are kept. An empty table gives no rows. Other columns are not read.
    """
    return link(finds(docs, id_col, text_col), scope)


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op3_secret_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scan(common.table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return s.select("doc_id", *[count(k) for k in BASE], F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.sort_array(F.concat("base", "linked"))).alias("spans"))


QUERIES = {"op3_secret_links": op3_secret_links}


def _sql() -> str:
    """The same in SQL: what split leaves and what matches give the places, then the interval join as an EXISTS."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    found = []
    for rank, (name, k) in enumerate((BASE | WEAK).items()):
        needs = " AND ".join(["true", *[f"regexp_matches(m[i], {quote(r)})" for r in k.needs]])
        p = quote(k.pattern)
        found.append(f"""SELECT doc_id, '{name}' AS kind, {rank} AS rank, {str(name in WEAK).lower()} AS weak,
  list_sum(list_transform(g[1:i], lambda z: length(z))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda z: length(z))), 0) AS s, length(m[i]) AS n
FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, {p}, 0) AS m, regexp_extract_all(text, {p}, {k.group}) AS own, string_split_regex(text, {p}) AS g FROM documents WHERE regexp_matches(text, {p})))
WHERE length(own[i]) >= {k.least} AND {needs}""")
    completed = " OR ".join(f"(w.kind = '{n}' AND p.kind IN ({', '.join(quote(c) for c in k.completed_by)}))" for n, k in WEAK.items())
    return f"""WITH found AS MATERIALIZED ({' UNION ALL '.join(found)}),
base AS (SELECT * FROM found WHERE NOT weak),
likely AS (SELECT * FROM found w WHERE weak AND NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = w.doc_id AND b.s < w.s + w.n AND w.s < b.s + b.n)),
part AS (SELECT * FROM base UNION ALL SELECT * FROM likely),
span AS (SELECT * FROM base UNION ALL SELECT * FROM likely w WHERE EXISTS (SELECT 1 FROM part p WHERE p.doc_id = w.doc_id AND p.s <= w.s + w.n + {SCOPE} AND w.s <= p.s + p.n + {SCOPE} AND ({completed}))),
line AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  string_agg(kind || ':' || s || ':' || (s + n), ',' ORDER BY s, rank) FILTER (NOT weak) AS b, string_agg(kind || ':' || s || ':' || (s + n), ',' ORDER BY s, rank) AS a FROM span GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(b, '')) AS base_sha256, coalesce(a, '') AS spans
FROM documents d LEFT JOIN line USING (doc_id)"""


ORACLE = {"op3_secret_links": _sql()}
