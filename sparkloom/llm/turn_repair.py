"""Conversation structure repair by signature.

A conversation's turns become a string of one letter a turn, its role and
fault. Conversations of equal signatures have equal cheapest edits, so each
distinct signature is solved once, by memoised recursion over (turn, state);
the audit (the edits' initials) is joined back and replayed on the turns.

Letters: s, u, a for a role with that initial, o for any other, in upper case
if the text is truncated, "-" for a turn that has to go (blank or duplicate).
"""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

RE_ROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: Positions that the recursion goes down before it starts from memory.
_DEEP = 50
#: Roles by initial, and what a repaired conversation may go on with after each state.
_ROLES = {"s": "system", "u": "user", "a": "assistant"}
_NEXT = {"": ("s", "u"), "s": ("u",), "u": ("a",), "a": ("u",)}
_CLOSED = ("", "a")
_PUNCTUATION = ".!?"


def solve(signature: str) -> tuple[int, str]:
    """Cost and audit of the cheapest edits; of equal costs the audit that sorts first.

    A state is the last role given. Each edit has one following state (only
    user or assistant can be inserted or given), so the least initial of equal
    costs gives the least audit. More than two inserts in a row would come
    back to a state.
    """
    n, none = len(signature), (1 << 60, "", "", 0)

    @lru_cache(maxsize=None)
    def best(i: int, state: str, inserts: int) -> tuple[int, str, str, int]:
        """(cost of all from turn i on, first edit, state after it, inserts in a row after it)"""
        found = []
        given = "a" if state == "u" else "u"
        if i < n:
            letter = signature[i]
            kind, late = letter.lower(), TRUNCATED if letter.isupper() else 0
            found.append((DELETE + best(i + 1, state, 0)[0], "D", state, 0))
            if letter != "-":
                if kind in _NEXT[state]:
                    found.append((late + best(i + 1, kind, 0)[0], "K", kind, 0))
                found.append((RE_ROLE + late + best(i + 1, given, 0)[0], "R", given, 0))
        elif state in _CLOSED:
            return 0, "", state, 0
        if inserts < 2:
            found.append((INSERT + best(i, given, inserts + 1)[0], "I", given, inserts + 1))
        return min(found, default=none)

    for i in range(n - n % _DEEP, -1, -_DEEP):
        for state in _NEXT:
            best(i, state, 0)
    i, state, inserts, audit = 0, "", 0, []
    while True:
        _, edit, state, inserts = best(i, state, inserts)
        if not edit:
            return best(0, "", 0)[0], "".join(audit)
        audit.append(edit)
        i += edit != "I"


def solved(signatures: DataFrame) -> DataFrame:
    """signature, cost and audit of each row of signatures."""

    def run(batches):
        for batch in batches:
            out = [solve(s) for s in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c for c, _ in out], pa.int64()), pa.array([a for _, a in out], pa.string())], names=["signature", "cost", "audit"])

    return signatures.mapInArrow(run, "signature string, cost long, audit string")


def blank(text: Column) -> Column:
    return ~text.rlike(r"[^\x20\x09-\x0D]")


def truncated(text: Column) -> Column:
    """The last character that is no space ends no sentence."""
    return ~text.rlike(rf"[{_PUNCTUATION}][\x20\x09-\x0D]*\z")


def faults(turns: DataFrame) -> DataFrame:
    """turns (conv, turn, role, text, at) with fault (blank, duplicate, truncated or null), place, from 1, and
    new: the first of its turn number.

    Order in a conversation: turn, nulls first, then role, text and at.
    """
    order = [F.col("turn").asc_nulls_first(), "role", "text", "at"]
    seen = F.row_number().over(Window.partitionBy("conv", "role", "text").orderBy(*order))
    fault = F.when(blank(F.col("text")), "blank").when(F.col("seen") > 1, "duplicate").when(truncated(F.col("text")), "truncated")
    talk = Window.partitionBy("conv").orderBy(*order)
    numbered = turns.withColumn("seen", seen).withColumn("place", F.row_number().over(talk)).withColumn("new", F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(F.lag("turn").over(talk)))
    return numbered.withColumn("fault", fault).drop("seen")


def _letter() -> Column:
    initial = F.substring("role", 1, 1)
    letter = F.when(initial.isin(*_ROLES), initial).otherwise("o")
    return F.when(F.col("fault").isin("blank", "duplicate"), "-").when(F.col("fault") == "truncated", F.upper(letter)).otherwise(letter)


def _replayed(rows: DataFrame) -> DataFrame:
    """conv and repaired (role, text of each turn) of rows: conv, audit, roles, texts."""
    kind = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))

    def run(batches):
        for batch in batches:
            out = []
            for audit, roles, texts in zip(*(c.to_pylist() for c in batch.columns[1:4]), strict=True):
                done, i, last = [], 0, ""
                for edit in audit or "":
                    if edit in "IR":
                        last = "a" if last == "u" else "u"
                        done.append({"role": _ROLES[last], "text": texts[i] if edit == "R" else ""})
                    elif edit == "K":
                        last = roles[i][:1]
                        done.append({"role": roles[i], "text": texts[i]})
                    i += edit != "I"
                out.append(done)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], names=["conv", "repaired"])

    return rows.mapInArrow(run, f"conv {rows.schema['conv'].dataType.simpleString()}, repaired array<struct<role:string,text:string>>")


def repair(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", at: str | None = None) -> DataFrame:
    """conv, gaps, blank, duplicate, truncated, illegal, cost, signature, audit and repaired of each conversation.

    gaps: turn numbers missing between the least and the greatest. blank,
    duplicate and truncated count turns by their first fault: no character
    but spaces; role and text as an earlier turn's; last character no end of
    a sentence. illegal counts neighbours whose role initials are not su, ua
    or au. cost and audit are those of the cheapest edits (K keep, R give
    user or assistant, D delete, I insert an empty turn) after which the
    initials are "" or s?(ua)+; repaired has the turns after them.

    Turns go by number, nulls first; equal ones by role, text and the column
    at, if given. Null roles and texts are one space: a role of no known
    initial, a blank text. Rows without a conversation are one conversation.
    Repeated rows are duplicates. Text of any length is carried whole; a
    conversation is one row of the result, so its texts are less than 2 GB.
    An empty table gives no rows; other columns are not read.
    """
    spark = turns.sparkSession
    common.bounded_batches(spark)
    scratch = common.Scratch(spark)
    plain = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    rows = turns.select(F.col(f"`{conv}`").alias("conv"), F.col(f"`{turn}`").cast("long").alias("turn"), plain(role).alias("role"), plain(text).alias("text"), (F.col(f"`{at}`") if at else F.lit(0)).alias("at"))
    row = F.struct("place", "role", "text", _letter().alias("letter"), "fault").alias("row")
    talks = faults(rows).select("conv", "turn", "new", row).groupBy("conv").agg(
        F.sort_array(F.collect_list("row")).alias("rows"), F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_if("new"), F.lit(0)).alias("gaps"),
        *[F.count_if(F.col("row.fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")],
    )
    initials = F.transform("rows.role", lambda r: F.substring(r, 1, 1))
    pairs = F.zip_with(F.slice("initials", 1, F.size("initials") - 1), F.slice("initials", 2, F.size("initials") - 1), lambda x, y: F.concat(x, y))
    illegal = F.size(F.filter(pairs, lambda p: ~p.isin("su", "ua", "au"))).cast("long")
    talks = talks.withColumn("initials", initials).withColumn("illegal", illegal)
    talks = talks.select("conv", "gaps", "blank", "duplicate", "truncated", "illegal", F.array_join("rows.letter", "").alias("signature"), F.col("rows.role").alias("roles"), F.col("rows.text").alias("texts"))
    talks = scratch.written(talks, "talks")
    times = talks.groupBy("signature").agg(F.count("*").alias("times"))
    total = talks.count()
    audits = common.checkpointed(solved(times.select("signature")).join(times, "signature"))
    # one signature may be that of a third of all conversations
    known = common.join_counted(talks, audits, "signature", "times", total)
    kept = ["conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "signature", "audit"]
    return _replayed(known.select(F.struct(*kept).alias("conv"), "audit", "roles", "texts")).select("conv.*", "repaired")


def damaged(conversations: DataFrame) -> DataFrame:
    """Turns (conv_id, turn, role, text, copy) with faults put in by a hash of conversation and turn.

    crc32 of "conv_id:turn" modulo 20: 0 drops the turn, 1 empties its text,
    2 takes out its ends of sentences, 3 repeats it, 4 gives it to the user.
    """
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    case = F.crc32(F.concat(plain("conv_id"), F.lit(":"), plain("turn"))) % 20
    rows = conversations.select("conv_id", "turn", plain("role").alias("role"), plain("text").alias("text"), case.alias("case"))
    text = F.when(F.col("case") == 1, "").when(F.col("case") == 2, F.translate("text", _PUNCTUATION, "")).otherwise(F.col("text"))
    role = F.when(F.col("case") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("case") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.where("case <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy"))


def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    talks = common.table(spark, sf_dir, "conversations")
    done = repair(damaged(talks), at="copy")
    lines = F.array_join(F.transform("repaired", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    done = done.select(F.col("conv").alias("found"), F.lit(1).alias("here"), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.sha2(lines, 256).alias("repaired_sha256"), "signature")
    out = talks.select("conv_id").distinct().join(done, F.col("conv_id").eqNullSafe(F.col("found")), "left")
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"), F.coalesce("signature", F.lit("")).alias("signature"))


QUERIES = {"op12_turn_repair": op12_turn_repair}


def _sql() -> str:
    """The query in SQL: CRC-32 over a table made from its polynomial, and the cheapest edits from front to back,
    one step a turn, the best of each state by cost and audit."""
    best = lambda *x: f"list_sort(list_filter([{', '.join(x)}], lambda x: x IS NOT NULL))[1]"
    add = lambda s, cost, edit: f"CASE WHEN {s} IS NOT NULL THEN {{'cost': {s}.cost + {cost}, 'audit': {s}.audit || '{edit}'}} END"
    keep = lambda s, kind: f"CASE WHEN lower(c) = '{kind}' THEN {add(s, 'late', 'K')} END"
    role = lambda s: f"CASE WHEN c <> '-' THEN {add(s, f'{RE_ROLE} + late', 'R')} END"
    drop = lambda s: add(s, DELETE, "D")
    more = lambda s: add(s, INSERT, "I")
    to_u = [f(*x) for k in ("e", "s", "a") for f, x in ((keep, (k, "u")), (role, (k,)))]
    zeros = ", ".join(f"coalesce({c}, 0)::BIGINT AS {c}" for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost"))
    return rf"""WITH RECURSIVE crc AS MATERIALIZED (SELECT list(list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END) ORDER BY n) AS t FROM range(256) r(n)),
p AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
f AS (SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(k, ''), lambda z: ascii(z)::BIGINT)), lambda x, y: xor(x >> 8, t[(xor(x, y) & 255) + 1])), 4294967295::BIGINT) % 20 AS f FROM p, crc),
d AS (SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role, CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN f = 3 THEN [0, 1] ELSE [0] END) AS copy FROM f WHERE f <> 0),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen, row_number() OVER t AS place, lag(role) OVER t AS before FROM d WINDOW t AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)),
x AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^ 	-
]') THEN 'blank' WHEN seen > 1 THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][ 	-
]*\z') THEN 'truncated' END AS fault FROM n),
l AS (SELECT *, CASE WHEN role[1] IN ('s', 'u', 'a') THEN role[1] ELSE 'o' END AS r FROM x),
talk AS MATERIALIZED (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
  count(*) FILTER (place > 1 AND before[1] || role[1] NOT IN ('su', 'ua', 'au')) AS illegal, list(role ORDER BY place) AS roles, list(text ORDER BY place) AS texts,
  string_agg(CASE WHEN fault IN ('blank', 'duplicate') THEN '-' WHEN fault = 'truncated' THEN upper(r) ELSE r END, '' ORDER BY place) AS signature FROM l GROUP BY conv_id),
w AS (
  SELECT signature, 0 AS i, {{'cost': 0, 'audit': ''}} AS e, NULL::STRUCT(cost INTEGER, audit VARCHAR) AS s, {{'cost': {INSERT}, 'audit': 'I'}} AS u, {{'cost': {2 * INSERT}, 'audit': 'II'}} AS a FROM (SELECT DISTINCT signature FROM talk)
  UNION ALL
  SELECT signature, i, e, s, u, {best("a", more("u"))} FROM (SELECT signature, i, e, s, {best("u", more("e"), more("s"), more("a"))} AS u, a FROM (
    SELECT signature, i + 1 AS i, {drop("e")} AS e, {best(drop("s"), keep("e", "s"))} AS s, {best(drop("u"), *to_u)} AS u, {best(drop("a"), keep("u", "a"), role("u"))} AS a
    FROM (SELECT *, signature[i + 1] AS c, CASE WHEN signature[i + 1] IN ('S', 'U', 'A', 'O') THEN {TRUNCATED} ELSE 0 END AS late FROM w WHERE i < length(signature))))),
z AS (SELECT signature, {best("e", "a")} AS z FROM w WHERE i = length(signature)),
y AS (SELECT t.*, z.cost AS cost, z.audit AS audit, list_transform(range(1, length(z.audit) + 1), lambda j: length(replace(z.audit[:j], 'I', ''))) AS src FROM talk t JOIN z USING (signature)),
v AS (SELECT *, list_transform(list_filter(range(1, length(audit) + 1), lambda j: audit[j] <> 'D'), lambda j: {{'edit': audit[j], 'role': roles[src[j]], 'text': texts[src[j]]}}) AS kept FROM y),
o AS (SELECT *, len(kept) > 0 AND kept[1].edit = 'K' AND kept[1].role[1] = 's' AS led FROM v),
h AS (SELECT *, sha256(array_to_string(list_transform(kept, lambda q, j: CASE WHEN q.edit = 'K' THEN q.role WHEN (j % 2 = 1) = led THEN 'assistant' ELSE 'user' END || ':' || CASE WHEN q.edit = 'I' THEN '' ELSE q.text END), chr(10))) AS digest FROM o)
SELECT c.conv_id, {zeros}, coalesce(audit, '') AS audit, coalesce(digest, sha256('')) AS repaired_sha256, coalesce(signature, '') AS signature
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN h ON h.conv_id IS NOT DISTINCT FROM c.conv_id"""


ORACLE = {"op12_turn_repair": _sql()}
