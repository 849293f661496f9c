"""Quality rules as a bitmask ledger, DataFrame functions only.

Every rule is evaluated once per text. The ledger keeps the measurements and
one integer with a bit for each failed rule; policies are versioned masks
over those bits, and ablations are bitwise aggregates, so neither reads the
texts again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: White space that separates words: x20 and x09-x0D.
_BLANKS = "\t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Rule k fails where its condition over the measurements is true; its bit is 2**k.
#: New rules go to the end, so that kept ledgers stay readable.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 10"),
    ("repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    ("symbols", "100 * n_symbols > 50 * n_words"),
    ("duplicate_lines", "100 * n_dup_lines > 30 * n_lines"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 20 * n_words"),
    ("capitals", "100 * n_upper > 50 * word_chars"),
)
BASE_RULES = ("few_words", "repeated_windows")
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper")


def bit(rule: str) -> int:
    return 1 << [name for name, _ in RULES].index(rule)


def mask(rules) -> int:
    out = 0
    for r in rules:
        out |= bit(r)
    return out


@dataclass(frozen=True)
class Policy:
    """A text is kept if none of these rules failed."""

    version: str
    rules: tuple[str, ...]


POLICIES = {
    "v1": Policy("v1", BASE_RULES),
    "v2": Policy("v2", tuple(name for name, _ in RULES)),
    # v2 without duplicate_lines: on labelled rows the texts that fail it alone are good ones
    "v3": Policy("v3", (*BASE_RULES, "symbols", "short_words", "long_words", "capitals")),
}
CURRENT = "v3"


def _repeat_words(grams: Column) -> Column:
    """Words in windows found twice or more, from the window hashes in text order.

    Windows are sorted as (hash, place); a window repeats if a neighbour has
    its hash. The places, sorted again, cover min(gap, WINDOW) words each.
    """
    def covered(at: Column) -> Column:
        gaps = F.transform(at, lambda p, i: F.least(F.coalesce(F.get(at, i + 1) - p, F.lit(WINDOW)), F.lit(WINDOW)))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, g: a + g)

    def places(s: Column) -> Column:
        hit = F.filter(s, lambda e, i: (F.get(s, i - 1)["h"] == e["h"]).eqNullSafe(True) | (F.get(s, i + 1)["h"] == e["h"]).eqNullSafe(True))
        return F.sort_array(F.transform(hit, lambda e: e["p"]))

    pairs = F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("p")))
    # one-element arrays name a value, so that it is computed once
    by_hash = F.transform(F.array(F.sort_array(pairs)), places)
    return F.get(F.transform(by_hash, covered), F.lit(0))


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """doc_id, the measurements and failed_bits; a narrow stage without a shuffle.

    carry adds doc_row, a struct of all columns of docs, so that a filter by
    the verdict needs no join.

    Measurements (long): n_words; word_chars (code points in words);
    n_symbols; n_dup_lines (lines with a word that equal an earlier one);
    n_repeat_words (words in WINDOW-word windows that the text has twice or
    more); n_lines (lines with a word); n_upper (A-Z).

    A null or empty text has no words and measures 0 everywhere, so it fails
    few_words; long texts are measured whole, in n log n. Repeated rows and null ids are judged row by row; an empty
    table gives no rows; other columns are not read.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    keep = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc_row")] if carry else []
    d = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.alias("_text"), *keep)
    keep = ["doc_row"] if carry else []
    # runs of one blank kind only: words split at single spaces leave empty ones, which the trim and " +" take away
    d = d.select("*", F.trim(F.translate("_text", _BLANKS, " " * len(_BLANKS))).alias("_flat"))
    d = d.select(
        "doc_id",
        *keep,
        F.when(F.col("_flat") == "", F.array().cast("array<string>")).otherwise(F.split("_flat", " +", -1)).alias("_words"),
        F.length(F.translate("_text", " " + _BLANKS, "")).cast("long").alias("word_chars"),
        (F.length("_text") - F.length(F.translate("_text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.length("_text") - F.length(F.translate("_text", _UPPER, ""))).cast("long").alias("n_upper"),
        F.filter(F.split("_text", "\n", -1), lambda x: F.trim(F.translate(x, _BLANKS, " " * len(_BLANKS))) != "").alias("_lines"),
    )
    # a word is hashed once, a window from the hashes of its words
    d = d.withColumn("_words", F.transform("_words", lambda x: F.xxhash64(x)))
    n_windows = F.size("_words") - (WINDOW - 1)
    w = F.col("_words")
    grams = F.transform(F.sequence(F.lit(0), n_windows - 1), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)]))
    d = d.select(
        "doc_id",
        *keep,
        F.size("_words").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        "n_upper",
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(n_windows > 0, grams).otherwise(F.array().cast("array<bigint>")).alias("_grams"),
    )
    repeats = F.when(F.size(F.array_distinct("_grams")) == F.size("_grams"), F.lit(0).cast("long")).otherwise(_repeat_words(F.col("_grams")))
    d = d.select("doc_id", *keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", repeats.alias("n_repeat_words"), "n_lines", "n_upper")
    bits = F.lit(0)
    for k, (_, fails) in enumerate(RULES):
        bits = bits.bitwiseOR(F.when(F.expr(fails), F.lit(1 << k)).otherwise(F.lit(0)))
    return d.select("*", bits.alias("failed_bits"))


def verdict(policy: Policy) -> Column:
    """True where the policy keeps the ledger's row."""
    return F.col("failed_bits").bitwiseAND(F.lit(mask(policy.rules))) == 0


def ablations(book: DataFrame, policy: Policy) -> DataFrame:
    """One row: kept and rejected rows, and for each rule of the policy how many
    rows fail it and how many would be kept without it (they fail it alone)."""
    m = mask(policy.rules)
    masked = F.col("failed_bits").bitwiseAND(F.lit(m))
    one = lambda cond: F.coalesce(F.sum(cond.cast("long")), F.lit(0).cast("long"))
    aggs = [F.lit(policy.version).alias("policy"), F.count("*").alias("n_rows"), one(masked == 0).alias("n_kept"), F.coalesce(F.bit_or(masked), F.lit(0)).alias("any_bits"), F.coalesce(F.bit_and(masked), F.lit(0)).alias("all_bits")]
    for name in policy.rules:
        b = bit(name)
        aggs += [one(masked.bitwiseAND(F.lit(b)) != 0).alias(f"fails_{name}"), one(masked == b).alias(f"alone_{name}")]
    return book.agg(*aggs)


def op7_quality_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = ledger(common.table(spark, sf_dir, "documents"))
    base_failed = F.col("failed_bits").bitwiseAND(F.lit(mask(BASE_RULES))) != 0
    return book.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed.alias("base_failed"), (~base_failed & verdict(POLICIES[CURRENT])).alias("kept"), "failed_bits")


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ablations of every policy version over one ledger of all documents, a row for each policy and rule."""
    book = common.written(ledger(common.table(spark, sf_dir, "documents")).select("failed_bits"), "ledger")
    out = None
    for policy in POLICIES.values():
        a = ablations(book, policy)
        rules = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(f"fails_{r}").alias("fails"), F.col(f"alone_{r}").alias("alone")) for r in policy.rules])).alias("r")
        a = a.select("policy", "n_rows", "n_kept", "any_bits", "all_bits", rules).select("policy", "n_rows", "n_kept", "any_bits", "all_bits", "r.*")
        out = a if out is None else out.unionByName(a)
    return out


def keep_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the columns of docs, without the rows that the current policy rejects.

    The verdict is computed beside the row itself: no join and no shuffle. The
    row number, which no plan may compute twice, keeps the filter above the
    measurements instead of copying them into its condition. A null or empty
    text has no words and goes; rows without an id and repeated rows are
    judged each; columns are carried inside a struct, whatever their names;
    an empty table stays empty.
    """
    book = ledger(docs, carry=True).withColumn("_row", F.monotonically_increasing_id())
    return book.where((F.col("_row") >= 0) & verdict(POLICIES[CURRENT])).select("doc_row.*")


QUERIES = {"op7_quality_ledger": op7_quality_ledger, "quality_ablations": quality_ablations}
_LEDGER_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
g AS (SELECT doc_id, i, w[i:i+4] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
r AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
c AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM (SELECT doc_id, i, unnest([0, 1, 2, 3, 4]) AS k FROM r) GROUP BY doc_id),
m AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words,
         len(l)::BIGINT AS n_lines, (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')))::BIGINT AS n_upper
  FROM d LEFT JOIN c ON c.doc_id = d.doc_id),
b AS (
  SELECT *, (CASE WHEN n_words < 10 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 100 * n_symbols > 50 * n_words THEN 4 ELSE 0 END + CASE WHEN 100 * n_dup_lines > 30 * n_lines THEN 8 ELSE 0 END
    + CASE WHEN word_chars < 2 * n_words THEN 16 ELSE 0 END + CASE WHEN word_chars > 20 * n_words THEN 32 ELSE 0 END
    + CASE WHEN 100 * n_upper > 50 * word_chars THEN 64 ELSE 0 END)::INTEGER AS failed_bits FROM m)
"""
ORACLE = {
    "op7_quality_ledger": _LEDGER_SQL
    + """SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (failed_bits & 3) <> 0 AS base_failed, (failed_bits & 119) = 0 AS kept, failed_bits FROM b""",
    "quality_ablations": _LEDGER_SQL
    + ", p(policy, rule, m, k) AS (VALUES "
    + ", ".join(f"('{p.version}', '{r}', {mask(p.rules)}, {bit(r)})" for p in POLICIES.values() for r in p.rules)
    + """)
SELECT policy, count(*) AS n_rows, count(*) FILTER (failed_bits & m = 0) AS n_kept, bit_or(failed_bits & m)::INTEGER AS any_bits, bit_and(failed_bits & m)::INTEGER AS all_bits,
       rule, count(*) FILTER (failed_bits & k <> 0) AS fails, count(*) FILTER (failed_bits & m = k) AS alone FROM b, p GROUP BY policy, rule, m, k""",
}
