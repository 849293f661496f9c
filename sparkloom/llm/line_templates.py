"""Line dedup by a log-template tree.

A line's path in the tree is its number of words and its first LEAD words;
words with a digit are variable from the start. In a leaf, a word is constant
at its place if enough documents have it there, else it is a variable field;
a line's template is its constants and fields. Templates that recur across
documents are dropped, every line of them.

Copies of one document are no recurrence. Two texts are near copies if half
of their word pairs are the same, estimated from SIGNS minima of 4 bits each.
A template recurs if MIN_DOCS of its texts are no near copies of each other:
one text after the other is taken out with its near copies, and some are left
after MIN_DOCS - 1 of them. Neither the number of copies nor lines that
different documents share decide.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .suffix_dedup import screen

LEAD = 3
#: Lines with fewer words have no fields: digits count, and a line is its own template.
MIN_WORDS = 3
MIN_DOCS = 5
#: Dropped lines that may be sent to the workers (8 bytes each, counted first); more are joined.
BROADCAST_LINES = 1_000_000
#: Minima of a text's signature, 16 to a long, and how many may differ between near copies:
#: (1 - 1/2) * (1 - 1/16) of them do at similarity 1/2, as 4 bits agree by chance once in 16.
SIGNS = 32
MOST_OFF = 15
_MASK = np.uint64(0x9D3A5C1F00C0FFEE)
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_TURN, _TIMES = (common._lut(k)[:SIGNS].astype(np.uint32) for k in (5, 6))
_TIMES |= np.uint32(1)


class Lines:
    """All lines of some texts; words are fingerprints, those with a digit are _MASK in lines of MIN_WORDS words or more."""

    def __init__(self, offs: np.ndarray, data: np.ndarray):
        h, starts, ends, at = common.word_hashes(offs, data)
        digits = np.flatnonzero(_DIGIT[data])
        breaks = np.flatnonzero(data == 10)
        self.plain, self.at = h, at
        line = np.searchsorted(breaks, starts)  # breaks before the word
        text = np.searchsorted(offs[1:], starts, side="right") if len(starts) else np.zeros(0, np.int64)
        new = np.ones(len(starts), bool)
        new[1:] = (np.diff(line) != 0) | (np.diff(text) != 0)
        self.first = np.flatnonzero(new)  # first word of each line with words
        self.size = np.diff(np.append(self.first, len(starts)))
        self.text = text[self.first]
        # number of the line in its text
        self.number = line[self.first] - np.searchsorted(breaks, offs[:-1])[self.text] if len(self.first) else self.first
        masked = (np.searchsorted(digits, ends) > np.searchsorted(digits, starts)) & (np.repeat(self.size, self.size) >= MIN_WORDS)
        self.words = np.where(masked, _MASK, h)
        place = np.arange(len(starts)) - np.repeat(self.first, self.size)
        with np.errstate(over="ignore"):
            if len(starts):
                v = self.words * common.powers(int(self.size.max()))[place]
                count = self.size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
                self.line = common._mix(np.add.reduceat(v, self.first) + count)
                lead = count.copy()
                for k in range(LEAD):
                    there = self.size > k
                    lead[there] = common._mix(lead[there] * np.uint64(3) + self.words[self.first[there] + k])
                self.leaf = common._mix(lead)
            else:
                self.line = self.leaf = np.zeros(0, np.uint64)

    def prints(self, n: int) -> np.ndarray:
        """A print of each of n texts, by its words; 0 without words."""
        whole, size = np.zeros(n, np.uint64), np.diff(self.at)
        full = np.flatnonzero(size > 0)
        if len(full):
            with np.errstate(over="ignore"):
                place = np.arange(len(self.plain)) - np.repeat(self.at[full], size[full])
                whole[full] = common._mix(np.add.reduceat(self.plain * common.powers(int(size.max()))[place], self.at[full]))
        return whole

    def signatures(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Two longs of minima over the word pairs, of each of n texts; 0 without pairs."""
        signs = np.zeros((2, n), np.uint64)
        size = np.diff(self.at)
        full = np.flatnonzero(size > 0)
        more = np.flatnonzero(size > 1)
        if len(more):
            with np.errstate(over="ignore"):
                begins = np.ones(len(self.plain), bool)
                begins[self.at[full] + size[full] - 1] = False  # no pair begins with a text's last word
                k = np.flatnonzero(begins)
                pairs = (common._mix(self.plain[k] * np.uint64(3) + self.plain[k + 1]) >> np.uint64(32)).astype(np.uint32)
                first = np.cumsum(size[more] - 1) - (size[more] - 1)
                for j in range(SIGNS):
                    low = np.minimum.reduceat((pairs ^ _TURN[j]) * _TIMES[j], first)
                    four = (low * np.uint32(0x9E3779B1)) >> np.uint32(28)
                    signs[j // 16, more] |= four.astype(np.uint64) << np.uint64(4 * (j % 16))
        return signs[0], signs[1]


def _long(a: np.ndarray) -> pa.Array:
    return pa.array(a.view(np.int64))


def _uses(texts: DataFrame) -> DataFrame:
    """leaf, line, and print and signature of the text, for each line with words."""

    def run(batches):
        for batch in batches:
            for _, n, offs, data in common.text_slices(batch):
                x = Lines(offs, data)
                yield pa.RecordBatch.from_arrays([_long(x.leaf), _long(x.line), *[_long(v[x.text]) for v in (x.prints(n), *x.signatures(n))]], names=["leaf", "line", "print", "signs_0", "signs_1"])

    return texts.mapInArrow(run, "leaf long, line long, print long, signs_0 long, signs_1 long")


def _tokens(texts: DataFrame, wanted) -> DataFrame:
    """line, leaf and words of the wanted lines, once a slice."""

    def run(batches):
        w = wanted.value
        for batch in batches:
            for _, _, offs, data in common.text_slices(batch):
                x = Lines(offs, data)
                k = np.flatnonzero(w.has(x.line))
                if len(k):
                    _, one = np.unique(x.line[k], return_index=True)
                    k = k[one]
                    lists = pa.array([x.words[a : a + s].view(np.int64) for a, s in zip(x.first[k], x.size[k], strict=True)], pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays([_long(x.leaf[k]), _long(x.line[k]), lists], names=["leaf", "line", "words"])

    return texts.mapInArrow(run, "leaf long, line long, words array<long>")


def _off(signs: str, other: str) -> F.Column:
    """Of 16 minima of 4 bits, the number that differ."""
    x = F.col(signs).bitwiseXOR(F.col(other))
    x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
    x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
    return F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111)))


def _of_different_texts(texts: DataFrame, min_docs: int) -> DataFrame:
    """template: those of which min_docs texts are no near copies of each other.

    texts: template, print and signature, once each. A round takes the text
    with the least print and its near copies out of each template, so the
    rows are passed min_docs - 1 times at most; no group is gathered, and a
    template that a third of all texts have is no hot key.
    """
    scratch = common.Scratch(texts.sparkSession)
    rest = scratch.written(texts, "texts")
    for turn in range(min_docs - 1):
        one = rest.groupBy("template").agg(F.min_by("signs_0", "print").alias("one_0"), F.min_by("signs_1", "print").alias("one_1"), F.count("*").alias("n"))
        # so many texts have to be left for the rounds to come
        one = common.checkpointed(one.where(F.col("n") >= min_docs - turn))
        total = one.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        other = common.join_counted(rest, one, "template", "n", total).where(_off("signs_0", "one_0") + _off("signs_1", "one_1") > MOST_OFF)
        rest = scratch.written(other.select(*texts.columns), f"texts-{turn}")
        scratch.remove("texts" if not turn else f"texts-{turn - 1}")
    return rest.select("template").distinct()


def recurring_lines(docs: DataFrame, text_col: str = "text", min_docs: int = MIN_DOCS) -> DataFrame:
    """line: fingerprints of the lines (digits masked) whose template recurs."""
    common.bounded_batches(docs.sparkSession)
    spark = docs.sparkSession
    scratch, sum_of = common.Scratch(spark), lambda d, c: d.agg(F.coalesce(F.sum(c), F.lit(0))).first()[0]
    texts = docs.select(F.col(f"`{text_col}`").cast("string").alias("text"))
    uses = scratch.written(_uses(texts).distinct(), "uses")
    leaves = common.checkpointed(uses.groupBy("leaf").agg(F.count("*").alias("c"), F.min("print").alias("lo"), F.max("print").alias("hi")).where(f"c >= {min_docs} and lo <> hi").select("leaf", "c"))
    open_ = scratch.written(common.join_counted(uses, leaves, "leaf", "c", sum_of(leaves, "c")).select(*uses.columns), "open")
    scratch.remove("uses")
    lines = common.checkpointed(open_.groupBy("leaf", "line").agg(F.count("*").alias("docs")))
    wanted = spark.sparkContext.broadcast(screen(lines, "line", lines.count()))
    words = _tokens(texts, wanted).dropDuplicates(["leaf", "line"]).join(lines, ["leaf", "line"])
    slot = F.xxhash64("leaf", "place", "word").alias("slot")
    words = words.select("leaf", "line", "docs", F.size("words").alias("size"), F.posexplode("words").alias("place", "word"))
    words = scratch.written(words.select("*", slot), "words")
    slots = words.groupBy("slot").agg(F.sum("docs").alias("c"), F.count("*").alias("rows"), F.first("word").alias("w"))
    slots = common.checkpointed(slots.select("slot", "rows", ((F.col("c") >= min_docs) & (F.col("w") != int(_MASK.view(np.int64)))).alias("fixed")))
    fields = common.join_counted(words, slots, "slot", "rows", sum_of(slots, "rows")).withColumn("word", F.when(F.col("fixed"), F.col("word")))
    shaped = fields.groupBy("leaf", "line").agg(F.first("docs").alias("docs"), F.first("size").alias("size"), F.count("word").alias("constants"), F.sort_array(F.collect_list(F.struct("place", "word"))).alias("shape"))
    # with too few constants a template would say nothing: the line stands for itself
    template = F.when((F.col("size") >= MIN_WORDS) & (2 * F.col("constants") >= F.col("size")), F.xxhash64("leaf", "shape")).otherwise(F.xxhash64("leaf", "line"))
    shaped = common.checkpointed(shaped.select("line", "docs", template.alias("template")))
    found = common.join_counted(open_, shaped, "line", "docs", sum_of(shaped, "docs"))
    recurring = _of_different_texts(found.select("template", "print", "signs_0", "signs_1").distinct(), min_docs)
    recurring = common.checkpointed(shaped.groupBy("template").agg(F.count("*").alias("n")).join(recurring, "template"))
    gone = common.checkpointed(common.join_counted(shaped, recurring, "template", "n", sum_of(recurring, "n")).select("line").distinct())
    scratch.remove("open", "words")
    common.release(spark)
    return gone


def drop_lines(docs: DataFrame, text_col: str = "text", min_docs: int = MIN_DOCS) -> DataFrame:
    """All columns of docs with the recurring lines taken out of the text, in a
    struct "kept"; n_lines and n_dropped beside it.

    Lines are what \\n separates; those without words stay. A null text stays null with 0 lines; an empty one has one line, no words
    and stays. Repeated rows are copies and no recurrence. An empty table
    gives no rows. Other columns pass unread, whatever their names.
    """
    spark = docs.sparkSession
    gone = recurring_lines(docs, text_col, min_docs)
    count = gone.count()
    cols = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in cols if c != text_col], F.lit(0).alias("_")).alias("other"), F.col(f"`{text_col}`").cast("string").alias("text"))
    if count <= BROADCAST_LINES:
        sent = spark.sparkContext.broadcast(np.sort(np.array([r.line for r in gone.collect()], np.int64).view(np.uint64)))
        rows = rows.withColumn("gone", F.lit(None).cast("array<long>"))
    else:
        sent = spark.sparkContext.broadcast(None)
        rows = _with_gone(rows, gone, spark.sparkContext.broadcast(screen(gone, "line", count)))
    schema = rows.select("other", "text", F.lit(0).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_dropped")).schema

    def run(batches):
        for batch in batches:
            for at, n, offs, data in common.text_slices(batch):
                part = batch.slice(at, n)
                x = Lines(offs, data)
                if sent.value is not None:
                    bad = np.isin(x.line, sent.value)
                else:
                    own = [frozenset(g or ()) for g in part.column(2).to_pylist()]
                    bad = np.array([v in own[t] for v, t in zip(x.line.view(np.int64).tolist(), x.text.tolist(), strict=True)], bool)
                texts = part.column(1).to_pylist()
                n_lines = [0 if t is None else t.count("\n") + 1 for t in texts]
                dropped = np.bincount(x.text[bad], minlength=n)
                out: dict[int, set[int]] = {}
                for t, k in zip(x.text[bad].tolist(), x.number[bad].tolist(), strict=True):
                    out.setdefault(t, set()).add(k)
                for t, ks in out.items():
                    texts[t] = "\n".join(s for k, s in enumerate(texts[t].split("\n")) if k not in ks)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, part.schema.field(1).type), pa.array(n_lines, pa.int64()), pa.array(dropped, pa.int64())], names=["other", "text", "n_lines", "n_dropped"])

    done = rows.mapInArrow(run, schema)
    kept = F.struct(*[F.col("text").alias(c) if c == text_col else F.col(f"other.`{c}`").alias(c) for c in cols])
    return done.select(kept.alias("kept"), "n_lines", "n_dropped")


def _with_gone(rows: DataFrame, gone: DataFrame, likely) -> DataFrame:
    """Beyond what may be broadcast: each row's recurring lines, by a join on the line."""
    keyed = common.written(rows.withColumn("row", F.monotonically_increasing_id()), "line-rows")

    def run(batches):
        for batch in batches:
            for at, n, offs, data in common.text_slices(batch):
                x = Lines(offs, data)
                ok = likely.value.has(x.line)
                row = batch.column(0).slice(at, n).to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(row[x.text[ok]]), _long(x.line[ok])], names=["row", "line"])

    pairs = common.written(keyed.select("row", "text").mapInArrow(run, "row long, line long"), "line-uses")
    per = common.checkpointed(pairs.groupBy("line").agg(F.count("*").alias("n")).join(gone, "line"))
    total = per.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    found = common.join_counted(pairs, per, "line", "n", total).groupBy("row").agg(F.collect_set("line").alias("gone"))
    return keyed.join(found, "row", "left").select("other", "text", "gone")


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the columns of docs without the recurring lines.

    A document that loses all its words this way goes; n_chars, where there
    is one, is that of the text that stays. Null and empty texts, rows
    without an id and repeated rows stay as they are; an empty table stays
    empty.
    """
    rows = drop_lines(docs).where((F.col("n_dropped") == 0) | F.regexp_like(F.coalesce("kept.text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]")))
    value = {c: F.col(f"kept.`{c}`") for c in docs.columns}
    if "n_chars" in value:
        value["n_chars"] = F.when(F.col("n_dropped") == 0, value["n_chars"]).otherwise(F.length("kept.text")).cast(docs.schema["n_chars"].dataType)
    return rows.select(*[v.alias(c) for c, v in value.items()])


def op1_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = drop_lines(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select(F.col("kept.doc_id").cast("long").alias("doc_id"), "n_lines", "n_dropped", F.sha2(F.coalesce("kept.text", F.lit("")), 256).alias("kept_sha256"))


QUERIES = {"op1_line_templates": op1_line_templates}
ORACLE: dict[str, str] = {}
