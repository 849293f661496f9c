"""Tool definitions and calls, inference records and run summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import hashing as H
from ..functions import text as T
from ..session import checkpointed
from ..sources.ranges import read_ranges
from ..violations import Checked, ContractError, split_by

#: Tools of a catalogue that is held as one map.
MAPPED = 10_000
_NAMED = "name string, description string, parameters string"
_ITEM = "name string, description string, input_schema string, function string"
# The parameters of a tool that states none.
NO_SCHEMA, ANY_OBJECT = '{"type":"object"}', '{"additionalProperties":true,"type":"object"}'


def _object(c: Column) -> Column:
    """The text if it begins as a JSON object does, else null."""
    return F.when(F.regexp_like(c, F.lit(r"^\s*\{")), c)


def tool_definitions(raw: Column) -> Column:
    """Tools of a JSON list in one form, array<struct<name, description, parameters>>: flat ones lifted, parameters an
    object in canonical form, flat ones without a name out; no list gives no tools.

    Elements, functions and parameters count as objects also where they are JSON texts of one.
    """
    def form(item: Column) -> Column:
        t = F.from_json(_object(item), _ITEM)
        f = F.from_json(_object(t["function"]), _NAMED)
        nested = f.isNotNull()
        flat = F.struct(t["name"].alias("name"), t["description"].alias("description"), F.coalesce(t["input_schema"], F.lit(NO_SCHEMA)).alias("parameters"))
        tool = F.when(nested, f).when(F.coalesce(t["name"], F.lit("")) != "", flat)
        text = lambda c: F.coalesce(tool[c], F.lit("")).alias(c)
        return F.when(tool.isNotNull(), F.struct(text("name"), text("description"), F.coalesce(_object(tool["parameters"]), F.lit(ANY_OBJECT)).alias("parameters")))

    items = F.coalesce(F.from_json(F.when(F.regexp_like(raw, F.lit(r"^\s*\[")), raw), "array<string>"), F.array().cast("array<string>"))
    tools = F.filter(F.transform(items, form), lambda t: t.isNotNull())
    # all parameters of a row are brought to canonical form at once
    parameters = H.canonical_all(F.transform(tools, lambda t: t["parameters"]))
    return F.zip_with(tools, parameters, lambda t, p: F.struct(t["name"].alias("name"), t["description"].alias("description"), F.coalesce(p, F.lit(ANY_OBJECT)).alias("parameters")))


def call_ids(calls: Column, conv: Column, turn: Column) -> Column:
    """Calls with an id each: a missing one comes from the conversation, turn and place, so a rerun gives it again."""
    made = lambda i: F.concat(F.lit("call_"), F.left(F.sha2(F.concat_ws(":", conv.cast("string"), turn.cast("string"), i.cast("string")), 256), F.lit(24)))
    return F.transform(calls, lambda c, i: F.struct(F.coalesce(F.nullif(c["id"], F.lit("")), made(i)).alias("id"), c["name"].alias("name"), c["arguments"].alias("arguments")))


def strict_calls(df: DataFrame, calls: str = "calls") -> Checked:
    """Rows whose calls all have a name and arguments that are a JSON object."""
    named = F.forall(calls, lambda c: T.strip(F.coalesce(c["name"], F.lit(""))) != "")
    objects = F.forall(calls, lambda c: F.coalesce(F.startswith(F.ltrim(c["arguments"]), F.lit("{")) & F.try_parse_json(c["arguments"]).isNotNull(), F.lit(False)))
    return split_by(df, F.when(~named, "a call without a name").when(~objects, "arguments are no object"))


def schemas_for(df: DataFrame, tools: DataFrame, names: str = "names") -> DataFrame:
    """The known tools of each row's name list in its order; unknown names are left out.

    tools is the catalogue (name, schema; of equal names the least schema).
    One of at most MAPPED tools is gathered to a map; a larger one is joined
    with the names, which are then put together again by row.
    """
    one = tools.groupBy("name").agg(F.min("schema").alias("schema"))
    if one.count() <= MAPPED:
        catalogue = one.agg(F.map_from_entries(F.collect_list(F.struct("name", "schema"))).alias("_map"))
        found = F.filter(F.transform(names, lambda n: F.struct(n.alias("name"), F.try_element_at("_map", n).alias("schema"))), lambda x: x["schema"].isNotNull())
        return df.join(F.broadcast(catalogue)).withColumn("tools", found).drop("_map")
    rows = checkpointed(df.select(F.monotonically_increasing_id().alias("_id"), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), F.col(names).alias("_names")))
    asked = rows.select("_id", F.posexplode("_names").alias("_at", "name")).join(one.where("schema is not null"), "name")
    found = asked.groupBy("_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("_at", "name", "schema"))), lambda x: F.struct(x["name"].alias("name"), x["schema"].alias("schema"))).alias("tools"))
    none = F.array().cast(found.schema["tools"].dataType)
    return rows.join(found, "_id", "left").select("_row.*", F.coalesce("tools", none).alias("tools"))


def wire_messages(messages: Column) -> Column:
    """Cleaned messages as the JSON that goes over the wire: calls nested under function, their arguments a JSON text.

    Fields that a message lacks are left out, and so is whatever is no part
    of a cleaned message, such as names that begin with "_".
    """
    return _json(messages, lambda arguments: arguments)


def template_messages(messages: Column) -> Column:
    """The same for a template: arguments as objects."""
    return _json(messages, F.parse_json)


def _json(messages: Column, arguments) -> Column:
    def call(c):
        return F.struct(c["id"].alias("id"), c["type"].alias("type"), F.struct(c["name"].alias("name"), arguments(c["arguments"]).alias("arguments")).alias("function"))

    def one(m):
        calls = F.when(F.coalesce(F.size(m["tool_calls"]), F.lit(0)) > 0, F.transform(m["tool_calls"], call))
        return F.struct(m["role"].alias("role"), m["content"].alias("content"), m["tool_call_id"].alias("tool_call_id"), calls.alias("tool_calls"))

    return F.to_json(F.transform(messages, one))


def dispatch(calls: DataFrame, routes: DataFrame) -> Checked:
    """Calls with their executor; a name routed twice raises, an unrouted call is a violation."""
    if routes.groupBy("name").count().where("count > 1").limit(1).count():
        raise ContractError("a tool is routed twice")
    d = calls.join(routes.select("name", "executor"), "name", "left")
    return split_by(d, F.when(F.col("executor").isNull(), "no executor"))


def records(df: DataFrame) -> DataFrame:
    """Convenient inference records (id, text, image, audio, video arrays, evaluation) in one contract."""
    def files(kind):
        return F.transform(F.coalesce(F.col(kind), F.array().cast("array<string>")), lambda p: F.struct(F.lit(kind).alias("type"), p.alias("path")))

    m = F.concat(*[files(kind) for kind in ("image", "audio", "video")])
    kinds = F.array_sort(F.array_distinct(F.transform(m, lambda x: x["type"])))
    d = df.withColumn("_m", m)
    user = F.array(F.struct(F.col("text").alias("content"), F.lit("user").alias("role")))
    return d.select(
        F.col("id").cast("string").alias("condition_id"), F.when(F.size(kinds) > 0, F.array_join(kinds, "+")).otherwise("text").alias("modality"),
        F.to_json(user).alias("messages_json"), F.to_json("_m").alias("media_json"), F.col("evaluation").alias("evaluation_json"),
        F.when(T.strip(F.coalesce("text", F.lit(""))) == "", "no text").alias("violation"),
    )


# The scoring metrics.
METRICS = ("exact_match", "normalized_exact_match", "multiple_choice_accuracy")


def evaluation_contract(df: DataFrame, raw: str = "evaluation_json") -> DataFrame:
    """metric and reference of each row; unknown metrics, missing references, mixed metrics or choices that are no letter raise."""
    e = F.from_json(F.when(~F.coalesce(F.col(raw), F.lit("")).isin("", "null"), F.col(raw)), "metric string, reference string")
    d = df.withColumn("metric", e["metric"]).withColumn("reference", e["reference"])
    given = F.when(~F.coalesce(F.col(raw), F.lit("")).isin("", "null"), True)
    choice = F.regexp_like(T.strip(F.upper(T.nfkc(F.col("reference")))), F.lit(r"\A[A-Z]\z"))
    bad = F.when(given & ~F.coalesce(F.col("metric").isin(*METRICS), F.lit(False)), "unknown metric").when(given & F.col("reference").isNull(), "no reference").when(given & (F.col("metric") == "multiple_choice_accuracy") & ~choice, "the reference is no letter")
    found = d.select(bad.alias("b"), "metric").agg(F.max("b").alias("b"), F.countDistinct("metric").alias("n")).first()
    if found.b or found.n > 1:
        raise ContractError(found.b or "mixed metrics")
    return d


def worker_identities(df: DataFrame, ranks: int) -> DataFrame:
    """Batches that do not hold each rank and device once, with non-negative values and the first batch's devices."""
    first = df.groupBy("rank").agg(F.min_by("physical_device", "batch").alias("_d"))
    d = df.join(first, "rank")
    g = d.groupBy("batch").agg(F.count("*").alias("n"), F.countDistinct("rank").alias("r"), F.countDistinct("physical_device").alias("p"), F.bool_or(F.col("physical_device") != F.col("_d")).alias("moved"), F.min(F.least("allocated_peak_bytes", "reserved_peak_bytes")).alias("low"))
    reason = F.when(F.col("n") != ranks, "wrong number of workers").when(F.col("r") != ranks, "a rank twice").when(F.col("p") != ranks, "a device twice").when(F.col("moved"), "devices changed").when(F.col("low") < 0, "negative bytes")
    return g.select("batch", reason.alias("violation")).where("violation is not null")


def run_summary(samples: DataFrame, wall_seconds: float) -> DataFrame:
    """One row: samples, tokens, tokens per second of wall time and mean latency."""
    tokens = F.coalesce(F.sum("completion_tokens"), F.lit(0))
    return samples.agg(F.count("*").alias("samples"), tokens.alias("completion_tokens"), F.lit(wall_seconds).alias("wall_seconds"), (tokens / F.lit(wall_seconds)).alias("tps"), F.avg("latency_seconds").alias("mean_latency"))


def listing(paths: DataFrame, path: str, depth: int, most: int = 2000) -> DataFrame:
    """Paths not deeper than depth and outside .git, in order, the first ``most``."""
    parts = F.split(path, "/")
    return paths.where((F.size(parts) <= depth) & ~F.array_contains(parts, ".git")).orderBy(path).limit(most)


def slices(files: DataFrame, index: DataFrame, keys: list[str]) -> DataFrame:
    """index (keys, offset, nbytes, sha256) with the bytes of those ranges of the files (keys, path), read where the
    tasks run; a wrong checksum, a short or a missing file is marked and gives no bytes."""
    d = index.join(files.select(*keys, F.col("path").alias("_path")), keys, "left").withColumn("_path", F.coalesce("_path", F.lit("")))
    out = read_ranges(d, {"bytes": (F.col("_path"), F.col("offset"), F.col("nbytes"), F.col("sha256"), None)}, ["offset"]).drop("_path")
    return out.withColumn("violation", F.regexp_replace("violation", "^bytes: ", ""))
