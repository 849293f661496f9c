"""Training conditions and inference records: identity, media, batch kinds, payloads."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from ..functions import hashing as H
from ..functions import text as T
from . import messages as M

# Media types.
MEDIA = ("image", "audio", "video")
_MEDIA = "array<struct<type:string,path:string,sha256:string,has_audio:boolean>>"


def media_types(media_json: Column) -> Column:
    return F.transform(F.from_json(media_json, _MEDIA), lambda m: F.lower(F.coalesce(m["type"], F.lit(""))))


def modality(types: Column) -> Column:
    """Distinct types joined by "+", or text."""
    t = F.sort_array(F.array_distinct(F.filter(types, lambda x: x != "")))
    return F.when(F.size(t) > 0, F.array_join(t, "+")).otherwise("text")


def batch_kind(types: Column) -> Column:
    """Kind of a generation batch: more than one item is multi_image (images alone) or other."""
    first, n = F.get(types, F.lit(0)), F.size(types)
    images = F.forall(types, lambda x: x == "image")
    return F.when(n == 0, "text").when((n > 1) & images, "multi_image").when(n > 1, "other").when(first.isin(*MEDIA), first).otherwise("other")


def profile_kind(types: Column) -> Column:
    """Kind of a profiled record: unknown types do not count, several of one kind keep it."""
    known = F.filter(types, lambda x: x.isin(*MEDIA))
    kinds = F.array_distinct(known)
    return F.when(F.size(known) == 0, "text").when((F.size(kinds) == 1) & (F.get(kinds, F.lit(0)) == "image") & (F.size(known) > 1), "multi_image").when(F.size(kinds) == 1, F.get(kinds, F.lit(0))).otherwise("other")


def messages_json(messages: Column) -> Column:
    """Keys in order, nothing else: canonical for role and content."""
    return F.to_json(F.transform(messages, lambda m: F.struct(m["content"].alias("content"), m["role"].alias("role"))))


def conditions(df: DataFrame, seed: int, split: str = "train", fallback: str = "general_instruction") -> DataFrame:
    """df (messages, tools_json, media_json, language, reference) with ids and derived columns.

    Ids are SHA-256 over canonical JSON, so they do not depend on the run.
    Rows that do not end with user or tool input, or have no user, carry a violation.
    """
    d = df.withColumn("messages", M.merged(F.col("messages")))
    media = F.from_json(F.coalesce("media_json", F.lit("[]")), _MEDIA)
    identity = F.to_json(F.transform(media, lambda m: F.struct(F.coalesce(m["has_audio"], F.lit(False)).alias("has_audio"), F.coalesce(m["sha256"], F.lit("")).alias("sha256"), F.lower(F.coalesce(m["type"], F.lit(""))).alias("type"))))
    d = d.withColumn("messages_json", messages_json(F.col("messages")))
    d = d.withColumn("condition_id", F.sha2(F.concat_ws("\x1f", F.lit("condition"), "messages_json", F.coalesce("tools_json", F.lit("[]")), identity), 256))
    users = F.filter("messages", lambda m: m["role"] == "user")
    last_user, last = F.get(users, F.size(users) - 1)["content"], F.get("messages", F.size("messages") - 1)["role"]
    reason = F.when(~F.coalesce(last.isin("user", "tool"), F.lit(False)), "does not end with user or tool input").when(F.size(users) == 0, "no user message")
    return (
        d.withColumn("selection_priority", F.sha2(F.concat_ws("\x1f", F.lit("selection"), F.lit(str(seed)), "condition_id"), 256))
        .withColumn("modality", modality(media_types(F.coalesce("media_json", F.lit("[]")))))
        .withColumn("language", T.language_code(F.col("language")))
        .withColumn("task", T.task_label(last_user, fallback))
        .withColumn("reference_json", F.when(F.coalesce("reference", F.lit("")) != "", F.to_json(F.struct(F.col("reference").alias("assistant")))).otherwise("{}"))
        .withColumn("total_characters", F.aggregate("messages", F.lit(0), lambda a, m: a + F.length(m["content"])))
        .withColumn("split", F.lit(split))
        .withColumn("violation", reason)
    )


def with_media(messages: Column, media: Column) -> Column:
    """Media parts in front of the text of the last user message; array<struct<role, parts>>."""
    part = "array<struct<type:string,value:string>>"
    at = F.array_max(F.transform(messages, lambda m, i: F.when(m["role"] == "user", i).otherwise(-1)))
    text = lambda m: F.array(F.struct(F.lit("text").alias("type"), m["content"].alias("value"))).cast(part)
    parts = F.transform(media, lambda x: F.struct(F.lower(x["type"]).alias("type"), x["path"].alias("value"))).cast(part)
    return F.transform(messages, lambda m, i: F.struct(m["role"].alias("role"), F.when(i == at, F.concat(parts, text(m))).otherwise(text(m)).alias("parts")))


def inventory(df: DataFrame, id_col: str, media_json: str) -> DataFrame:
    """Media files of all rows; remote ones are marked."""
    m = df.select(id_col, F.explode(F.from_json(media_json, _MEDIA)).alias("m"))
    return m.select(id_col, "m.type", "m.path", F.regexp_like("m.path", F.lit("^[a-z][a-z0-9+.-]*://")).alias("remote"))


def token_ids(*places: Column) -> Column:
    """The first place that holds a list of token ids; null if none does."""
    return F.coalesce(*[F.when(F.forall(p, lambda x: x.isNotNull()), p) for p in places])


def completion(prompt_ids: Column, response_ids: Column, text: Column, reason: Column, eos: int) -> list[Column]:
    """finish_reason, token counts and the violation of one completion."""
    end = F.get(response_ids, F.size(response_ids) - 1)
    bad = F.when(F.coalesce(F.size(prompt_ids), F.lit(0)) < 1, "empty prompt").when((F.coalesce(F.size(response_ids), F.lit(0)) < 1) | (T.strip(F.coalesce(text, F.lit(""))) == ""), "empty completion")
    return [F.when(end == eos, "eos").otherwise(F.coalesce(reason, F.lit("unknown"))).alias("finish_reason"), F.size(prompt_ids).alias("prompt_tokens"), F.size(response_ids).alias("response_tokens"), bad.alias("violation")]


def sequences(prompt_ids: Column, response_ids: Column, limit: int) -> list[Column]:
    """input_ids, its response mask and the violation of a training sequence."""
    ids = F.concat(prompt_ids, response_ids)
    bad = F.when((F.size(prompt_ids) < 1) | (F.size(response_ids) < 1), "empty").when(F.size(ids) > limit, "too long")
    mask = F.concat(F.array_repeat(F.lit(0), F.size(prompt_ids)), F.array_repeat(F.lit(1), F.size(response_ids)))
    return [ids.alias("input_ids"), mask.alias("loss_mask"), bad.alias("violation")]


def components_used(kinds: DataFrame, kind: str) -> DataFrame:
    """One row: which encoders the observed kinds run."""
    seen = lambda *ks: F.coalesce(F.bool_or(F.col(kind).isin(*ks)), F.lit(False))
    return kinds.agg(seen("image", "multi_image", "video", "other").alias("vision"), seen("audio", "video", "other").alias("audio"), (F.count("*") > 0).alias("any"))


def split_array(text: Column) -> Column:
    """struct<array_json, rest>: the first JSON array in a text and the text without it."""

    @F.pandas_udf(StructType().add("array_json", StringType()).add("rest", StringType()))
    def cut(s: pd.Series) -> pd.DataFrame:
        out = []
        for x in s:
            x = x or ""
            at = x.find("[")
            try:
                value, end = json.JSONDecoder().raw_decode(x[at:]) if at >= 0 else (None, 0)
            except json.JSONDecodeError:
                value = None
            out.append((H.canonical_json(value), x[:at] + " " + x[at + end :]) if isinstance(value, list) else (None, x))
        return pd.DataFrame(out, columns=["array_json", "rest"])

    return cut(text)


def tool_arguments(raw: Column) -> Column:
    """Tool arguments as a JSON object: other values are kept under raw_arguments, nothing becomes {}."""
    body = T.strip(F.coalesce(raw, F.lit("")))
    is_object = F.regexp_like(body, F.lit(r"(?s)^\{.*\}$")) & F.try_parse_json(body).isNotNull()
    other = F.concat(F.lit('{"raw_arguments":'), F.coalesce(F.when(F.try_parse_json(body).isNotNull(), body), F.to_json(F.struct(body.alias("x"))).substr(F.lit(6), F.length(F.to_json(F.struct(body.alias("x")))) - 6)), F.lit("}"))
    return F.when(body.isin("", "null"), "{}").when(is_object, body).otherwise(other)


def cleaned_messages(raw: Column) -> Column:
    """array<struct<role, content, tool_call_id, tool_calls>> of a JSON list of messages, objects or texts of them.

    Messages that are no objects or have an unknown role are left out one by
    one; calls have id, type, name and arguments (JSON), in the flat or the
    nested form; unknown keys are not kept.
    """
    def call(x):
        c = F.from_json(x, "id string, type string, name string, arguments string, function string")
        f = F.from_json(c["function"], "name string, arguments string")
        nested = F.coalesce(F.startswith(F.ltrim(c["function"]), F.lit("{")), F.lit(False))
        pick = lambda k: F.when(nested, f[k]).otherwise(c[k])
        return F.struct(c["id"].alias("id"), F.coalesce(F.nullif(c["type"], F.lit("")), F.lit("function")).alias("type"), F.coalesce(pick("name"), F.lit("")).alias("name"), tool_arguments(pick("arguments")).alias("arguments"))

    def message(x):
        m = F.from_json(x, "role string, content string, tool_call_id string, tool_calls string")
        return F.struct(T.strip(F.coalesce(m["role"], F.lit(""))).alias("role"), m["content"].alias("content"), m["tool_call_id"].alias("tool_call_id"), F.transform(M.json_objects(m["tool_calls"]), call).alias("tool_calls"))

    return F.filter(F.transform(M.json_objects(raw), message), lambda m: m["role"].isin(*M.ROLES))


def json_keys(raw: Column) -> Column:
    """The distinct keys of a JSON text at all depths: strings, read one after the other, that a colon follows.

    The pattern gives nothing back, so strings of any length are read without deep recursion.
    """
    tokens = F.regexp_extract_all(F.when(F.try_parse_json(raw).isNotNull(), raw), F.lit(r'"[^"\\]*+(?:\\.[^"\\]*+)*+"(?:\s*+:)?'), F.lit(0))
    keys = F.filter(tokens, lambda t: F.endswith(t, F.lit(":")))
    return F.coalesce(F.array_distinct(F.transform(keys, lambda t: F.regexp_replace(t, r'^"|"\s*:$', ""))), F.array().cast("array<string>"))


def forbidden_keys(raw: Column, names: tuple[str, ...]) -> Column:
    """Keys of a JSON text, at any depth, that must not be there."""
    return F.array_intersect(json_keys(raw), F.array(*[F.lit(n) for n in names]))


# Limits of a search result's and a request's fields.
TITLE, LINK, SNIPPET, SOURCE, QUERY = 500, 2000, 900, 300, 500


def search_results(items: Column, top_k: int) -> Column:
    """Ranks by place, fields cut, web links only, then the first top_k."""
    cutted = lambda c, n: F.left(F.coalesce(c, F.lit("")), F.lit(n))
    ranked = F.transform(items, lambda x, i: F.struct((i + 1).alias("rank"), cutted(x["title"], TITLE).alias("title"), cutted(x["link"], LINK).alias("link"), cutted(x["snippet"], SNIPPET).alias("snippet"), cutted(x["source"], SOURCE).alias("source")))
    return F.slice(F.filter(ranked, lambda x: F.startswith(x["link"], F.lit("http://")) | F.startswith(x["link"], F.lit("https://"))), 1, top_k)


def search_request(query: Column, top_k: Column, locale: Column) -> Column:
    """The first rule that a search request breaks, or null."""
    q = T.strip(F.coalesce(query, F.lit("")))
    return F.when(q == "", "empty query").when(F.length(q) > QUERY, "long query").when(~top_k.between(1, 10), "top_k").when(~F.regexp_like(locale, F.lit(r"\A[A-Za-z]{2}\z")), "locale")


def page_url(url: Column) -> Column:
    """A URL with its scheme; null for credentials, fragments, control characters, other schemes or no host."""
    u = T.strip(F.coalesce(url, F.lit("")))
    full = F.when(F.regexp_like(u, F.lit("^https?://")), u).otherwise(F.concat(F.lit("https://"), u))
    host = F.regexp_extract(full, r"^https?://([^/?#]*)", 1)
    bad = (u == "") | (F.length(u) > LINK) | F.regexp_like(u, F.lit(r"[\x00-\x1F\x7F]")) | (host == "") | F.contains(host, F.lit("@")) | F.regexp_like(full, F.lit("#."))
    return F.when(~bad, full)


def browser_request(url: Column, timeout: Column, max_length: Column) -> Column:
    """The first rule that a page request breaks, or null; limits that are not given are fine."""
    return F.when(page_url(url).isNull(), "url").when(~timeout.between(1, 60) | F.isnan(timeout), "timeout").when(~max_length.between(1, 32000), "max_length")


def in_order(types: Column) -> Column:
    """The media types of native content parts in order, lower case; other types left out."""
    return F.filter(F.transform(types, lambda t: F.lower(t)), lambda t: t.isin(*MEDIA))


def resolved(path: Column, base: str) -> Column:
    """A path below base without "." and ".." (which stop at the root); absolute paths and addresses stay as they are."""
    whole = F.concat(F.lit(base.rstrip("/") + "/"), path)
    step = lambda done, x: F.when(x == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(x)))
    parts = F.aggregate(F.filter(F.split(whole, "/", -1), lambda x: ~x.isin("", ".")), F.array().cast("array<string>"), step)
    given = F.regexp_like(path, F.lit(r"^(?:https?://|file://|data:|/)"))
    return F.when(given, path).otherwise(F.concat(F.lit("/" if base.startswith("/") else ""), F.array_join(parts, "/")))


def native_media(messages: Column, base: str) -> Column:
    """struct<messages, modalities> of array<struct<role, parts: array<struct<type, value>>>>: media paths made
    absolute below base (web, file and data addresses stay), and the media types in order."""
    def part(x):
        media = F.lower(x["type"]).isin(*MEDIA)
        return F.struct(x["type"].alias("type"), F.when(media, resolved(x["value"], base)).otherwise(x["value"]).alias("value"))

    whole = F.transform(messages, lambda m: F.struct(m["role"].alias("role"), F.transform(m["parts"], part).alias("parts")))
    return F.struct(whole.alias("messages"), F.flatten(F.transform(messages, lambda m: in_order(F.transform(m["parts"], lambda x: x["type"])))).alias("modalities"))


def media_inventory(df: DataFrame, files: DataFrame, id_col: str = "condition_id", media_json: str = "media_json", messages_json: str = "messages_json") -> DataFrame:
    """id, type, size and sha256 of each media item of two JSON columns: those of the media list, and those in
    the content lists of the messages; data addresses are measured themselves, the others by files (path,
    content). violation tells of web addresses and missing files."""
    listed = df.select(id_col, F.explode(F.from_json(media_json, "array<struct<type:string,path:string>>")).alias("m")).select(id_col, "m.type", F.col("m.path").alias("path"))
    parts = df.select(id_col, F.explode(F.from_json(messages_json, "array<struct<content:array<map<string,string>>>>")).alias("m")).select(id_col, F.explode("m.content").alias("p"))
    inline = parts.select(id_col, F.try_element_at("p", F.lit("type")).alias("type"), F.try_element_at("p", F.try_element_at("p", F.lit("type"))).alias("path")).where(F.col("type").isin(*MEDIA))
    every = listed.unionByName(inline).withColumn("path", F.regexp_replace(F.coalesce("path", F.lit("")), "^file://", ""))
    measured = files.select("path", F.octet_length("content").cast("long").alias("_size"), F.sha2("content", 256).alias("_sha"))
    d = every.join(measured, "path", "left")
    own = F.startswith("path", F.lit("data:"))
    reason = F.when(F.regexp_like("path", F.lit("^https?://")), "remote").when(~own & F.col("_size").isNull(), "missing")
    return d.select(id_col, "type", F.when(own, F.octet_length("path").cast("long")).otherwise(F.col("_size")).alias("size"), F.when(own, F.sha2("path", 256)).otherwise(F.col("_sha")).alias("sha256"), reason.alias("violation"))


def prompt_only(messages: Column) -> Column:
    """The messages without the last one, which has to be the assistant's; else null."""
    last = F.get(messages, F.size(messages) - 1)
    return F.when(last["role"] == "assistant", F.slice(messages, 1, F.size(messages) - 1))


def components(kinds: DataFrame, kind: str) -> DataFrame:
    """component, loaded and executed: an encoder runs if one of its kinds was seen, the core with any."""
    # The kinds that run each encoder, and what is never loaded.
    runs = (("audio_encoder", ("audio", "video", "other")), ("vision_encoder", ("image", "multi_image", "video", "other")))
    any_of = lambda ks: F.coalesce(F.bool_or(F.col(kind).isin(*ks)), F.lit(False))
    rows = [F.struct(F.lit(n).alias("component"), F.lit(True).alias("loaded"), any_of(ks).alias("executed")) for n, ks in runs]
    rows.append(F.struct(F.lit("thinker").alias("component"), F.lit(True).alias("loaded"), (F.count(kind) > 0).alias("executed")))
    rows += [F.struct(F.lit(n).alias("component"), F.lit(False).alias("loaded"), F.lit(False).alias("executed")) for n in ("talker", "mtp", "code2wav")]
    return kinds.agg(F.array(*rows).alias("r")).select(F.explode("r").alias("r")).select("r.*")
