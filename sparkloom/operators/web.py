"""Requests to web tools in canonical form, listings of search results, and result records, all from JSON text as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as T
from .conditions import LINK, QUERY, SNIPPET, SOURCE, TITLE, page_url

# Limits of seconds, of results and of a page's characters.
SECONDS, RESULTS, CHARACTERS = (1, 60), (1, 10), (1, 32000)


def _field(raw: Column, name: str) -> tuple[Column, Column]:
    """A field of a JSON object as text, and its kind: null where it is not given or null."""
    kind = F.schema_of_variant(F.variant_get(F.try_parse_json(raw), f"$.{name}", "variant"))
    return F.get_json_object(raw, f"$.{name}"), F.nullif(kind, F.lit("VOID"))


def _text(raw: Column, name: str) -> Column:
    value, kind = _field(raw, name)
    return F.when(kind == "STRING", T.strip(value))


def _whole(raw: Column, name: str, limits) -> tuple[Column, Column]:
    """The number, and whether it is given and no whole number within the limits."""
    value, kind = _field(raw, name)
    number = F.when(F.regexp_like(kind, F.lit("^(?:TINYINT|SMALLINT|INT|BIGINT)$")) | F.regexp_like(value, F.lit(r"\A-?\d{1,18}\z")) & (kind != "STRING"), value.try_cast("long"))
    return number, kind.isNotNull() & ~F.coalesce(number.between(*limits), F.lit(False))


def _seconds(raw: Column) -> tuple[Column, Column]:
    value, kind = _field(raw, "timeout")
    number = F.when(~kind.isin("STRING", "BOOLEAN") & ~F.startswith(kind, F.lit("ARRAY")) & ~F.startswith(kind, F.lit("OBJECT")), value.try_cast("double"))
    return number, kind.isNotNull() & ~F.coalesce(number.between(*SECONDS) & ~F.isnan(number), F.lit(False))


def _unknown(raw: Column, known: list[str]) -> Column:
    return F.array_sort(F.array_except(F.coalesce(F.json_object_keys(raw), F.array().cast("array<string>")), F.array(*[F.lit(k) for k in known])))


def _request(raw: Column, known: list[str], rules: list[tuple[Column, str | Column]], fields: list[Column]) -> Column:
    """struct<arguments, violation>: JSON of the fields, sorted by name, those not given left out; or the first rule that is broken."""
    extra = _unknown(raw, known)
    bad = F.when(F.json_object_keys(raw).isNull(), F.lit("no object")).when(F.size(extra) > 0, F.concat(F.lit("unknown arguments: "), F.array_join(extra, ", ")))
    for broken, what in rules:
        bad = bad.when(broken, what)
    return F.struct(F.when(bad.isNull(), F.to_json(F.struct(*fields))).alias("arguments"), bad.alias("violation"))


def search_arguments(raw: Column) -> Column:
    """A search request: query, and top_k, timeout, gl and hl if given; locales in lower case, seconds as a fraction."""
    query = _text(raw, "query")
    top, no_top = _whole(raw, "top_k", RESULTS)
    wait, no_wait = _seconds(raw)
    locale = {n: _field(raw, n) for n in ("gl", "hl")}
    other = lambda n: locale[n][1].isNotNull() & ~((locale[n][1] == "STRING") & F.regexp_like(locale[n][0], F.lit(r"\A[A-Za-z]{2}\z")))
    rules = [(F.coalesce(query, F.lit("")) == "", "query"), (F.length(query) > QUERY, "long query"), (no_top, "top_k"), (no_wait, "timeout"), (other("gl"), "gl"), (other("hl"), "hl")]
    fields = [F.lower(locale["gl"][0]).alias("gl"), F.lower(locale["hl"][0]).alias("hl"), query.alias("query"), wait.alias("timeout"), top.alias("top_k")]
    return _request(raw, ["query", "top_k", "timeout", "gl", "hl"], rules, fields)


def page_arguments(raw: Column) -> Column:
    """A page request: url with its scheme, and timeout and max_length if given."""
    url = page_url(_text(raw, "url"))
    wait, no_wait = _seconds(raw)
    most, no_most = _whole(raw, "max_length", CHARACTERS)
    rules = [(url.isNull(), "url"), (no_wait, "timeout"), (no_most, "max_length")]
    return _request(raw, ["url", "timeout", "max_length"], rules, [most.alias("max_length"), wait.alias("timeout"), url.alias("url")])


# The fields of the two forms of listings.
_RANKED = "position string, title string, link string, snippet string, source string, displayedLink string"
_ENGINES = "title string, url string, content string, engine string, engines array<string>"


def listing(raw: Column, top_k: int, engines: bool = False) -> Column:
    """array<struct<rank, type, title, link, snippet, source>> of a provider's JSON; web links only, the first top_k.

    The first form has a list "organic" (or, where that is empty, "news"):
    the rank is the position given, else the place. The other form (engines)
    has "results", ranked by place; its source is the engine, else all
    engines. Elements that are no objects keep their place and are left out.
    """
    lists = F.from_json(raw, "organic array<string>, news array<string>, results array<string>")
    items = F.coalesce(lists["results"] if engines else F.coalesce(F.when(F.size(lists["organic"]) > 0, lists["organic"]), lists["news"]), F.array().cast("array<string>"))
    cut = lambda c, n: F.left(F.coalesce(c, F.lit("")), F.lit(n))

    def one(x: Column, i: Column) -> Column:
        item = F.from_json(F.when(F.regexp_like(x, F.lit(r"^\s*\{")), x), _ENGINES if engines else _RANKED)
        place = (i + 1).cast("long")
        given = F.nullif(item["position"].try_cast("long"), F.lit(0)) if not engines else F.lit(None)
        source = F.coalesce(F.nullif(item["engine"], F.lit("")), F.array_join(item["engines"], ",")) if engines else F.coalesce(F.nullif(item["source"], F.lit("")), item["displayedLink"])
        row = F.struct(
            F.coalesce(given, place).alias("rank"), F.lit("organic").alias("type"), cut(item["title"], TITLE).alias("title"), cut(item["url" if engines else "link"], LINK).alias("link"),
            cut(item["content" if engines else "snippet"], SNIPPET).alias("snippet"), cut(source, SOURCE).alias("source"),
        )
        return F.when(item.isNotNull(), row)

    return F.slice(F.filter(F.transform(items, one), lambda r: F.regexp_like(r["link"], F.lit("^https?://"))), 1, top_k)


def command(name: Column, arguments: Column) -> Column:
    """The tool's name and its canonical arguments."""
    return F.concat(name, F.lit(" "), arguments)


def tool_result(command: Column, stdout: Column, stderr: Column, exit_code: Column, timed_out: Column, truncated: Column) -> Column:
    """The record of a tool's run: what ran, what it said, how it ended, and the lines that say something."""
    said = F.coalesce(stdout, F.lit(""))
    lines = F.filter(F.split(said, "\r\n|[\n\x0b\x0c\r\x1c\x1d\x1e\x85  ]", -1), lambda x: T.strip(x) != "")
    return F.struct(
        command.alias("command"), said.alias("stdout"), F.coalesce(stderr, F.lit("")).alias("stderr"), F.coalesce(exit_code, F.lit(0)).alias("exit_code"),
        F.coalesce(timed_out, F.lit(False)).alias("timed_out"), F.coalesce(truncated, F.lit(False)).alias("truncated"), lines.alias("information_lines"),
    )
