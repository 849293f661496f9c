"""URL filter by path-template trees.

Lists decide first: of the rules that fit a URL the longest wins. The other
URLs are judged by templates. Per host the paths form a tree; a segment with
too many values becomes a wildcard, sibling branches whose labelled shares of
bad URLs do not differ significantly are merged, and a template is rejected
when its share of bad labels, smoothed towards its parent's, is high. The tree
goes as deep as a node has URLs of both labels.

Labels are any boolean column of the caller's, or what the lists say. The
query labels all pages: by the lists where they decide, else bad if the host
has a word of WORDS or the page's visible text is junk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: (rule, verdict): a host with its subdomains, then the start of the path.
RULES = (
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
)
#: Words between the dots and dashes of a host that label its pages bad.
WORDS = ("adult", "ads", "bets", "betting", "casino", "escort", "gambling", "pills", "poker", "porn", "spam", "viagra", "warez", "xxx")
#: Path levels that every host's tree has; deeper ones only while a node has both labels.
DEPTH = 4
#: More values than this below one node are a variable field.
CHILDREN = 24
#: So are FEW values or more if most of them occur once.
FEW = 6
#: Two branches differ if their shares are so many standard errors apart.
Z = 1.96
#: Weight of the parent's share, least labelled URLs and least smoothed share of a rejected template.
PRIOR, SUPPORT, PURITY = 10.0, 10, 0.9
BROADCAST_PATHS = 200_000
SYMBOLS = "#*$%&|<>"
_CLASSES = ((r"^[0-9]+$", "<n>"), (r"^[0-9]+(\.[A-Za-z0-9]{1,5})$", "<n>$1"), (r"^(?=.*[0-9])[0-9a-fA-F-]{8,}$", "<hex>"), (r"^(?=.*[0-9])[A-Za-z0-9_-]{16,}$", "<id>"))
#: What is taken out of a page, in order, and what stands in for it.
_MARKUP = ((r"(?is)<(?:script|style)\b.*?</(?:script|style)\s*>", " "), (r"(?s)<!--.*?-->", " "), (r"(?s)<[^>]*>", " "), (r"&(?:amp|lt|gt);", "&"), (r"&#?[A-Za-z0-9]+;", "x"))


def host_of(url: Column) -> Column:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), upper, lower)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def listed(host: Column, path: Column, rules=RULES) -> Column:
    """struct<rule, verdict> of the longest rule that fits, or null; ties go by the rule's text."""
    out = None
    for rule, verdict in sorted(rules, key=lambda r: (-len(r[0]), r)):
        h, _, p = rule.partition("/")
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(f"/{p}"))
        value = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out if out is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def bad_page(url: Column, html: Column, words=WORDS) -> Column:
    """True for a host with one of the words, or a visible text that is junk: fewer than
    10 words, or more than half as many symbols as words. Null without a page."""
    text = html
    for pattern, other in _MARKUP:
        text = F.regexp_replace(text, pattern, other)
    flat = F.trim(F.translate(text, "\t\n\x0b\x0c\r", "     "))
    n_words = F.when(flat == "", 0).otherwise(F.size(F.split(flat, " +", -1)))
    n_symbols = F.length(text) - F.length(F.translate(text, SYMBOLS, ""))
    named = F.arrays_overlap(F.split(host_of(url), "[.-]", -1), F.array(*[F.lit(w) for w in words])) if words else F.lit(False)
    return F.coalesce(named, F.lit(False)) | (n_words < 10) | (2 * n_symbols > n_words)


def segments(path: Column) -> Column:
    """Non-empty path segments, numbers and ids by their class."""
    def general(s: Column) -> Column:
        for pattern, name in _CLASSES:
            s = F.regexp_replace(s, pattern, name)
        return s

    return F.transform(F.filter(F.split(path, "/", -1), lambda s: s != ""), general)


def _smoothed(bad: str, lab: Column, share: str) -> Column:
    return (F.col(bad) + PRIOR * F.col(share)) / (lab + PRIOR)


def _level(t: DataFrame, d: int, scratch: common.Scratch) -> DataFrame:
    """The open paths one level deeper.

    t: host, segs, at (the node's key), node (its name), share and up (its and
    its parent's smoothed shares), lab_at and bad_at (its labels), good, bad, n.
    A node's children are one row of at most CHILDREN entries, and the rows of
    hot nodes are joined where they lie.
    """
    lab = F.col("good") + F.col("bad")
    kids = t.groupBy("at", F.get("segs", F.lit(d)).alias("seg")).agg(*[F.sum(c).alias(c) for c in ("n", "good", "bad")], F.count("*").alias("rows"), *[F.first(c).alias(c) for c in ("host", "node", "share")])
    kids = scratch.written(kids, f"kids{d}")
    stats = kids.groupBy("at").agg(F.count("*").alias("kids"), F.sum((F.col("n") == 1).cast("long")).alias("once"), *[F.sum(c).alias(c) for c in ("good", "bad", "rows")], *[F.first(c).alias(c) for c in ("node", "share")])
    wild = (F.col("kids") > CHILDREN) | ((F.col("kids") >= FEW) & (2 * F.col("once") > F.col("kids")))
    stats = scratch.written(stats.withColumn("wild", wild), f"stats{d}")
    n_kids, n_rows = stats.agg(F.sum("kids"), F.sum("rows")).first()
    narrow = common.join_counted(kids, stats.select("at", "kids", "wild"), "at", "kids", n_kids).where("not wild")
    branch = narrow.select("at", "node", "share", F.col("seg").alias("label"), "good", "bad").unionByName(stats.where("wild").select("at", "node", "share", F.lit("*").alias("label"), "good", "bad"))
    # neighbours in order of their share; at most CHILDREN of them below a node
    branch = branch.withColumn("lab", lab).withColumn("own", F.when(F.col("lab") > 0, F.col("bad") / F.col("lab")))
    order = Window.partitionBy("at").orderBy(F.col("own").asc_nulls_last(), "label")
    before = lambda c: F.lag(c).over(order)
    both = (before("bad") + F.col("bad")) / (before("lab") + F.col("lab"))
    error = F.sqrt(both * (1 - both) * (1 / before("lab") + 1 / F.col("lab")))
    differs = F.col("own").isNull() | before("own").isNull() | (F.abs(F.col("own") - before("own")) > Z * error)
    branch = branch.withColumn("group", F.sum(differs.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    merged = branch.groupBy("at", "group").agg(F.sort_array(F.collect_list("label")).alias("labels"), F.sum("lab").alias("lab"), F.sum("bad").alias("bad"), F.first("node").alias("node"), F.first("share").alias("share"))
    name = F.when(F.size("labels") > 1, F.concat(F.lit("("), F.array_join("labels", "|"), F.lit(")"))).otherwise(F.get("labels", F.lit(0)))
    to = F.struct(F.concat("node", F.lit("/"), name).alias("node"), _smoothed("bad", F.col("lab"), "share").alias("share"), F.col("lab").alias("lab_at"), F.col("bad").alias("bad_at"))
    nodes = merged.select("at", "labels", to.alias("to")).select("at", "to", F.explode("labels").alias("label")).groupBy("at").agg(F.map_from_entries(F.collect_list(F.struct("label", "to"))).alias("to"))
    nodes = scratch.written(nodes.join(stats.select("at", "rows"), "at"), f"nodes{d}")
    step = common.join_counted(t, nodes, "at", "rows", n_rows)
    step = step.withColumn("to", F.coalesce(F.try_element_at("to", F.get("segs", F.lit(d))), F.try_element_at("to", F.lit("*"))))
    return step.select("host", "segs", F.xxhash64("host", "to.node").alias("at"), "to.node", "to.share", F.col("share").alias("up"), "to.lab_at", "to.bad_at", "good", "bad", "n")


def templates(paths: DataFrame, depth: int = DEPTH) -> DataFrame:
    """host, segs, template, purity and rejected of each path.

    paths: host, segs and the numbers of URLs n, good and bad of each; one row
    for each distinct path, so a host with a third of all URLs is no larger
    here than its tree. Segments below the last level of a path are "**".
    """
    scratch = common.Scratch(paths.sparkSession)
    lab = F.col("good") + F.col("bad")
    paths = scratch.written(paths, "paths")
    host = scratch.written(paths.groupBy("host").agg(F.sum("good").alias("h_good"), F.sum("bad").alias("h_bad"), F.count("*").alias("h_rows"), F.max(F.size("segs")).alias("h_depth")), "hosts")
    prior, total, deepest = host.agg(F.coalesce(F.sum("h_bad") / F.nullif(F.sum("h_bad") + F.sum("h_good"), F.lit(0)), F.lit(0.5)), F.coalesce(F.sum("h_rows"), F.lit(0)), F.coalesce(F.max("h_depth"), F.lit(0))).first()
    t = common.join_counted(paths, host.withColumn("up", F.lit(prior)), "host", "h_rows", total)
    h_lab = F.col("h_good") + F.col("h_bad")
    t = t.select("host", "segs", F.xxhash64("host", F.lit("")).alias("at"), F.lit("").alias("node"), _smoothed("h_bad", h_lab, "up").alias("share"), "up", h_lab.alias("lab_at"), F.col("h_bad").alias("bad_at"), "good", "bad", "n")
    d, done = 0, None
    mixed = (F.col("lab_at") >= SUPPORT) & (F.col("bad_at") > 0) & (F.col("bad_at") < F.col("lab_at"))
    while True:
        t = scratch.written(t, f"level{d}")
        goes_on = (F.size("segs") > d) & (F.lit(d < depth) | mixed)
        ends = t.where(~goes_on).withColumn("template", F.when(F.size("segs") > d, F.concat("node", F.lit("/**"))).otherwise(F.col("node")))
        done = ends if done is None else done.unionByName(ends)
        t = t.where(goes_on)
        if d >= deepest or (d >= depth and not t.limit(1).count()):
            break
        t = _level(t, d, scratch)
        d += 1
    done = done.withColumn("leaf", F.xxhash64("host", "template"))
    leaf = done.groupBy("leaf").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"), F.first("up").alias("up"), F.count("*").alias("rows"))
    leaf = leaf.withColumn("purity", _smoothed("bad", lab, "up"))
    leaf = leaf.select("leaf", "purity", ((lab >= SUPPORT) & (F.col("purity") >= PURITY)).alias("rejected"), "rows")
    leaf = scratch.written(leaf, "leaves")
    return common.join_counted(done.select("host", "segs", "template", "leaf", "n"), leaf, "leaf", "rows", total).select("host", "segs", "template", "purity", "rejected", "n")


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, bad: Column | None = None, depth: int = DEPTH) -> DataFrame:
    """page_id, host, path, rule, verdict, template and purity of each row of pages.

    bad: a boolean column of pages that labels the URLs which no rule decides
    (null: unlabelled); the others are labelled by their rule. The rule's
    verdict stands where a rule fits, else block if the template is rejected,
    else allow.

    A null URL or one without "://" has an empty host and path: no rule fits,
    and its template is the empty one of the empty host. A very long URL is
    judged whole. Repeated rows are judged each and count each; null ids are
    kept. An empty table gives no rows. Other columns are not read, whatever
    their names.
    """
    url = F.col(f"`{url_col}`").cast("string")
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"), (bad if bad is not None else F.lit(None)).cast("boolean").alias("bad"))
    rows = rows.withColumn("hit", listed(F.col("host"), F.col("path"), rules)).withColumn("segs", segments(F.col("path")))
    label = F.coalesce(F.col("hit.verdict") == "block", "bad")
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0)).alias
    paths = rows.groupBy("host", "segs").agg(F.count("*").alias("n"), count(~label)("good"), count(label)("bad"))
    known = common.written(templates(paths, depth).withColumn("key", F.struct("host", "segs")).drop("host", "segs"), "templates")
    n, total = known.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    rows = rows.select("page_id", "host", "path", "hit", F.struct("host", "segs").alias("key"))
    out = rows.join(F.broadcast(known), "key", "left") if n <= BROADCAST_PATHS else common.join_counted(rows, known, "key", "n", total)
    verdict = F.coalesce("hit.verdict", F.when(F.col("rejected"), "block").otherwise("allow"))
    return out.select("page_id", "host", "path", F.col("hit.rule").alias("rule"), verdict.alias("verdict"), "template", "purity")


def op10_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(common.table(spark, sf_dir, "pages"), bad=bad_page(F.col("url"), F.col("html")))


QUERIES = {"op10_url_templates": op10_url_templates}
#: Levels that the SQL states; deeper paths with both labels at the last one are beyond it.
SQL_LEVELS = 6


def _sql() -> str:
    """The query in SQL: the lists as a CASE, the labels, then one block of steps for each level of the tree."""
    rules = sorted(RULES, key=lambda r: (-len(r[0]), r))
    fits = lambda r: "(host = '{0}' OR ends_with(host, '.{0}')) AND starts_with(path, '/{1}')".format(*r.split("/", 1))
    rule = " ".join(f"WHEN {fits(r)} THEN '{r}'" for r, _ in rules)
    verdict = " ".join(f"WHEN '{r}' THEN '{v}'" for r, v in rules)
    general = (
        r"lambda s: CASE WHEN regexp_full_match(s, '[0-9]+') THEN '<n>' WHEN regexp_full_match(s, '[0-9]+\.[A-Za-z0-9]{1,5}') THEN '<n>' || regexp_extract(s, '\..*$')"
        r" WHEN regexp_full_match(s, '[0-9a-fA-F-]{8,}') AND regexp_matches(s, '[0-9]') THEN '<hex>' WHEN regexp_full_match(s, '[A-Za-z0-9_-]{16,}') AND regexp_matches(s, '[0-9]') THEN '<id>' ELSE s END"
    )
    text = "html"
    for pattern, other in _MARKUP:
        text = f"regexp_replace({text}, '{pattern}', '{other}', 'g')"
    words = ", ".join(f"'{w}'" for w in WORDS)
    smooth = lambda bad, lab, share: f"({bad} + {PRIOR}::DOUBLE * {share}) / ({lab} + {PRIOR}::DOUBLE)"
    out = rf"""WITH u AS (SELECT page_id, {text} AS t, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r AS (SELECT *, CASE {rule} END AS rule, list_transform(list_filter(string_split(path, '/'), lambda s: s <> ''), {general}) AS segs,
  list_has_any(string_split_regex(host, '[.-]'), [{words}]) OR len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) < 10 OR 2 * (length(t) - length(regexp_replace(t, '[{SYMBOLS}]', '', 'g'))) > len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS page_bad FROM u),
p AS MATERIALIZED (SELECT page_id, host, path, segs, rule, CASE rule {verdict} END AS listed, coalesce(CASE rule {verdict} END = 'block', page_bad) AS label FROM r),
q AS (SELECT host, segs, count(*) AS n, count(*) FILTER (NOT label) AS good, count(*) FILTER (label) AS bad FROM p GROUP BY host, segs),
prior AS (SELECT coalesce(sum(bad)::DOUBLE / nullif(sum(bad + good), 0), 0.5) AS up FROM q),
t0 AS MATERIALIZED (SELECT host, segs, '' AS node, {smooth("sum(bad) OVER w", "sum(good + bad) OVER w", "up")} AS share, up, sum(good + bad) OVER w AS lab_at, sum(bad) OVER w AS bad_at, good, bad, n FROM q, prior WINDOW w AS (PARTITION BY host)),
"""
    mixed = f"(lab_at >= {SUPPORT} AND bad_at > 0 AND bad_at < lab_at)"
    ends = []
    for d in range(SQL_LEVELS + 1):
        more = f"len(segs) > {d}" if d < DEPTH else f"(len(segs) > {d} AND {mixed})" if d < SQL_LEVELS else "false"
        ends.append(f"SELECT host, segs, CASE WHEN len(segs) > {d} THEN node || '/**' ELSE node END AS template, up, good, bad FROM t{d} WHERE NOT ({more})")
        if d == SQL_LEVELS:
            break
        w = "(PARTITION BY host, node ORDER BY own ASC NULLS LAST, label)"
        out += f"""o{d} AS (SELECT *, segs[{d + 1}] AS seg FROM t{d} WHERE {more}),
kid{d} AS (SELECT host, node, seg, any_value(share) AS share, sum(n) AS n, sum(good) AS good, sum(bad) AS bad FROM o{d} GROUP BY host, node, seg),
wide{d} AS (SELECT host, node, count(*) > {CHILDREN} OR (count(*) >= {FEW} AND 2 * count(*) FILTER (n = 1) > count(*)) AS wild FROM kid{d} GROUP BY host, node),
lab{d} AS (SELECT k.*, CASE WHEN wild THEN '*' ELSE seg END AS label FROM kid{d} k JOIN wide{d} USING (host, node)),
br{d} AS (SELECT host, node, label, any_value(share) AS share, sum(bad) AS bad, sum(good + bad) AS lab, CASE WHEN sum(good + bad) > 0 THEN sum(bad) / sum(good + bad) END AS own FROM lab{d} GROUP BY host, node, label),
nb{d} AS (SELECT *, lag(bad) OVER w AS b0, lag(lab) OVER w AS l0, lag(own) OVER w AS s0 FROM br{d} WINDOW w AS {w}),
df{d} AS (SELECT *, CASE WHEN own IS NULL OR s0 IS NULL OR abs(own - s0) > {Z} * sqrt(((b0 + bad) / (l0 + lab)) * (1 - (b0 + bad) / (l0 + lab)) * (1 / l0 + 1 / lab)) THEN 1 ELSE 0 END AS new FROM nb{d}),
gr{d} AS (SELECT *, sum(new) OVER {w} AS g FROM df{d}),
mg{d} AS (SELECT host, node, list(label ORDER BY label) AS labels, {smooth("sum(bad)", "sum(lab)", "any_value(share)")} AS share, sum(lab) AS lab_at, sum(bad) AS bad_at FROM gr{d} GROUP BY host, node, g),
nx{d} AS (SELECT host, node, node || '/' || CASE WHEN len(labels) > 1 THEN '(' || array_to_string(labels, '|') || ')' ELSE labels[1] END AS next, share, lab_at, bad_at, unnest(labels) AS label FROM mg{d}),
st{d} AS (SELECT host, node, seg, next, nx.share, lab_at, bad_at FROM lab{d} JOIN nx{d} nx USING (host, node, label)),
t{d + 1} AS MATERIALIZED (SELECT t.host, segs, next AS node, s.share, t.share AS up, s.lab_at, s.bad_at, good, bad, n FROM o{d} t JOIN st{d} s ON s.host = t.host AND s.node = t.node AND s.seg = t.seg),
"""
    return out + f"""done AS MATERIALIZED ({' UNION ALL '.join(ends)}),
leaf AS (SELECT host, template, sum(good + bad) AS lab, {smooth("sum(bad)", "sum(good + bad)", "any_value(up)")} AS purity FROM done GROUP BY host, template),
known AS (SELECT host, segs, template, purity, lab >= {SUPPORT} AND purity >= {PURITY} AS rejected FROM done JOIN leaf USING (host, template))
SELECT page_id, p.host, path, rule, coalesce(listed, CASE WHEN rejected THEN 'block' ELSE 'allow' END) AS verdict, template, purity::DOUBLE AS purity
FROM p LEFT JOIN known k ON k.host = p.host AND k.segs = p.segs"""


ORACLE = {"op10_url_templates": _sql()}
