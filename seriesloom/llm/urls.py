"""URL filters with redirect equivalence.

Rules (host, path) block or allow a host with all its subdomains below a path prefix; of
the rules that fit a url the longest wins. Decisions then spread over aliases: urls that
redirect to each other (meta refresh) or name each other as canonical link are joined by
edges, connected components of that graph are computed as Spark joins, and a page that no
rule fits takes the decision of its component: allow if the component holds an explicit
allow, else block if it holds an explicit block, else allow.

Defined cases: a null url, or one without ``://``, has an empty host and path, no rule,
no alias and the verdict allow; repeated urls are one node; null or empty html has no
edges; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected_components, table

RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
#: What a browser doesn't read as tags; tags of three kinds up to their ends, past quoted values; their attributes.
HIDDEN = r"(?is)<!--.*?(?:-->|\z)|<script[\s>/].*?(?:</script\s*>|\z)|<style[\s>/].*?(?:</style\s*>|\z)"
TAG = r"""(?i)<(?:link|meta|base)[\s/](?:[^>"']++|"[^"]*+"|'[^']*+')*+>"""
ATTRIBUTE = r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?"""
REFRESH = r"""(?i)\burl\s*=\s*["']?([^"']+)"""
#: Decoded in this order, ampersands last and once.
ENTITIES = (("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"))
AMPERSAND = "&(?:amp|#38);"
#: Ports that say no more than their scheme.
PORTS = (("http", ":(80)?$"), ("https", ":(443)?$"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def node_of(url: Column) -> Column:
    """Graph node of a url: scheme, lower-cased host without its scheme's own port, path (``/`` if empty) and query, without the fragment."""
    scheme, host = F.translate(F.regexp_extract(url, r"(?s)^(.*?)://", 1), UPPER, LOWER), host_of(url)
    for name, port in PORTS:
        host = F.when(scheme == name, F.regexp_replace(host, port, "")).otherwise(host)
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    return F.concat(scheme, F.lit("://"), host, F.when(rest.startswith("/"), "").otherwise("/"), rest)


def longest_rule(host: Column, path: Column, rules) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null.

    The rule list is configuration of a fixed, small size and becomes one CASE
    expression, tried from the longest rule on."""
    found = None
    for verdict, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        hit = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, hit) if found is None else found.when(fits, hit)
    return found


def _no_dots(path: Column) -> Column:
    """An absolute path without its ``.`` and ``..`` segments."""
    parts = F.split(F.substr(path, F.lit(2)), "/")
    up = lambda acc: F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
    step = lambda acc, x: F.when(x == "..", up(acc)).when(x == ".", acc).otherwise(F.concat(acc, F.array(x)))
    kept = F.aggregate(parts, F.array().cast("array<string>"), step)
    # a last segment of dots names a folder
    kept = F.when(F.element_at(parts, -1).isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    return F.concat(F.lit("/"), F.array_join(kept, "/"))


def resolved(to: Column, url: Column) -> Column:
    """The absolute url that ``to`` names on the page ``url``; null for schemes without ``://``."""
    scheme, origin = F.regexp_extract(url, r"(?s)^(.*?)://", 1), F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1)
    own = path_of(url)
    path, rest = F.regexp_extract(to, r"(?s)^([^?#]*)", 1), F.regexp_extract(to, r"(?s)^[^?#]*(.*)$", 1)
    folder = F.when(own == "", "/").otherwise(F.regexp_extract(own, r"(?s)^(.*/)", 1))
    return (
        F.when(to.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), to)
        .when(to.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), None)
        .when(to.startswith("//"), F.concat(scheme, F.lit(":"), to))
        .when(path == "", F.concat(origin, own, rest))
        .when(to.startswith("/"), F.concat(origin, _no_dots(path), rest))
        .otherwise(F.concat(origin, _no_dots(F.concat(folder, path)), rest))
    )


def decoded(text: Column) -> Column:
    """Without the entities that urls in attributes hold."""
    for entity, char in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    return F.regexp_replace(text, AMPERSAND, "&")


def attribute(tag: Column, name: str) -> Column:
    """The decoded value of a tag's first attribute of that name; null without one."""
    each = lambda group: F.regexp_extract_all(tag, F.lit(ATTRIBUTE), F.lit(group))
    at = F.array_position(F.transform(each(1), lambda n: F.lower(n)), name) - 1
    return decoded(F.concat(*[F.get(each(g), at.cast("int")) for g in (2, 3, 4)]))


def alias_edges(pages: DataFrame) -> DataFrame:
    """(src, dst) of all canonical links and meta refresh targets that a browser would read: none in comments, scripts and
    styles, attributes by their whole names, ``rel`` as a list of words. Relative targets resolve against the page's base, its own url
    or its first ``<base href>``."""
    html = F.coalesce("html", F.lit(""))
    # a cheap test first: most pages name neither
    near = F.lower(html).contains("canonical") | F.lower(html).contains("refresh")
    p = pages.where(F.col("url").contains("://") & near)
    p = p.select("url", F.regexp_extract_all(F.regexp_replace(html, HIDDEN, " "), F.lit(TAG), F.lit(0)).alias("tags"))
    kind = lambda t: F.lower(F.substring(t, 2, 4))
    words = lambda t: F.split(F.lower(F.trim(F.regexp_replace(attribute(t, "rel"), r"\s+", " "))), " ")
    links = F.filter("tags", lambda t: (kind(t) == "link") & F.array_contains(words(t), "canonical"))
    turns = F.filter("tags", lambda t: (kind(t) == "meta") & (F.lower(F.trim(attribute(t, "http-equiv"))) == "refresh"))
    bases = F.filter(F.transform(F.filter("tags", lambda t: kind(t) == "base"), lambda t: attribute(t, "href")), lambda h: h.isNotNull())
    to = F.concat(F.transform(links, lambda t: attribute(t, "href")), F.transform(turns, lambda t: F.regexp_extract(attribute(t, "content"), REFRESH, 1)))
    e = p.select("url", F.get(bases, F.lit(0)).alias("base"), F.explode(to).alias("to")).withColumn("to", F.trim("to")).where("to <> ''")
    base = F.coalesce(F.when(F.trim("base") != "", resolved(F.trim("base"), F.col("url"))), F.col("url"))
    e = e.select("url", "to", base.alias("base"))
    return e.select(node_of(F.col("url")).alias("src"), node_of(resolved(F.col("to"), F.col("base"))).alias("dst")).where("src is not null and dst is not null")


def judge_urls(pages: DataFrame, rules=RULES) -> DataFrame:
    """(page_id, url, html) to (page_id, host, path, rule, verdict, component)."""
    edges = connected_components(alias_edges(pages))
    # the components' own urls, their smallest ones, have no row yet
    edges = edges.union(edges.select("component", "component").distinct())
    url = F.col("url")
    p = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), F.when(url.contains("://"), node_of(url)).alias("node"))
    p = p.withColumn("hit", longest_rule(F.col("host"), F.col("path"), rules))
    # one vote per component and decision: pre-aggregated, so a huge component costs no more.
    # A rule speaks for the alias urls too that no page has.
    named = edges.select("component", longest_rule(host_of(F.col("node")), path_of(F.col("node")), rules).alias("hit"))
    votes = named.groupBy("component").agg(
        F.bool_or(F.col("hit.verdict") == "allow").alias("allowed"), F.bool_or(F.col("hit.verdict") == "block").alias("blocked")
    )
    # only pages with a node are joined, so that no null key gathers the others
    spread = p.where("node is not null").join(edges.join(votes, "component"), "node", "left")
    alone = p.where("node is null").withColumns({c: F.lit(None).cast(kind) for c, kind in (("component", "string"), ("allowed", "boolean"), ("blocked", "boolean"))})
    verdict = F.when(F.col("allowed"), "allow").when(F.col("blocked"), "block").otherwise("allow")
    out = spread.unionByName(alone)
    return out.select("page_id", "host", "path", F.col("hit.rule").alias("rule"), F.coalesce("hit.verdict", verdict).alias("verdict"), "component")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page url judged by the stated rules, decisions spread over aliases."""
    return judge_urls(table(spark, sf_dir, "pages")).drop("component")


def _node(scheme: str, host: str, rest: str) -> str:
    low = lambda x: f"translate({x}, '{UPPER}', '{LOWER}')"
    ports = " ".join(f"WHEN '{n}' THEN regexp_replace({low(host)}, '{p}', '')" for n, p in PORTS)
    return f"{low(scheme)} || '://' || CASE {low(scheme)} {ports} ELSE {low(host)} END || CASE WHEN starts_with({rest}, '/') THEN '' ELSE '/' END || {rest}"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("++", "+").replace("*+", "*").replace("'", "''") + "'"


def _attribute(name: str) -> str:
    at = f"list_position(list_transform(regexp_extract_all(t, {_quoted(ATTRIBUTE)}, 1), lambda n: lower(n)), '{name}')"
    value = " || ".join(f"coalesce(regexp_extract_all(t, {_quoted(ATTRIBUTE)}, {g})[{at}], '')" for g in (2, 3, 4))
    for entity, char in ENTITIES:
        value = f"replace({value}, '{entity}', {'chr(39)' if char == chr(39) else repr(char)})"
    return f"CASE WHEN {at} > 0 THEN regexp_replace({value}, '{AMPERSAND}', '&', 'g') END"


def _resolved(name: str, source: str) -> str:
    """CTEs that end in ``name``: the absolute url t of each row's target, beside its key."""
    return f"""{name}_parts AS (
  SELECT *, regexp_extract(t, '^([^?#]*)', 1) AS tpath, regexp_extract(t, '^[^?#]*((?s:.*))$', 1) AS rest, CASE WHEN own = '' THEN '/' ELSE regexp_extract(own, '^((?s:.*)/)', 1) END AS folder FROM {source}
), {name}_steps AS (
  SELECT *, string_split(substr(CASE WHEN starts_with(t, '/') THEN tpath ELSE folder || tpath END, 2), '/') AS seg FROM {name}_parts
), {name}_kept AS (
  SELECT *, list_reduce(list_transform(seg, lambda x: [x]), lambda a, x: CASE WHEN x[1] = '..' THEN a[:len(a) - 1] WHEN x[1] = '.' THEN a ELSE list_concat(a, x) END, CAST([] AS VARCHAR[])) AS hold FROM {name}_steps
), {name} AS (
  SELECT k, CASE WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN t WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL
    WHEN starts_with(t, '//') THEN scheme || ':' || t WHEN tpath = '' THEN scheme || '://' || h0 || own || rest
    ELSE scheme || '://' || h0 || '/' || array_to_string(CASE WHEN seg[-1] IN ('.', '..') THEN list_append(hold, '') ELSE hold END, '/') || rest END AS t
  FROM {name}_kept
)"""


_SPLIT = "substr({u}, 1, strpos({u}, '://') - 1) AS scheme, regexp_extract(substr({u}, strpos({u}, '://') + 3), '^([^/?#]*)', 1) AS h0, regexp_extract(substr({u}, strpos({u}, '://') + 3), '^[^/?#]*([^?#]*)', 1) AS own, regexp_extract(substr({u}, strpos({u}, '://') + 3), '^[^/?#]*([^#]*)', 1) AS full_path"


def _sql() -> str:
    node = _node
    return rf"""
WITH RECURSIVE u AS (
  SELECT page_id, url, coalesce(html, '') AS html, CASE WHEN contains(url, '://') THEN strpos(url, '://') END AS k FROM pages
), s AS (
  SELECT page_id, url, html, substr(url, 1, k - 1) AS scheme, coalesce(regexp_extract(substr(url, k + 3), '^([^/?#]*)', 1), '') AS h0,
    coalesce(regexp_extract(substr(url, k + 3), '^[^/?#]*([^?#]*)', 1), '') AS path, coalesce(regexp_extract(substr(url, k + 3), '^[^/?#]*([^#]*)', 1), '') AS full_path
  FROM u
), p AS (
  SELECT *, translate(h0, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    {node("scheme", "h0", "full_path")} AS node
  FROM s
), rules(verdict, rh, rp) AS (
  VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'),
         ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')
), hits AS (
  SELECT host, path, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(verdict, length(rh || rp)) AS verdict
  FROM (SELECT DISTINCT host, path FROM p) JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY ALL
), found AS (
  SELECT row_number() OVER () AS k, node, url, regexp_extract_all(regexp_replace(html, {_quoted(HIDDEN)}, ' ', 'g'), {_quoted(TAG)}) AS ts FROM p WHERE node IS NOT NULL
), tags AS (
  SELECT k, node, url, unnest(ts) AS t, generate_subscripts(ts, 1) AS i FROM found
), told AS (
  SELECT *, lower(substr(t, 2, 4)) AS kind, {_attribute("href")} AS href, {_attribute("rel")} AS rel, {_attribute("http-equiv")} AS equiv, {_attribute("content")} AS content FROM tags
), bases AS (
  SELECT k, any_value(url) AS url, trim(arg_min(href, i)) AS t FROM told WHERE kind = 'base' AND href IS NOT NULL GROUP BY k
), based AS (
  SELECT k, t, {_SPLIT.format(u="url")} FROM bases WHERE t <> ''
), {_resolved("base_urls", "based")}, named AS (
  SELECT row_number() OVER () AS k, node, t, {_SPLIT.format(u="base")} FROM (SELECT node, trim(raw) AS t, coalesce(b.t, url) AS base FROM (
    SELECT k, node, url, href AS raw FROM told WHERE kind = 'link' AND list_contains(string_split(lower(trim(regexp_replace(rel, '\s+', ' ', 'g'))), ' '), 'canonical')
    UNION ALL SELECT k, node, url, regexp_extract(content, {_quoted(REFRESH)}, 1) FROM told WHERE kind = 'meta' AND lower(trim(equiv)) = 'refresh') LEFT JOIN base_urls b USING (k)) WHERE t <> ''
), {_resolved("targets", "named")}, raw_edges AS (
  SELECT node AS a, {node("scheme", "h0", "full_path")} AS b FROM (SELECT n.node, {_SPLIT.format(u="x.t")} FROM targets x JOIN named n USING (k) WHERE x.t IS NOT NULL)
), edges AS (
  SELECT a, b FROM raw_edges UNION SELECT b, a FROM raw_edges
), reach(a, b) AS (
  SELECT a, b FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a
), names AS (
  SELECT DISTINCT b AS node, regexp_extract(b, '://([^/?#]*)', 1) AS host, regexp_extract(b, '://[^/?#]*([^?#]*)', 1) AS path FROM reach
), spoken AS (
  SELECT node, arg_max(verdict, length(rh || rp)) AS verdict FROM names JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY node
), votes AS (
  SELECT r.a AS node, bool_or(h.verdict = 'allow') AS allowed, bool_or(h.verdict = 'block') AS blocked FROM reach r JOIN spoken h ON h.node = r.b GROUP BY r.a
)
SELECT p.page_id, p.host, p.path, h.rule,
  coalesce(h.verdict, CASE WHEN v.allowed THEN 'allow' WHEN v.blocked THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN hits h ON h.host = p.host AND h.path = p.path LEFT JOIN votes v ON v.node = p.node
"""


OP9_SQL = _sql()
