"""Names of the registered queries, each with the SQL it is compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions import url as U
from tessera.operators import costs, crawl, extract, pages, relational, schemas
from tessera.sources import sinks
from tessera.session import spread, table, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Register a query under its function's name, and its SQL."""

    def add(fn: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def page_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "pages"))


def page_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of all pages, parsed once, for queries that read them several times."""
    return written(pages.dom_nodes(page_table(spark, sf_dir)), "nodes")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["clean_text_default"](spark, sf_dir)


# -- pieces of SQL
NORM = r"regexp_replace(regexp_replace(url, '#.*$', ''), '^([A-Za-z][A-Za-z0-9+.-]*://[^/?]+/[^?]+?)/($|[?])', '\1\2')"
AUTHORITY = "regexp_extract(url, '^[a-z]+://(?:[^/?#@]*@)?([^/?#]*)', 1)"
LINK = "regexp_extract(url, '^[a-z]+://[^/?#]+', 0) || replace(replace(url_encode(h), '%2F', '/'), '%2C', ',')"
HREFS = "SELECT page_id, url, unnest(l) AS h, generate_subscripts(l, 1) AS k FROM (SELECT page_id, url, regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1) AS l FROM pages)"


def plain(s: str) -> str:
    """Tags out, entities as signs, white space collapsed and trimmed."""
    s = f"regexp_replace({s}, '<[^>]*>', '', 'g')"
    for a, b in (("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&amp;", "&")):
        s = f"replace({s}, '{a}', '{b}')"
    return f"trim(regexp_replace({s}, '[\\t\\n\\f\\r ]+', ' ', 'g'))"


NO_SCRIPT = "regexp_replace(regexp_replace(regexp_replace(regexp_replace({}, '(?s)<head>.*?</head>', '', 'g'), '(?s)<script[^>]*>.*?</script>', '', 'g'), '(?s)<style[^>]*>.*?</style>', '', 'g'), '(?s)<!--.*?-->', '', 'g')"
BODY = NO_SCRIPT.format("html")
NO_AD = f"regexp_replace({BODY}, '(?s)<div class=\"ad\">.*?</div>', '', 'g')"


# -- URLs
@query(f"SELECT page_id, {NORM} AS norm FROM pages")
def url_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_table(spark, sf_dir).select("page_id", U.normalize(F.col("url")).alias("norm"))


@query(
    f"""SELECT page_id, CASE WHEN NOT contains(url, '?') THEN url ELSE split_part(url, '?', 1) ||
        CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END || fragment END AS cleaned
      FROM (SELECT *, list_filter(string_split(qs, '&'), lambda x: x <> '' AND lower(split_part(x, '=', 1)) NOT IN {U.TRACKING}
        AND NOT starts_with(lower(split_part(x, '=', 1)), 'utm_')) AS kept
      FROM (SELECT page_id, url, split_part(rest, '#', 1) AS qs, substr(rest, length(split_part(rest, '#', 1)) + 1) AS fragment
      FROM (SELECT page_id, url, substr(url, length(split_part(url, '?', 1)) + 2) AS rest FROM pages)))"""
)
def url_strip_tracking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_table(spark, sf_dir).select("page_id", U.strip_tracking_params(F.col("url")).alias("cleaned"))


@query(f"SELECT {AUTHORITY} AS host, count(*) AS n FROM pages GROUP BY 1")
def url_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_table(spark, sf_dir).groupBy(U.authority(F.col("url")).alias("host")).agg(F.count("*").alias("n"))


@query(f"WITH h AS (SELECT page_id, {AUTHORITY} AS a FROM pages) SELECT x.page_id AS page_id, count(*) AS same FROM h x JOIN h y ON x.a = y.a GROUP BY 1")
def same_domain_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = page_table(spark, sf_dir).select("page_id", U.authority(F.col("url")).alias("a"))
    sizes = p.groupBy("a").agg(F.count("*").alias("same"))
    return p.join(sizes, "a").select("page_id", "same")


@query(f"SELECT page_id, norm FROM (SELECT page_id, {NORM} AS norm, row_number() OVER (PARTITION BY {NORM} ORDER BY page_id) AS k FROM pages) WHERE k = 1 AND norm <> ''")
def visited_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = page_table(spark, sf_dir).select("url", F.lit(0).alias("depth"), F.col("page_id").alias("seq"))
    return crawl.admit(p, p.select("url").limit(0)).select(F.col("seq").alias("page_id"), F.col("url").alias("norm"))


@query("SELECT page_id, CASE WHEN starts_with(h, '//') THEN 'https:' || h ELSE h END AS shown, regexp_matches(lower(h), 'pixel\\.png|pixel\\.gif|blank\\.png|blank\\.gif|spacer\\.png|spacer\\.gif|1x1\\.|data:image') AS placeholder FROM (" + HREFS + ")")
def render_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = page_table(spark, sf_dir).select("page_id", F.explode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))).alias("h"))
    return h.select("page_id", U.scheme_added(F.col("h")).alias("shown"), U.placeholder_image(F.col("h")).alias("placeholder"))


# -- pages
@query(f"SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY k) - 1 AS INTEGER) AS pos, link FROM (SELECT page_id, {LINK} AS link, min(k) AS k FROM ({HREFS}) WHERE h <> '' AND NOT starts_with(h, '#') GROUP BY 1, 2)")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = page_table(spark, sf_dir)
    return p.select("page_id", F.posexplode(pages.extract_links(F.col("html"), F.col("url"))).alias("pos", "link"))


@query("SELECT page_id, CAST(len(regexp_extract_all(html, '<a href=')) AS BIGINT) AS links_count FROM pages")
def link_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = page_table(spark, sf_dir)
    nodes = pages.dom_nodes(p).filter("tag = 'a'").filter(relational.attribute("href").isNotNull())
    return p.select("page_id").join(nodes.groupBy("page_id").agg(F.count("*").alias("links_count")), "page_id", "left").select("page_id", F.coalesce("links_count", F.lit(0)).alias("links_count"))


@query("SELECT page_id, " + plain("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)") + " AS title FROM pages")
def page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_table(spark, sf_dir).select("page_id", pages.fetched(F.col("html"), F.col("url"))["title"].alias("title"))


@query("SELECT page_id, 1 AS level, " + plain("regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)") + " AS heading FROM pages")
def page_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = page_table(spark, sf_dir).select("page_id", F.explode(pages.headings(F.col("html"))).alias("h"))
    return h.select("page_id", F.col("h.level").alias("level"), T.collapse_spaces(F.col("h.text")).alias("heading"))


@query(f"SELECT page_id, {plain(BODY)} AS txt FROM pages")
def fetch_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_table(spark, sf_dir).select("page_id", pages.fetched(F.col("html"), F.col("url"))["text"].alias("txt"))


# An unclosed <b> opens again in each later block with text, three of them at most, and in the footer.
_BOLD = """SELECT page_id, CAST(sum(own + CASE WHEN x <> '' THEN least(3, before) ELSE 0 END) AS BIGINT) AS n FROM (
    SELECT page_id, own, x, sum(own) OVER (PARTITION BY page_id ORDER BY k) - own AS before FROM (
      SELECT page_id, k, CAST(starts_with(p, '<b>') AS BIGINT) AS own, trim(regexp_replace(p, '<[^>]*>', '', 'g'), chr(10) || chr(9) || chr(13) || chr(12) || ' ') AS x FROM (
        SELECT page_id, unnest(ps) AS p, generate_subscripts(ps, 1) AS k FROM (SELECT page_id, string_split(regexp_extract(html, '(?s)<article>(.*?)</article>', 1), '<p>') AS ps FROM pages)) WHERE k > 1
      UNION ALL SELECT page_id, 1000000, 0, trim(regexp_extract(html, '(?s)<footer>(.*?)</footer>', 1)) FROM pages)) GROUP BY 1"""


@query(f"""SELECT page_id, tag, CAST(count(*) AS BIGINT) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '<([a-z][a-z0-9]*)[ >]', 1)) AS tag FROM pages) WHERE tag <> 'b' GROUP BY 1, 2
    UNION ALL SELECT page_id, 'b', n FROM ({_BOLD}) WHERE n > 0""")
def dom_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = pages.dom_nodes(page_table(spark, sf_dir)).filter("kind = 'element'")
    return n.groupBy("page_id", "tag").agg(F.count("*").alias("n"))


# -- cleaning
CLEAN_TEXT = f"SELECT page_id, {plain(NO_AD)} AS txt FROM pages"


@query(f"SELECT page_id, txt, CASE WHEN strlen(html) = 0 THEN 0.0 ELSE CAST(strlen(html) - strlen(txt) AS DOUBLE) / strlen(html) * 100 END AS reduction_pct FROM ({CLEAN_TEXT}) JOIN pages USING (page_id)")
def clean_text_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = page_table(spark, sf_dir).withColumn("txt", pages.clean_html(F.col("html"), "default", output="text"))
    return p.select("page_id", "txt", pages.reduction_percent(F.octet_length("html"), F.octet_length("txt")).alias("reduction_pct"))


def _entities(s: str) -> str:
    for a, b in (("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&amp;", "&")):
        s = f"replace({s}, '{a}', '{b}')"
    return s


PARTS = f"""SELECT page_id, k, {_entities("p")} AS p FROM (SELECT page_id, unnest(ps) AS p, generate_subscripts(ps, 1) AS k FROM (
  SELECT page_id, string_split(regexp_replace(regexp_extract(html, '(?s)<article>(.*?)</article>', 1), '</p>|<br>|<b>|</b>', '', 'g'), '<p>') AS ps FROM pages))"""


@query(
    f"""WITH b AS ({PARTS}),
    t AS (SELECT page_id, k, p, trim(p, chr(10) || chr(9) || chr(13) || chr(12) || ' ') AS x FROM b WHERE k > 1),
    s AS (SELECT * FROM t WHERE strlen(x) >= 25),
    d AS (SELECT *, row_number() OVER (PARTITION BY page_id, x ORDER BY k) AS r FROM s),
    o AS (SELECT page_id, k, p FROM d WHERE r = 1 AND NOT (strlen(x) <= 200 AND regexp_matches(x, '(?i)^\\s*copyright\\s*[©®]?\\s*\\d{{4}}|^\\s*[©®]\\s*\\d{{4}}|^\\s*all\\s+rights\\s+reserved\\.?\\s*$|privacy\\s+policy\\s*[|•·\\-]\\s*terms|^\\s*powered\\s+by\\s+\\w+\\s*$|^\\s*built\\s+with\\s+\\w+\\s*$'))),
    h AS (SELECT page_id, k, {_entities("regexp_extract(p, '(?s)<h1>(.*?)</h1>', 1)")} || regexp_replace(p, '(?s)^.*</h1>', '') AS p FROM b WHERE k = 1)
    SELECT page_id, trim(regexp_replace(string_agg(p, '' ORDER BY k), '[\\t\\n\\f\\r ]+', ' ', 'g')) AS txt FROM (SELECT * FROM h UNION ALL SELECT * FROM o) GROUP BY 1"""
)
def clean_text_aggressive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_table(spark, sf_dir).select("page_id", pages.clean_html(F.col("html"), "aggressive", output="text").alias("txt"))


def _fields(s: str) -> str:
    return f"trim(regexp_replace({_entities(s)}, '[\\t\\n\\f\\r ]+', ' ', 'g'))"


# Every <b> of these pages opens a paragraph and is never closed, so later text is in as many bolds, three at most.
MARKDOWN = f"""WITH a AS (SELECT page_id, unnest(ps) AS p, generate_subscripts(ps, 1) AS k FROM (
      SELECT page_id, string_split(regexp_extract(html, '(?s)<article>(.*?)</article>', 1), '<p>') AS ps FROM pages)),
    b AS (SELECT page_id, k, CAST(starts_with(p, '<b>') AS INTEGER) AS own, regexp_replace(p, '</p>|<b>', '', 'g') AS p FROM a WHERE k > 1),
    n AS (SELECT *, sum(own) OVER (PARTITION BY page_id ORDER BY k) - own AS before FROM b),
    t AS (SELECT page_id, k, repeat('**', CAST(least(3, before) + own AS INTEGER)) AS m, {_fields("split_part(p, '<br>', 1)")} || CASE WHEN contains(p, '<br>') THEN chr(10) || {_fields("split_part(p, '<br>', 2)")} ELSE '' END AS x FROM n),
    g AS (SELECT page_id, string_agg(m || x || m, chr(10) || chr(10) ORDER BY k) AS blocks FROM t WHERE x <> '' GROUP BY 1),
    f AS (SELECT page_id, '# ' || {_fields("regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)")} AS head, {_fields("regexp_extract(html, '(?s)<footer>(.*?)</footer>', 1)")} AS foot,
      repeat('**', CAST(least(3, len(regexp_extract_all(html, '<b>'))) AS INTEGER)) AS m FROM pages)
    SELECT page_id, head || coalesce(chr(10) || chr(10) || blocks, '') || CASE WHEN foot <> '' THEN chr(10) || chr(10) || m || foot || m ELSE '' END AS markdown FROM f LEFT JOIN g USING (page_id)"""


@query(MARKDOWN)
def clean_markdown_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_table(spark, sf_dir).select("page_id", pages.clean_html(F.col("html"), "default", output="markdown").alias("markdown"))


@query(
    f"""SELECT page_id, '---' || chr(10) || '# Content Metadata' || chr(10) || chr(10) || 'headings:' || chr(10) || '  - level: 1' || chr(10) || '    text: "'
      || replace(replace(trim({_entities("regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)")}), chr(92), chr(92) || chr(92)), '"', chr(92) || '"') || '"' || chr(10) || chr(10)
      || 'links_count: ' || len(regexp_extract_all(html, '<a href=')) || chr(10) || chr(10) || 'hints:' || chr(10) || '---' || chr(10) || chr(10) || markdown AS markdown
      FROM pages JOIN ({MARKDOWN}) USING (page_id)"""
)
def clean_markdown_frontmatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_table(spark, sf_dir).select("page_id", pages.clean_html(F.col("html"), "default", output="markdown", frontmatter=True).alias("markdown"))


_PHASES = "selectors scripts styles -noscript unwrap_noscript comments svg iframes hidden event_handlers attributes -link_density -short_text -empty whitespace srcset tracking_params -repeated_links -deduplicate -boilerplate"
_PHASE_ROWS = ", ".join(f"('{x.lstrip('-')}', {str(x[0] != '-').lower()})" for x in _PHASES.split())


@query(
    f"""SELECT page_id, phase, enabled, CAST(CASE phase WHEN 'selectors' THEN len(regexp_extract_all(html, '<div class="ad">')) WHEN 'scripts' THEN len(regexp_extract_all(html, '<script'))
      WHEN 'styles' THEN len(regexp_extract_all(html, '<style')) ELSE 0 END AS INTEGER) AS removed FROM pages CROSS JOIN (VALUES {_PHASE_ROWS}) v(phase, enabled)"""
)
def clean_html_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = page_table(spark, sf_dir).select("page_id", pages.clean_stats(F.col("html"), "default")["phases"].alias("p"))
    return r.select("page_id", F.explode("p").alias("p")).select("page_id", F.col("p.name").alias("phase"), F.col("p.enabled").alias("enabled"), F.col("p.elements_removed").alias("removed"))


@query(
    "SELECT page_id, sel, n FROM (SELECT page_id, '.ad' AS sel, CAST(len(regexp_extract_all(html, '<div class=\"ad\">')) AS INTEGER) AS n FROM pages "
    "UNION ALL SELECT page_id, 'script', CAST(len(regexp_extract_all(html, '<script')) AS INTEGER) FROM pages UNION ALL SELECT page_id, 'style', CAST(len(regexp_extract_all(html, '<style')) AS INTEGER) FROM pages) WHERE n > 0"
)
def removed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = page_table(spark, sf_dir).select("page_id", pages.clean_stats(F.col("html"), "default").alias("s"))
    ph = r.select("page_id", F.explode("s.phases").alias("p")).select("page_id", F.explode("p.details").alias("sel", "n"))
    return ph.filter(F.col("sel").isin(".ad", "script", "style"))


@query(f"SELECT page_id, 'default' AS preset, CAST(strlen(html) AS BIGINT) AS input_bytes, CAST(strlen(txt) AS BIGINT) AS output_bytes FROM pages JOIN ({CLEAN_TEXT}) USING (page_id) UNION ALL SELECT page_id, 'minimal', CAST(strlen(html) AS BIGINT), CAST(strlen({plain(BODY)}) AS BIGINT) FROM pages")
def preset_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.compare_presets(page_table(spark, sf_dir), ("default", "minimal"), output="text").select("page_id", "preset", "input_bytes", "output_bytes")


NAV = "regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1)"


@query(f"""WITH n AS (SELECT page_id, unnest(regexp_extract_all({NAV}, '(?s)<a [^>]*>(.*?)</a>', 1)) AS a FROM pages),
    s AS (SELECT page_id, sum(strlen(trim({_entities("a")}))) AS x FROM n GROUP BY 1)
    SELECT page_id, CAST(coalesce(x, 0) AS DOUBLE) / t AS density FROM (SELECT page_id, strlen(trim({_entities("regexp_replace(" + NAV + ", '<[^>]*>', '', 'g')")}, chr(10) || chr(9) || ' ')) AS t FROM pages) LEFT JOIN s USING (page_id) WHERE t > 0""")
def link_density_nav(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = page_nodes(spark, sf_dir)
    return relational.link_density(n).filter("tag = 'nav'").select("page_id", F.col("density").cast("double").alias("density"))


@query(f"SELECT page_id, count(*) AS repeated FROM (SELECT page_id, row_number() OVER (PARTITION BY page_id, trim(split_part(h, '#', 1)) ORDER BY k) AS r FROM ({HREFS}) WHERE h NOT IN ('', '#')) WHERE r > 1 GROUP BY 1")
def repeated_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = page_nodes(spark, sf_dir)
    return relational.repeated_link_matches(n).groupBy("page_id").agg(F.count("*").alias("repeated"))


@query(f"SELECT page_id, {plain(BODY)} AS txt FROM pages")
def relational_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = page_nodes(spark, sf_dir)
    return relational.page_texts(relational.drop_subtrees(n, relational.tag_matches(n, "script", "style"))).withColumnRenamed("text", "txt")


@query("SELECT doc_id, line_no, line FROM (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS line_no FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)) WHERE regexp_matches(line, '(?i)^\\s*copyright\\s*[©®]?\\s*\\d{4}|^\\s*[©®]\\s*\\d{4}|^\\s*all\\s+rights\\s+reserved\\.?\\s*$|privacy\\s+policy\\s*[|•·\\-]\\s*terms|^\\s*powered\\s+by\\s+\\w+\\s*$|^\\s*built\\s+with\\s+\\w+\\s*$')")
def boilerplate_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("k", "line"))
    return lines.filter(T.boilerplate(F.col("line"))).select("doc_id", (F.col("k") + 1).cast("long").alias("line_no"), "line")


@query("SELECT doc_id, count(*) AS repeated FROM (SELECT doc_id, row_number() OVER (PARTITION BY doc_id, x ORDER BY k) AS r FROM (SELECT doc_id, k, trim(line, chr(9) || chr(13) || ' ') AS x FROM (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS k FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))) WHERE strlen(x) >= 15) WHERE r > 1 GROUP BY 1")
def text_block_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.filter(F.transform(F.split("text", "\n"), T.trim_text), lambda line: F.octet_length(line) >= 15)
    d = table(spark, sf_dir, "documents").select("doc_id", x.alias("x"))
    return d.select("doc_id", (F.size("x") - F.size(F.array_distinct("x"))).cast("long").alias("repeated")).filter("repeated > 0")


@query("SELECT doc_id, CASE WHEN strlen(text) <= 1000 THEN text ELSE text[:list_max(list_filter(range(250, 1001), lambda k: strlen(text[:k]) <= 1000))] || chr(10) || chr(10) || '[Content truncated due to length...]' END AS cut FROM documents")
def truncate_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.truncate_bytes(F.col("text"), 1000).alias("cut"))


@query("SELECT doc_id, strlen(text) >= 500 AS enough FROM documents")
def min_content_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", pages.enough_content(F.col("text"), 500).alias("enough"))


# -- classes
CHALLENGES = (
    (-1, "Just a moment...", "<p>x</p>"), (-2, "x", '<div id="cf_chl_opt">'), (-3, "x", '<div class="cf-turnstile">'), (-4, "x", '<div class="h-captcha">'),
    (-5, "x", '<script src="https://www.google.com/recaptcha/api.js">'), (-6, "Access Denied", ""), (-7, "x", "Robot or human?"), (-8, "ok", "fine"),
)
_VALUES = ", ".join("({}, '{}', '{}')".format(*r) for r in CHALLENGES)


@query(
    f"""WITH p AS (SELECT page_id, {plain("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)")} AS title, html FROM pages UNION ALL SELECT * FROM (VALUES {_VALUES})),
    l AS (SELECT page_id, lower(title) AS t, lower(html) AS h FROM p)
    SELECT page_id, CASE WHEN contains(t, 'just a moment') OR contains(t, 'attention required') OR contains(h, 'cf-challenge') OR contains(h, 'cf_chl_opt') THEN 'cloudflare'
      WHEN contains(h, 'challenges.cloudflare.com/turnstile') OR contains(h, 'cf-turnstile') THEN 'cloudflare-turnstile' WHEN contains(h, 'hcaptcha.com') OR contains(h, 'h-captcha') THEN 'hcaptcha'
      WHEN contains(h, 'google.com/recaptcha') OR contains(h, 'g-recaptcha') THEN 'recaptcha' WHEN contains(t, 'access denied') OR contains(t, 'blocked') OR contains(t, 'bot detection') OR contains(h, 'robot or human') THEN 'anti-bot' ELSE '' END AS kind FROM l"""
)
def challenge_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = page_table(spark, sf_dir).select("page_id", pages.fetched(F.col("html"), F.col("url"))["title"].alias("title"), "html")
    p = p.union(spark.createDataFrame(list(CHALLENGES), "page_id long, title string, html string"))
    return p.select("page_id", pages.challenge_class(F.col("title"), F.col("html")).alias("kind"))


MESSAGES = ("Error solving: Timeout after 60s", "The challenge could not be solved", "Captcha detected", "Cloudflare blocked", "403 Forbidden", "browser has crashed", "unable to process", "strange")
_MESSAGE = "CASE event_id % 8 " + " ".join(f"WHEN {k} THEN '{m}'" for k, m in enumerate(MESSAGES)) + " END || ' ' || event_type"
_KIND = "CASE " + " ".join(f"WHEN {' OR '.join(f'contains(m, {chr(39)}{w}{chr(39)})' for w in words)} THEN '{kind}'" for kind, words in costs.ERROR_RULES) + " ELSE 'anti-bot' END"


@query(f"SELECT kind, count(*) AS n FROM (SELECT {_KIND} AS kind FROM (SELECT lower({_MESSAGE}) AS m FROM events)) GROUP BY 1")
def solver_error_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "events").select(F.expr(_MESSAGE).alias("m"))
    return m.groupBy(costs.error_class(F.col("m")).alias("kind")).agg(F.count("*").alias("n"))


_RETRY = "CASE event_id % 4 WHEN 0 THEN 'HTTP 429' WHEN 1 THEN 'rate limit reached' WHEN 2 THEN 'bad request' END"
_FINISH = "CASE event_id % 3 WHEN 0 THEN 'length' WHEN 1 THEN 'stop' END"


@query(f"SELECT event_id, coalesce(contains({_RETRY}, 'rate limit') OR contains({_RETRY}, '429'), false) AS again, coalesce({_FINISH} = 'length', false) AS cut FROM events")
def retry_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", costs.retryable(F.expr(_RETRY)).alias("again"), costs.truncated(F.expr(_FINISH)).alias("cut"))


# -- records
RECORD = schemas.Schema("event", "", (schemas.Field("k", "integer", required=True), schemas.Field("name", "string"), schemas.Field("tags", "array", items=schemas.Field(type="string"))))
_PROPS = """CASE event_id % 6 WHEN 0 THEN props WHEN 1 THEN '{"k": null}' WHEN 2 THEN '{"k": "7", "name": 3}' WHEN 3 THEN '{"name": "a", "tags": ["x", 1]}' WHEN 4 THEN '{"k": 1.5, "tags": "x"}' ELSE '{"k": 2, "tags": ["x"], "name": null, "more": 1}' END"""


@query(
    f"""WITH e AS (SELECT event_id, CAST({_PROPS} AS JSON) AS j FROM events),
    t AS (SELECT event_id, j, json_type(j, '$.k') AS k, json_type(j, '$.name') AS n, json_type(j, '$.tags') AS a FROM e),
    m AS (SELECT event_id, 1 AS o, 'k' AS field, CASE WHEN k IS NULL THEN 'required field is missing' WHEN k = 'NULL' THEN 'value is null but field is required' WHEN k = 'VARCHAR' THEN 'expected integer, got string' END AS message FROM t
      UNION ALL SELECT event_id, 2, 'name', CASE WHEN n NOT IN ('NULL', 'VARCHAR') THEN 'expected string, got number' END FROM t
      UNION ALL SELECT event_id, 3, 'tags', CASE WHEN a = 'VARCHAR' THEN 'expected array, got string' WHEN a = 'ARRAY' AND json_type(j, '$.tags[1]') <> 'VARCHAR' THEN 'item 1: expected string, got number' END FROM t)
    SELECT event_id, field, message FROM m WHERE message IS NOT NULL"""
)
def json_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", F.try_parse_json(F.expr(_PROPS)).alias("v"))
    return e.select("event_id", F.explode(RECORD.errors(F.col("v"))).alias("x")).select("event_id", "x.field", "x.message")


_MODELS = ("claude-3-opus-20240229", "gpt-4o", "gpt-4o-mini", "unknown-model", "llama-3:free", "gpt-4-turbo-2024", "mistral:free", "o1-mini-2024")
_CALLS = "SELECT conv_id, turn, CASE WHEN (conv_id + turn) % 8 = 0 THEN 'anthropic' WHEN (conv_id + turn) % 8 = 3 THEN 'ollama' ELSE 'openai' END AS provider, CASE (conv_id + turn) % 8 " + " ".join(f"WHEN {k} THEN '{m}'" for k, m in enumerate(_MODELS)) + " END AS model, CAST(length(text) AS BIGINT) AS input_tokens, CAST(turn AS BIGINT) AS output_tokens FROM conversations"


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "conversations").createOrReplaceTempView("conversations")
    return spark.sql(_CALLS)


_PRICES = ", ".join(f"('{p}', '{m}', {i}::DOUBLE / 1000000, {o}::DOUBLE / 1000000)" for p, ms in costs.PRICES.items() for m, (i, o, _) in ms.items())


@query(f"SELECT conv_id, turn, round(CASE WHEN c.provider = 'ollama' THEN 0.0 ELSE input_tokens * i + output_tokens * o END, 9) AS cost FROM ({_CALLS}) c LEFT JOIN (VALUES {_PRICES}) p(provider, model, i, o) ON c.provider = p.provider AND c.model = p.model")
def cost_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    return costs.known_cost(_calls(spark, sf_dir), costs.prices(spark)).select("conv_id", "turn", F.round("cost", 9).alias("cost"))


_TIER = "CASE WHEN contains(m, 'gpt-4') AND NOT contains(m, 'mini') THEN 15 * a + 60 * b " + " ".join(f"WHEN {' OR '.join(f'contains(m, {chr(39)}{w}{chr(39)})' for w in words)} THEN {i} * a + {o} * b" for words, i, o in costs.TIERS) + " WHEN contains(m, ':free') THEN 0 ELSE 0.25 * a + b END"


@query(f"SELECT conv_id, turn, round(CAST({_TIER} AS DOUBLE) / 1000000, 9) AS cost FROM (SELECT conv_id, turn, lower(model) AS m, input_tokens::DOUBLE AS a, output_tokens::DOUBLE AS b FROM ({_CALLS}))")
def cost_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _calls(spark, sf_dir).select("conv_id", "turn", F.round(costs.tier_cost(F.col("model"), F.col("input_tokens"), F.col("output_tokens")), 9).alias("cost"))


_LISTED = "CASE " + " ".join(f"WHEN starts_with(model, '{m}') THEN a * {i} + b * {o}" for m, (i, o, _) in sorted(costs.PRICES["openai"].items(), key=lambda x: (-len(x[0]), x[0]))) + " ELSE a * 0.15 + b * 0.6 END"


@query(f"SELECT conv_id, turn, round(CAST({_LISTED} AS DOUBLE) / 1000000, 9) AS cost FROM (SELECT conv_id, turn, model, input_tokens::DOUBLE AS a, output_tokens::DOUBLE AS b FROM ({_CALLS}))")
def cost_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _calls(spark, sf_dir).select("conv_id", "turn", F.round(costs.listed_cost("openai", F.col("model"), F.col("input_tokens"), F.col("output_tokens")), 9).alias("cost"))


@query(f"SELECT conv_id, count(*) AS calls, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens FROM ({_CALLS}) GROUP BY 1")
def usage_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return costs.usage(_calls(spark, sf_dir), "conv_id")


@query("SELECT event_id, coalesce(TRY_CAST(nullif(regexp_extract(s, '^\\s*([+-]?(?:[0-9]+\\.?[0-9]*|\\.[0-9]+)(?:[eE][+-]?[0-9]+)?)', 1), '') AS DOUBLE), 0.0) AS price FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN '0' WHEN 2 THEN '0.0000025' ELSE 'free' END AS s FROM events)")
def price_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.expr("CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN '0' WHEN 2 THEN '0.0000025' ELSE 'free' END")
    return table(spark, sf_dir, "events").select("event_id", costs.parse_price(s).alias("price"))


_PARAMS = "CASE event_id % 3 WHEN 0 THEN 'tools,vision' WHEN 1 THEN 'structured_outputs,tool_choice,response_format' ELSE 'reasoning' END"


@query(f"SELECT event_id, list_contains(p, 'structured_outputs') AS structured_outputs, list_has_any(p, ['tools', 'tool_choice']) AS tools, list_contains(p, 'reasoning') AS reasoning, list_contains(p, 'response_format') AS response_format, list_contains(p, 'vision') AS vision, true AS streaming FROM (SELECT event_id, string_split({_PARAMS}, ',') AS p FROM events)")
def model_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", costs.capabilities(F.split(F.expr(_PARAMS), ",")).alias("c"))
    return e.select("event_id", "c.*")


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events WHERE event_id % 3 <> 0 AND value > 1) WHERE k = 1")
def fallback_first_success(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    a = e.withColumn("available", F.col("event_id") % 3 != 0).withColumn("error", F.when(~(F.col("value") > 1) | F.col("value").isNull(), "failed")).withColumn("priority", F.col("event_id"))
    return extract.first_success(a, "user_id").select("user_id", "event_id", "event_type")


@query("SELECT event_type, user_id, n FROM (SELECT event_type, user_id, count(*) AS n, row_number() OVER (PARTITION BY event_type ORDER BY count(*) DESC, CAST(user_id AS VARCHAR)) AS k FROM events GROUP BY 1, 2) WHERE k <= 5")
def stats_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "events").groupBy("event_type", F.col("user_id").cast("string").alias("u")).agg(F.count("*").alias("n"))
    m = c.groupBy("event_type").agg(F.map_from_entries(F.collect_list(F.struct("u", "n"))).alias("m"))
    return m.select("event_type", F.explode(pages.top_details(F.col("m"))).alias("x")).select("event_type", F.col("x.key").cast("long").alias("user_id"), F.col("x.value").alias("n"))


# -- crawl
_EDGES = """SELECT 'http://h/n/' || n_nationkey AS src, 'http://h/c/' || c_custkey AS dst, c_custkey AS pos FROM nation JOIN customer ON n_nationkey = c_nationkey
  UNION ALL SELECT 'http://h/c/' || o_custkey, 'http://h/o/' || o_orderkey, o_orderkey FROM orders
  UNION ALL SELECT 'http://h/o/' || o_orderkey, 'http://other/x' || o_orderkey, 1 FROM orders
  UNION ALL SELECT 'http://h/o/' || o_orderkey, 'http://h/n/' || (o_orderkey % 25), 2 FROM orders"""


@query(
    f"""WITH RECURSIVE e AS ({_EDGES}), r(url, depth) AS (SELECT 'http://h/n/' || n_nationkey, 0 FROM nation
      UNION SELECT dst, depth + 1 FROM r JOIN e ON url = src WHERE depth < 3 AND starts_with(dst, 'http://h/'))
    SELECT url, CAST(min(depth) AS INTEGER) AS depth FROM r GROUP BY 1"""
)
def crawl_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    for t in ("nation", "customer", "orders"):
        table(spark, sf_dir, t).createOrReplaceTempView(t)
    seeds = spark.sql("SELECT 'http://h/n/' || n_nationkey AS url, n_nationkey AS seq FROM nation")
    return crawl.levels(seeds, spark.sql(_EDGES), max_depth=3, numbered=False)


# -- extraction and sinks
PAGE_SCHEMA = schemas.Schema("page", "A page", (schemas.Field("title", "string", required=True), schemas.Field("links", "array", items=schemas.Field(type="string"))))
RULES = extract.RuleExtractor({"title": "article > h1", "links": "nav a@href"})


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = page_table(spark, sf_dir)
    return p.select("page_id", "url", extract.extracted(pages.clean_html(F.col("html")), RULES, PAGE_SCHEMA).alias("r")).select("page_id", "url", "r.*")


@query(
    "SELECT page_id, " + plain("regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)") + f""" AS title, coalesce(n, 0) AS links
    FROM pages LEFT JOIN (SELECT page_id, count(*) AS n FROM ({HREFS}) GROUP BY 1) USING (page_id)"""
)
def extract_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _results(spark, sf_dir).select("page_id", F.from_json("data", PAGE_SCHEMA.ddl()).alias("d"))
    return d.select("page_id", T.collapse_spaces(F.col("d.title")).alias("title"), F.size("d.links").cast("long").alias("links"))


_TITLE = plain("regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)")


@query(f"""SELECT url, 'rules' AS model, 'rules' AS provider, CAST(NULL AS INTEGER) AS retry_count, {_TITLE} AS title, coalesce(n, 0) AS links
    FROM pages LEFT JOIN (SELECT page_id, count(*) AS n FROM ({HREFS}) GROUP BY 1) USING (page_id)""")
def envelope_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _results(spark, sf_dir)
    r = r.withColumn("fetched_at", F.lit(None).cast("timestamp")).withColumn("fetch_duration_ms", F.lit(0)).withColumn("extract_duration_ms", F.lit(0))
    env = sinks.envelope(r)
    e = env.select(F.from_json(sinks.jsonl_column(env), "_metadata struct<url:string,model:string,provider:string,retry_count:int>, data struct<title:string,links:array<string>>").alias("x"))
    return e.select("x._metadata.url", "x._metadata.model", "x._metadata.provider", "x._metadata.retry_count", T.collapse_spaces(F.col("x.data.title")).alias("title"), F.size("x.data.links").cast("long").alias("links"))


@query(f"SELECT url, strlen(trim({_TITLE})) > 0 AS has_title, contains(html, '<article>') AS has_article, {_TITLE} AS title FROM pages")
def training_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = sinks.training_pairs(_results(spark, sf_dir))
    title = T.collapse_spaces(F.get_json_object("output", "$.title"))
    return t.select("url", (F.length(title) > 0).alias("has_title"), F.col("input").contains("<article>").alias("has_article"), title.alias("title"))


_PROMPT = (schemas.PROMPT + "## Content Type\nA page\n\n## Fields to Extract\n- title (string, required)\n- links (array)\n").replace("'", "''")


@query(f"SELECT page_id, '{_PROMPT}' || chr(10) || '## Webpage Content' || chr(10) || '```' || chr(10) || txt || chr(10) || '```' || chr(10) AS prompt FROM ({CLEAN_TEXT})")
def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_table(spark, sf_dir).select("page_id", schemas.prompt(pages.clean_html(F.col("html"), output="text"), PAGE_SCHEMA).alias("prompt"))


@query("SELECT conv_id, turn, CASE (conv_id + turn) % 3 WHEN 2 THEN '``' || trim(text) ELSE trim(text) END AS record FROM conversations")
def answer_fences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts in fences with and without a language, and texts that only look like that."""
    which, t = (F.col("conv_id") + F.col("turn")) % 3, F.trim("text")
    a = F.when(which == 0, F.concat(F.lit(" ```json\n"), t, F.lit("\n```  "))).when(which == 1, F.concat(F.lit("```\n"), t, F.lit("```"))).otherwise(F.concat(F.lit("``"), t, F.lit(" ")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.strip_code_fence(a).alias("record"))


from tessera.plans import cases  # noqa: E402, F401  (registers its queries)
