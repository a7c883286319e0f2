"""Queries over small pages made from each row of ``pages``: every phase, renderer and rule
with the result that its definition gives, written out by hand.

``@@`` in a page and in its result stands for ``p`` and the page's id, so that no result
is a constant. The SQL of these queries is the list of written results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import cleaning, crawl, extract, pages, schemas
from tessera.operators.cleaning import Config
from tessera.plans.registry import ORACLES, QUERIES
from tessera.session import spread, table
from tessera.sources import sinks

MARK = "@@"


def literal(s: str | None) -> str:
    return "NULL" if s is None else "'" + s.replace("'", "''") + "'"


def made(spark: SparkSession, sf_dir: str, sources: list[str]) -> DataFrame:
    """(page_id, k, src): each source with each page's mark."""
    texts = spark.createDataFrame([(k, s) for k, s in enumerate(sources)], "k int, s string")
    # As many rows as cases are written here.
    p = table(spark, sf_dir, "pages").select("page_id").join(F.broadcast(texts))
    return spread(p.select("page_id", "k", F.replace("s", F.lit(MARK), F.concat(F.lit("p"), F.col("page_id").cast("string"))).alias("src")))


def expected(results: list[str | None], column: str = "out") -> str:
    rows = ", ".join(f"({k}, {literal(r)})" for k, r in enumerate(results))
    return f"SELECT page_id, k, replace(r, '{MARK}', 'p' || page_id) AS {column} FROM pages CROSS JOIN (VALUES {rows}) v(k, r)"


def cases(name: str, of, pairs: list[tuple[str, str | None]]) -> None:
    """Register ``name``: ``of`` (a column function) over the first of each pair gives the second."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return made(spark, sf_dir, [a for a, _ in pairs]).select("page_id", "k", of(F.col("src")).alias("out"))

    run.__name__ = name
    QUERIES[name], ORACLES[name] = run, expected([b for _, b in pairs])


def cleaned(**options):
    return lambda c: pages.clean_html(c, Config(**options))


def markdown(**options):
    return cleaned(output="markdown", **options)


# -- phases, as HTML
cases("phase_selectors", cleaned(remove=(".ad", "nav > a"), keep=(".keep",)), [
    ('<p>@@</p><div class="ad">x</div>', "<p>@@</p>"),
    ('<nav><a href="@@">x</a><b><a href="y">z</a></b></nav>', '<nav><b><a href="y">z</a></b></nav>'),
    ('<div class="ad keep">@@</div><div class="ad"><i class="keep">y</i></div>', '<div class="ad keep">@@</div>'),
])
cases("phase_scripts", cleaned(strip_scripts=True, keep=("script",)), [("<p>@@<script>if (a < b) {}</script></p>", "<p>@@</p>"), ("@@<style>p{}</style>", "@@<style>p{}</style>")])
cases("phase_styles", cleaned(strip_styles=True), [('<style>p{}</style><p style="color:red" id="@@">x</p>', '<p id="@@">x</p>'), ("<p><style>a</style>@@</p>", "<p>@@</p>")])
cases("phase_noscript", cleaned(strip_noscript=True, unwrap_noscript=True), [('<p>@@</p><noscript><img src="a.png"></noscript><p>b</p>', "<p>@@</p><p>b</p>")])
cases("phase_unwrap_noscript", cleaned(unwrap_noscript=True), [
    ('<div><noscript><img src="@@.png"></noscript></div>', '<div><img src="@@.png"/></div>'),
    ("<p>@@</p><noscript></noscript>", "<p>@@</p><noscript></noscript>"),
    ("<p>q</p><noscript><b>@@</b> and <i>y</i></noscript>", "<p>q</p><b>@@</b> and <i>y</i>"),
])
cases("phase_comments", cleaned(strip_comments=True), [("<p>a<!-- @@ -->b</p>", "<p>ab</p>"), ("<!-- 1 --><p>@@</p><!-- 2\n3 -->", "<p>@@</p>")])
cases("phase_svg", cleaned(strip_svg=True), [('<p>@@</p><svg><path d="M0"></path></svg>', "<p>@@</p>"), ("<a><svg><title>t</title></svg>@@</a>", "<a>@@</a>")])
cases("phase_iframes", cleaned(strip_iframes=True), [('<iframe src="x"></iframe><p>@@</p>', "<p>@@</p>")])
cases("phase_hidden", cleaned(strip_hidden=True), [
    ("<p hidden>x</p><p>@@</p>", "<p>@@</p>"), ('<p aria-hidden="true">x</p><p aria-hidden="false">@@</p>', '<p aria-hidden="false">@@</p>'),
    ('<p style="display: none">x</p><p style="display:block">@@</p>', '<p style="display:block">@@</p>'), ('<p style="visibility:hidden">x<b>y</b></p>@@', "@@"),
])
cases("phase_event_handlers", cleaned(strip_event_handlers=True), [('<p onclick="a()" onfoo="b()" id="@@">x</p>', '<p onfoo="b()" id="@@">x</p>'), ('<img src="@@" onload="x" onerror="y"/>', '<img src="@@"/>')])
_ATTRIBUTES = '<p data-x="1" aria-label="y" class="c" id="@@" itemprop="n" role="r">t</p>'
cases("phase_data_attributes", cleaned(strip_data_attributes=True), [(_ATTRIBUTES, '<p aria-label="y" class="c" id="@@" itemprop="n" role="r">t</p>')])
cases("phase_aria", cleaned(strip_aria=True), [(_ATTRIBUTES, '<p data-x="1" class="c" id="@@" itemprop="n" role="r">t</p>')])
cases("phase_classes_ids", cleaned(strip_classes=True, strip_ids=True, strip_microdata=True), [(_ATTRIBUTES, '<p data-x="1" aria-label="y" role="r">t</p>')])
cases("phase_link_density", cleaned(by_link_density=True, link_density=0.5), [
    ('<div><a href="#">aaaa</a> b</div><p>@@</p>', "<p>@@</p>"), ('<div><a href="#">aa</a> @@ and more</div>', '<div><a href="#">aa</a> @@ and more</div>'),
    ("<span><a>only spans stay @@</a></span>", "<span><a>only spans stay @@</a></span>"),
])
cases("phase_short_text", cleaned(short_text=True, min_text=20), [
    ("<p>short</p><p>this one is long enough, @@</p>", "<p>this one is long enough, @@</p>"), ('<div>x<img src="@@"/></div>', '<div>x<img src="@@"/></div>'),
    ("<p></p><b>@@</b>", "<p></p><b>@@</b>"),
])
cases("phase_empty", cleaned(strip_empty=True), [
    ("<div><p></p></div><p>@@</p>", "<p>@@</p>"), ("<div><div><div><div><i></i></div></div></div></div>@@", "<div><div></div></div>@@"), ('<p>@@</p><img src="a"/><br/><hr/>', '<p>@@</p><img src="a"/><br/><hr/>'),
])
cases("phase_srcset", cleaned(strip_srcset=True), [
    ('<img src="@@.jpg" srcset="a.jpg 320w, b.jpg 640w" sizes="(max-width: 600px) 320px" alt="test">', '<img src="@@.jpg" alt="test"/>'),
    ('<picture><source srcset="@@ 1x" type="t"><img src="i"></picture>', '<picture><source type="t"/><img src="i"/></picture>'),
])
cases("phase_tracking", cleaned(tracking_params=True), [
    ('<a href="https://e.com/@@?utm_source=g&utm_medium=c&id=123">L</a>', '<a href="https://e.com/@@?id=123">L</a>'), ('<a href="https://e.com/?fbclid=a&name=@@">L</a>', '<a href="https://e.com/?name=@@">L</a>'),
    ('<img src="/i.png?gclid=1#@@">', '<img src="/i.png#@@"/>'), ('<a href="/@@?UTM_Any=1">L</a>', '<a href="/@@">L</a>'),
])
cases("phase_repeated_links", cleaned(repeated_links=True), [
    ('<a href="https://e.com/@@">First</a> <a href="https://e.com/@@">Second</a> <a href="https://e.com/o">Other</a>', '<a href="https://e.com/@@">First</a> Second <a href="https://e.com/o">Other</a>'),
    ('<a href="/@@">a</a><a href="/@@#x">b <i>c</i></a><a href="#">d</a><a href="#">e</a>', '<a href="/@@">a</a>b c<a href="#">d</a><a href="#">e</a>'),
])
cases("phase_deduplicate", cleaned(dedupe=True, min_duplicate=15), [
    ("<p>This is unique @@.</p><p>Read more about it @@</p><p>This is unique @@.</p><p>Read more about it @@</p>", "<p>This is unique @@.</p><p>Read more about it @@</p>"),
    ("<p>Short</p><p>Short</p>@@", "<p>Short</p><p>Short</p>@@"), ("<b>in a bold twice, @@</b><b>in a bold twice, @@</b>", "<b>in a bold twice, @@</b><b>in a bold twice, @@</b>"),
])
cases("phase_boilerplate", cleaned(boilerplate=True), [
    ("<p>Copyright 2024 Acme</p><p>@@</p>", "<p>@@</p>"), ("<footer>All rights reserved.</footer>@@", "@@"), ("<small>Powered by Foo</small><div>Powered by Foo and @@</div>", "<div>Powered by Foo and @@</div>"),
    ("<p>© 2020</p><p>Privacy Policy | Terms</p><h1>Copyright 2024</h1>@@", "<h1>Copyright 2024</h1>@@"),
])
cases("phase_elements_kept", lambda c: pages.clean_stats(c, Config(strip_scripts=True))["elements_kept"].cast("string"), [("<p>@@<b>x</b></p><script></script>", "5"), ("", "3"), ("<ul><li>@@<li>y</ul>", "6")])

# -- renderers
cases("html_output", cleaned(), [
    ("<p title='a\"b&amp;@@'>x &lt; y &amp; z &gt; w</p>", '<p title="a&#34;b&amp;@@">x &lt; y &amp; z &gt; w</p>'), ("a<br>b<hr><input disabled>@@", 'a<br/>b<hr/><input disabled=""/>@@'),
    ("<p>one<p>two @@", "<p>one</p><p>two @@</p>"), ("<b><i>x</b>y</i>@@", "<b><i>x</i></b><i>y</i>@@"), ("<table><tr><td>@@</table>", "<table><tbody><tr><td>@@</td></tr></tbody></table>"),
    ("<p>caf&eacute; &nbsp;&#64; @@</p>", "<p>café  @ @@</p>"),
])
cases("html_output_default", lambda c: pages.clean_html(c, "default"), [
    ("  <div>\n  <p>@@</p>\n\n <script>x</script> <!-- c --> </div>  ", "<div> <p>@@</p> </div>"),
    ('<p data-a="1" onclick="x" style="color:red" class="k">@@</p><div class="ad">x</div><iframe></iframe>', '<p class="k">@@</p>'),
])
cases("html_output_minimal", lambda c: pages.clean_html(c, "minimal"), [('<p class="ad" style="x">a  b\n@@</p><script>s</script>', '<p class="ad">a b @@</p>'), ('<img src="@@" srcset="b 1x">', '<img src="@@" srcset="b 1x"/>')])
cases("text_output", cleaned(output="text", collapse=True, trim=True), [("<h1>A</h1><p>b  c</p><p>@@</p>", "Ab c@@"), ("<p> a &amp; @@ </p>", "a & @@")])
cases("markdown_inline", markdown(trim=True), [
    ("<h1>Title @@</h1><p>Hello <strong>world</strong></p>", "# Title @@\n\nHello**world**"), ("<p><em>a</em></p><p><code>@@</code></p>", "*a*\n\n`@@`"),
    ("<p>a<br>@@</p>", "a\n@@"), ("<p>a</p><hr><p>@@</p>", "a\n\n---\n\n@@"), ('<p><a href="/@@">x</a></p>', "[x](/@@)"), ('<p><a href="javascript:x">y @@</a></p>', "y @@"),
    ("<h6>@@</h6>", "###### @@"), ("<p>a</p><form>f</form><nav>n</nav><button>b</button><p>@@</p>", "a\n\n@@"),
])
cases("markdown_blocks", markdown(trim=True), [
    ("<ul><li>a</li><li>@@</li></ul>", "- a\n- @@"), ("<ol><li>a</li><li>@@</li></ol>", "1. a\n2. @@"), ("<blockquote><p>a</p><p>@@</p></blockquote>", "> a\n>\n> @@"),
    ("<pre>x = 1\ny = @@</pre>", "```\nx = 1\ny = @@\n```"), ("<dl><dt>t</dt><dd>@@</dd></dl>", "**t**\n: @@"),
])
cases("markdown_tables", markdown(trim=True), [
    ("<table><thead><tr><th>A</th><th>B</th></tr></thead><tbody><tr><td>@@</td><td>2</td></tr></tbody></table>", "| A | B |\n| --- | --- |\n| @@ | 2 |"),
    ("<p>x</p><table><tr><th>A</th></tr><tr><td>@@</td></tr></table>", "x\n\n| A |\n| --- |\n| @@ |"),
])
cases("markdown_images", markdown(trim=True), [
    ('<p><img src="@@.jpg" alt="Test"></p>', "![Test](@@.jpg)"), ('<p>@@<img src="data:image/png;base64,x"></p>', "@@"), ('<p><img data-src="@@.png" alt="L"></p>', "![L](@@.png)"),
    ('<p><img srcset="@@-1.png 1x, @@-2.png 2x" alt="S"></p>', "![S](@@-1.png)"), ('<p>@@<img src="/pixel.gif" alt="n"></p>', "@@"), ('<p><img src="//c.com/@@" alt=""></p>', "![](https://c.com/@@)"),
])
cases("markdown_frontmatter", markdown(trim=True, frontmatter=True, images=True, headings=True), [
    (
        '<h1>Title</h1><img src="@@.jpg" alt="Test &quot;I&quot;"><h2>Sub</h2><p><a href="x">C</a></p>',
        '---\n# Content Metadata\n# Images are referenced in the body as {{IMG_001}}, {{IMG_002}}, etc.\n# Use this map to look up the actual URL and description for each placeholder.\nimages:\n  IMG_001:\n    url: "@@.jpg"\n    alt: "Test \\"I\\""\n\n'
        'headings:\n  - level: 1\n    text: "Title"\n  - level: 2\n    text: "Sub"\n\nlinks_count: 1\n---\n\n# Title\n\n{{IMG_001}}\n\n## Sub\n\n[C](x)',
    ),
])
cases("resolved_urls", markdown(trim=True, resolve_urls=True, base_url="https://example.com/a/b"), [
    ('<p><a href="/@@">L</a></p>', "[L](https://example.com/@@)"), ('<p><a href="@@">L</a></p>', "[L](https://example.com/a/@@)"), ('<p><img src="../@@.jpg" alt="i"></p>', "![i](https://example.com/@@.jpg)"),
    ('<p><a href="//c.com/@@">L</a></p>', "[L](https://c.com/@@)"), ('<p><a href="https://o.com/@@">L</a></p>', "[L](https://o.com/@@)"),
])
cases("cleaner_chain", lambda c: pages._column("string", cleaning.Chain(lambda h: cleaning.clean(h, Config(strip_scripts=True)).content, lambda h: cleaning.clean(h, Config(output="text", trim=True)).content, cleaning.noop), c), [("<script>x</script><p>@@</p>", "@@")])

# -- links and pagination
_BASE = "https://example.com/current/"
cases("next_page", lambda c: pages.find_next_page(c, F.lit(_BASE), "a.next"), [
    ('<a href="next-@@" class="next">N</a>', "https://example.com/current/next-@@"), ('<a href="#next" class="next">N</a>@@', None), ('<a href="javascript:m()" class="next">@@</a>', None), ('<a href="" class="next">@@</a>', None),
    ('<a href="/first-@@" class="next">1</a><a href="/second" class="next">2</a>', "https://example.com/first-@@"), ('<nav><a href="/prev" class="prev">@@</a></nav>', None),
])
cases("link_rules", lambda c: F.array_join(pages.extract_links(c, F.lit(_BASE), pages.selector_list("a.x,\n\n  nav a ,"), "^https://"), " "), [
    ('<a class="x" href="/@@#f">1</a><a href="/no">2</a><nav><a href="b?c=@@">3</a></nav>', "https://example.com/@@ https://example.com/current/b?c=@@"),
    ('<a class="x" href="http://o.com/@@">1</a><a class="x" href="javascript:y">2</a><a class="x" href="/@@">3</a><a class="x" href="/@@#g">4</a>', "https://example.com/@@"),
])


def paginate_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three pages of each of the first ten hosts' lists, each with the next one's link, and the real crawl loop over them."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("n"))
    p = n.select("n", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("i"))
    url = F.concat(F.lit("https://h"), F.col("n").cast("string"), F.lit(".com/list?page="), F.col("i").cast("string"))
    link = F.when(F.col("i") < 3, F.concat(F.lit('<a class="next" href="?page='), (F.col("i") + 1).cast("string"), F.lit('">next</a>'))).otherwise("")
    snap = p.select(url.alias("url"), F.concat(F.lit("<p>"), F.repeat(F.lit("words of the list "), 20), F.lit("</p>"), link).alias("html"))
    seeds = [f"https://h{k}.com/list?page=1" for k in range(25)]
    out = crawl.crawl(seeds, snap, crawl.CrawlConfig(next_selector="a.next"))
    return out.select("url", "depth", F.col("seq").cast("int").alias("seq"), F.col("error").isNull().alias("ok"), "extract")


QUERIES["paginate_chain"] = paginate_chain
ORACLES["paginate_chain"] = (
    "SELECT 'https://h' || n_nationkey || '.com/list?page=' || i AS url, 0 AS depth, CAST((i - 1) * 25 + n_nationkey + 1 AS INTEGER) AS seq, true AS ok, true AS extract "
    "FROM nation CROSS JOIN (VALUES (1), (2), (3)) v(i)"
)


def crawl_follow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The crawl loop over nations, their customers, and pages that aren't there or have too little text."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    top = c.groupBy(F.col("c_nationkey").alias("n")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("c_custkey")), lambda k: F.concat(F.lit('<a href="/c/'), k.cast("string"), F.lit('">x</a>'))), "").alias("l"))
    host = F.lit("https://h.com")
    lists = top.select(F.concat(host, F.lit("/n/"), F.col("n").cast("string")).alias("url"), F.concat(F.col("l"), F.lit('<a href="https://other.com/x">o</a>')).alias("html"))
    text = F.when(F.col("c_custkey") % 3 == 0, F.lit("<p>short</p>")).otherwise(F.concat(F.lit("<p>"), F.repeat(F.lit("long enough "), 30), F.lit('</p><a href="/too/deep">d</a>')))
    ones = c.filter("c_custkey % 5 <> 0").select(F.concat(host, F.lit("/c/"), F.col("c_custkey").cast("string")).alias("url"), text.alias("html"))
    out = crawl.crawl([f"https://h.com/n/{k}" for k in range(25)], spread(lists.unionByName(ones)), crawl.CrawlConfig(follow_selector="a[href]", max_depth=1))
    return out.select("url", "depth", "error", "extract")


QUERIES["crawl_follow"] = crawl_follow
ORACLES["crawl_follow"] = """
SELECT 'https://h.com/n/' || n_nationkey AS url, 0 AS depth, CASE WHEN n_nationkey NOT IN (SELECT c_nationkey FROM customer) THEN 'fetch error: not in the snapshot' END AS error, false AS extract FROM nation
UNION ALL SELECT 'https://h.com/c/' || c_custkey, 1, CASE WHEN c_custkey % 5 = 0 THEN 'fetch error: not in the snapshot' WHEN c_custkey % 3 = 0 THEN 'insufficient content' END, true FROM customer"""

# -- schemas and records
SHOP = schemas.Schema("shop", "A shop", (
    schemas.Field("name", "string", required=True, description="Its name"), schemas.Field("stars", "number"), schemas.Field("open", "boolean"),
    schemas.Field("tags", "array", items=schemas.Field(type="string")), schemas.Field("at", "object", properties=(schemas.Field("city", "string"),)),
))
cases("validate_types", lambda c: F.array_join(F.transform(SHOP.errors(F.try_parse_json(c)), lambda e: F.concat(e["field"], F.lit(": "), e["message"])), "; "), [
    ('{"name": "@@", "stars": 1.5, "open": true, "tags": ["a"], "at": {"city": 3}}', ""), ('{"stars": "@@"}', "name: required field is missing; stars: expected number, got string"),
    ('{"name": "@@", "open": "yes", "tags": {"a": 1}}', "open: expected boolean, got string; tags: expected array, got object"), ('{"name": "@@", "at": [1]}', "at: expected object, got array"),
    ('{"name": null, "x": "@@"}', "name: value is null but field is required"),
])
cases("output_json", lambda c: F.to_json(F.struct(c.alias("a"), F.lit(None).cast("int").alias("b"), F.array(F.lit(1), F.lit(None)).alias("c")), {"ignoreNullFields": "false"}), [("@@", '{"a":"@@","b":null,"c":[1,null]}'), ('"@@"', '{"a":"\\"@@\\"","b":null,"c":[1,null]}')])


def output_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines that the JSON lines sink writes for records with metadata."""
    p = table(spark, sf_dir, "pages").select("url", "page_id", (F.col("page_id") % 3).cast("int").alias("retry_count"))
    data = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit('{"id":'), F.col("page_id").cast("string"), F.lit(',"none":null}'))).otherwise(F.concat(F.lit("["), F.col("page_id").cast("string"), F.lit("]")))
    r = p.select("url", F.lit(None).cast("timestamp").alias("fetched_at"), F.lit("m").alias("model"), F.lit(None).cast("string").alias("provider"), F.lit(1).alias("input_tokens"), F.col("page_id").alias("output_tokens"), F.lit(0).alias("fetch_duration_ms"), F.lit(2).alias("extract_duration_ms"), "retry_count", F.lit(None).cast("string").alias("error"), data.alias("data"))
    env = sinks.envelope(r)
    return env.select(sinks.jsonl_column(env).alias("line"))


QUERIES["output_envelopes"] = output_envelopes
ORACLES["output_envelopes"] = """
SELECT '{"_metadata":{"url":' || to_json(url) || ',"fetched_at":null,"model":"m","provider":null,"input_tokens":1,"output_tokens":' || page_id || ',"fetch_duration_ms":0,"extract_duration_ms":2'
  || CASE WHEN page_id % 3 = 0 THEN '' ELSE ',"retry_count":' || (page_id % 3) END || '},"data":' || CASE WHEN page_id % 2 = 0 THEN '{"id":' || page_id || ',"none":null}' ELSE '[' || page_id || ']' END || '}' AS line FROM pages"""

# -- extraction
WORDS = schemas.Schema("w", "", (schemas.Field("w", "string", required=True),))


def _outcome(extractor: extract.Extractor):
    """An extraction of a row's text as one line: record, retries, tokens, or the error."""

    def one(content: str) -> str:
        try:
            r = extractor.extract(content, WORDS)
        except extract.ExtractError as e:
            return f"error: {e}"
        return f"{r.data} {r.provider} retries {r.retry_count} tokens {r.input_tokens}/{r.output_tokens}"

    return lambda c: pages._column("string", one, c)


def _model(name: str, *answers: str | Exception, ready: bool = True, retries: int = 3) -> extract.ModelExtractor:
    """A model that gives these answers in turn; %s stands for the content."""

    def call(request: extract.Call) -> extract.Answer:
        a = answers[min(request.attempt, len(answers) - 1)]
        if isinstance(a, Exception):
            raise a
        content = request.prompt.rpartition("```\n")[0].rpartition("```\n")[2].strip()
        return extract.Answer(content=a.replace("%s", content), input_tokens=10, output_tokens=1)

    return extract.ModelExtractor(name, call, max_retries=retries, ready=ready)


cases("extract_first_try", _outcome(_model("m", '{"w": "%s"}')), [("@@", "{'w': '@@'} m retries 0 tokens 10/1")])
cases("extract_retried_after_errors", _outcome(_model("m", "{}", '{"w": 1}', '```json\n{"w": "%s"}\n```')), [("@@", "{'w': '@@'} m retries 2 tokens 30/3")])
cases("extract_retried_after_rate_limit", _outcome(_model("m", RuntimeError("rate limit"), RuntimeError("HTTP 429"), '{"w": "%s"}')), [("@@", "{'w': '@@'} m retries 2 tokens 10/1")])
cases("extract_not_retried", _outcome(_model("m", RuntimeError("bad key"), '{"w": "%s"}')), [("@@", "error: extraction failed after 4 attempts: bad key")])
cases("extract_gives_up", _outcome(_model("m", "{}", retries=1)), [("@@", "error: extraction failed after 2 attempts: w: required field is missing")])
cases("extract_fallback", _outcome(extract.Fallback((_model("a", '{"w": "no"}', ready=False), _model("b", RuntimeError("down")), _model("c", '{"w": "%s"}')))), [("@@", "{'w': '@@'} c retries 0 tokens 10/1")])
