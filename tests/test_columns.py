import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions import url as U
from tessera.operators import costs, crawl, extract, pages, relational, schemas
from tessera.operators.cleaning import clean


def one(spark, fn, values, kind="string"):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}")
    return [r[1] for r in sorted(df.select("k", fn(F.col("v"))).collect())]


def test_normalize(spark):
    pairs = [("http://a/b#c", "http://a/b"), ("http://a/b#", "http://a/b"), ("http://a/b/", "http://a/b"), ("http://a/", "http://a/"), ("http://A/b//", "http://A/b/"), ("://invalid", ""), ("http://a/b/?x=1/", "http://a/b?x=1/"), (None, None)]
    assert one(spark, U.normalize, [a for a, _ in pairs]) == [b for _, b in pairs]


def test_same_domain(spark):
    df = spark.createDataFrame([("http://a.b/x", "https://a.b/y", True), ("http://a.b", "http://www.a.b", False), ("http://a:1/", "http://a:2/", False), ("http://u:p@a/", "http://a/", True), ("::", "http://a", False)], "a string, b string, want boolean")
    assert df.filter(U.same_domain(F.col("a"), F.col("b")) != F.col("want")).count() == 0


def test_plain_links_equal_parsed_ones(spark):
    """What a pattern tells of URLs is what parsing them tells; levels without order need neither paths nor places."""
    urls = ["http://h/a", "https://h/b/c", "http://h", "http://h/", "http://h/a/", "http://h//a", "http://h:1/a", "http://h:/a", "http://hh/a", "http://h/a#f", "http://h/a#b#c", "http://h/a\n", "http://u@h/a", "http://h/é", "http://h/a?x", "//h:80/a", "::", "/a", "", "http://h/a http://h/a", None]
    df = spark.createDataFrame([(a, b) for a in urls for b in urls], "src string, dst string").cache()
    src, dst = F.col("src"), F.col("dst")
    slow = F.coalesce(U.same_domain(U._normalize(src), dst) & (U._normalize(dst) != ""), F.lit(False))
    assert df.filter(~U.normalize(src).eqNullSafe(U._normalize(src))).count() == 0
    assert df.filter(slow != F.coalesce(U.leads_on(src, dst), F.lit(False))).count() == 0 and df.filter(slow).count() > 40
    assert df.filter(U.leads_on(src, dst, False)).count() == df.filter(U._normalize(dst) != "").count()


def test_levels_without_order(spark):
    e = spark.createDataFrame([("http://h/a", "http://h/b", 1), ("http://h/a/", "http://h/c#x", 0), ("http://h/b", "http://h/c", 0), ("http://h/c", "http://o/d", 0), ("http://h/c", "http://h/a", 1), ("http://h/c", "http://h/e/", 2), ("http://h/e", "http://h/f", 0)], "src string, dst string, pos int")
    seeds = spark.createDataFrame([("http://h/a#", 0), ("http://h/a", 1), ("::", 2)], "url string, seq int")
    ordered = crawl.levels(seeds, e, max_depth=2)
    assert [(r.url[-1], r.depth) for r in ordered.orderBy("seq").collect()] == [("a", 0), ("c", 1), ("b", 1), ("e", 2)]
    plain = crawl.levels(seeds, e, max_depth=2, numbered=False)
    assert sorted(map(tuple, plain.collect())) == sorted((r.url, r.depth) for r in ordered.collect())
    assert {r.url for r in crawl.levels(seeds, e, max_depth=2, max_urls=2, numbered=False).collect()} == {"http://h/a", "http://h/c"}
    kept = []
    made, crawl.written = crawl.written, lambda df, name: kept.append((name, df.columns)) or made(df, name)
    try:
        crawl.levels(seeds, e, max_depth=1, numbered=False)
    finally:
        crawl.written = made
    assert kept == [("edges", ["src", "dst"]), ("level-0", ["url"]), ("level-1", ["url"])]


URLS = ["/x?utm_source=1&a=2&GCLID=3#f?x", "/x", "/x?", "/x?&&b&ref=1", "/x#f?utm_id=1", "a?UTM_any=1", "?a=b&a=b"]


def test_tracking_column_equals_kernel(spark):
    assert one(spark, U.strip_tracking_params, URLS) == [U.strip_tracking(u) for u in URLS]


@pytest.mark.parametrize("base, ref, want", [("http://h/a/b", "../c d", "http://h/c%20d"), ("http://h/a", "é,x", "http://h/%C3%A9,x"), ("http://h/a", "?q", "http://h/a?q"), ("http://h/a", "http://o/#x", "http://o/#x"), ("http://h/a/", "//o/p", "http://o/p")])
def test_resolve(base, ref, want):
    assert U.resolve(base, ref) == want


def test_url_patterns():
    assert U.checked_pattern("a|b+")
    for bad in (r"(?=x)", r"(a)\1", "(?<!b)a"):
        with pytest.raises(ValueError):
            U.checked_pattern(bad)


TEXTS = ["", " a ", "a 　b", "\x0b x\x1c", "a\n\n\n\nb", "Copyright © 2024", "all rights reserved", "ALL RIGHTS RESERVED!", "powered by x_1", "privacy policy • terms"]


def test_text_columns_equal_kernel(spark):
    assert one(spark, T.trim_text, TEXTS) == [T.trim(t) for t in TEXTS]
    assert one(spark, T.collapse_spaces, TEXTS) == [T.collapse(t) for t in TEXTS]
    assert one(spark, T.join_fields, TEXTS) == [" ".join(T.fields(t)) for t in TEXTS]
    assert one(spark, T.boilerplate, TEXTS) == [T.is_boilerplate(t) for t in TEXTS]
    assert one(spark, T.collapse_blank_lines, ["a\n\n\n\nb\n\nc"]) == ["a\n\nb\n\nc"]


def test_truncate(spark):
    assert one(spark, lambda c: T.truncate_bytes(c, 4), ["abcd", "abcde", "aéé", "aéée", "ab日", "😀x", "", None]) == ["abcd", "abcd" + T.TRUNCATED, "aé" + T.TRUNCATED, "aé" + T.TRUNCATED, "ab" + T.TRUNCATED, "😀" + T.TRUNCATED, "", None]
    assert one(spark, lambda c: T.truncate_bytes(c, 0), ["abc"]) == ["abc"] and extract.cut("aéé", 4) == "aé" + T.TRUNCATED


FENCES = ['```json\n{"a":1}\n```', "```\nx```  ", "x", " ``` ", "`` x"]


def test_fences(spark):
    assert one(spark, T.strip_code_fence, FENCES) == [extract.strip_fence(f) for f in FENCES]


def test_challenges(spark):
    df = spark.createDataFrame([("Just a Moment...", "", "cloudflare"), ("", "<div class=cf-turnstile>", "cloudflare-turnstile"), ("", "h-captcha", "hcaptcha"), ("", "G-Recaptcha", "recaptcha"), ("Blocked", "", "anti-bot"), (None, None, "")], "t string, h string, want string")
    assert df.filter(pages.challenge_class(F.col("t"), F.col("h")) != F.col("want")).count() == 0


# -- schemas
S = schemas.Schema.of({
    "name": "x", "description": "d",
    "fields": {
        "a": {"type": "string", "required": True, "description": "an a"}, "i": {"type": "integer"}, "n": {"type": "number"}, "b": {"type": "boolean"},
        "l": {"type": "array", "items": {"type": "array", "items": {"type": "number"}}}, "o": {"properties": [{"required": True, "name": "p", "type": "string"}], "type": "object"}, "u": {"type": "odd"},
    },
})
RECORDS = [
    '{"a": "x"}', "{}", '{"a": null}', '{"a": 1, "i": 1.5, "n": 2, "b": true}', '{"a": "x", "i": "1", "n": "2", "b": 0, "l": 3, "o": [], "u": 9}', '{"a": "x", "l": [[1], [2, "3"]], "o": {"q": 1}}',
    '{"a": "x", "i": true, "n": null, "l": [null, 3]}', "[1]", "null",
]


def test_validation_columns_equal_kernel(spark):
    import json

    got = one(spark, lambda c: S.errors(F.try_parse_json(c)), RECORDS)
    assert [[tuple(e) for e in g] for g in got] == [S.validate(json.loads(r)) for r in RECORDS]
    assert [tuple(e) for e in got[5]] == [("l", "item 1: item 1: expected number, got string")]


def test_json_schema_and_prompt():
    j = S.json_schema()
    assert j["required"] == ["a"] and j["additionalProperties"] is False and j["properties"]["o"]["required"] == ["p"] and j["properties"]["l"]["items"]["items"] == {"type": "number"}
    assert "- a (string, required): an a\n" in S.prompt_description() and "- o (object)\n  - p (string, required)\n" in S.prompt_description()
    for form in ("json", "yaml"):
        assert schemas.Schema.loads(S.dumps(form), form) == S
    with pytest.raises(ValueError):
        schemas.Schema.load("x.toml")
    assert "`l` ARRAY<ARRAY<DOUBLE>>" in S.ddl() and "`o` STRUCT<`p`: STRING>" in S.ddl()


def test_reflection():
    from dataclasses import dataclass, field

    @dataclass
    class In:
        x: int

    @dataclass
    class Out:
        title: str = field(metadata={"name": "t", "validate": "required,min=2", "examples": "a,b"})
        price: float | None
        tags: list[str]
        inner: In
        more: dict
        _hidden: str

    s = schemas.Schema.reflect(Out)
    assert [(f.name, f.type, f.required) for f in s.fields] == [("t", "string", True), ("price", "number", False), ("tags", "array", True), ("inner", "object", True), ("more", "object", True)]
    assert s.fields[0].rules == ("required", "min=2") and s.fields[3].properties[0].name == "x"
    with pytest.raises(TypeError):
        schemas.Schema.reflect(int)


def test_rules(spark):
    got = one(spark, lambda c: schemas.rule_errors(("required", "min=3", "email"), c, "string"), ["", "a@b.c", "abcd", None])
    assert got == [["is required", "must be at least 3", "must be a valid email address"], [], ["must be a valid email address"], ["is required"]]


# -- extraction
ONE = schemas.Schema("x", "", (schemas.Field("a", "string", required=True),))


def scripted(*answers):
    seen = []

    def call(c):
        seen.append(c)
        a = answers[min(len(seen), len(answers)) - 1]
        if isinstance(a, Exception):
            raise a
        return extract.Answer(a, 10, 2, "m", "stop", "g")

    return extract.ModelExtractor("p", call), seen


def test_retries():
    e, seen = scripted('{"b": 1}', "```json\n{\"a\": \"x\"}\n```")
    r = e.extract("c", ONE)
    assert (r.data, r.retry_count, r.input_tokens, r.output_tokens) == ({"a": "x"}, 1, 20, 4) and "a: required field is missing" in seen[1].prompt
    e, seen = scripted(RuntimeError("HTTP 429"), '{"a": "x"}')
    assert e.extract("c", ONE).retry_count == 1
    e, seen = scripted(RuntimeError("no"))
    with pytest.raises(extract.ExtractError):
        e.extract("c", ONE)
    assert len(seen) == 1
    e, seen = scripted('{"a": 1}')
    with pytest.raises(extract.ExtractError) as x:
        e.extract("c", ONE)
    assert len(seen) == 4 and x.value.result.input_tokens == 40


def test_fallback_and_pipeline():
    bad, _ = scripted(RuntimeError("no"))
    good, _ = scripted('{"a": "x"}')
    off, _ = scripted('{"a": "z"}')
    off.ready = False
    assert extract.Fallback((off, bad, good)).extract("c", ONE).data == {"a": "x"}
    with pytest.raises(extract.ExtractError, match="tried: p"):
        extract.Fallback((off, bad)).extract("c", ONE)
    with pytest.raises(extract.NoneAvailable):
        extract.Fallback((off,)).extract("c", ONE)
    r = extract.Pipeline((good, off, good)).extract("c", ONE)
    assert r.input_tokens == 20 and r.provider == "pipeline(p->p->p)" and extract.Pipeline((off,)).extract("c", ONE) is None
    assert extract.detect({}) == "ollama" and extract.create("rules", {"a": "p"}).name == "rules"


# -- crawl, nodes, streams, sinks
SITE = {
    "http://h/": "<a class=p href=/a>1</a><a class=p href='/b#x'>2</a><a class=p href='http://o/z'>3</a><a class=n href='/2'>n</a>" + "<p>text</p>" * 50,
    "http://h/a": "<a class=p href=/c>1</a><a class=p href=/>0</a>" + "<p>a</p>" * 200,
    "http://h/b": "tiny",
    "http://h/c": "<p>c</p>" * 200,
    "http://h/2": "<a class=p href=/a>again</a><a class=n href=/3>n</a>" + "<p>2</p>" * 200,
}


def test_crawl(spark):
    p = spark.createDataFrame(list(SITE.items()), "url string, html string")
    got = {r.url: (r.depth, r.error) for r in crawl.crawl(["http://h/"], p, crawl.CrawlConfig(follow_selector="a.p", next_selector="a.n", max_depth=2)).collect()}
    assert got == {"http://h/": (0, None), "http://h/a": (1, None), "http://h/b": (1, "insufficient content"), "http://h/2": (0, None), "http://h/c": (2, None), "http://h/3": (0, "fetch error: not in the snapshot")}
    few = crawl.crawl(["http://h/"], p, crawl.CrawlConfig(follow_selector="a.p", max_depth=2, max_urls=2, same_domain=False)).collect()
    assert [r.url for r in sorted(few, key=lambda r: r.seq)] == ["http://h/", "http://h/a"]
    top = crawl.crawl(["http://h/"], p, crawl.CrawlConfig(next_selector="a.n", max_pages=2)).collect()
    assert {r.url for r in top} == {"http://h/", "http://h/2"}


def test_links(spark):
    html = "<a href=/a>x</a><a href='b?q#f'>x</a><a href='#t'>x</a><a href='javascript:x'>x</a><a href=''>x</a><a>x</a><a href=/a#z>x</a><a href='http://o/%zz'>x</a><a rel=next href='p2#k'>n</a>"
    p = spark.createDataFrame([(html, "http://h/d/e")], "html string, url string")
    r = p.select(pages.extract_links(F.col("html"), F.col("url")).alias("l"), pages.extract_links(F.col("html"), F.col("url"), "a", "q$").alias("m"), pages.find_next_page(F.col("html"), F.col("url"), "[rel=next]").alias("n")).first()
    assert r.l == ["http://h/a", "http://h/d/b?q", "http://h/d/p2"] and r.m == ["http://h/d/b?q"] and r.n == "http://h/d/p2#k"
    assert pages.selector_list("a.x\n\n .y,\n") == "a.x, .y"


HTML = [
    "<nav><a href=1>one link</a></nav><p>a text that is long enough <b>x</p><p>short</p><div>the same long text</div><div>the same long text</div><p>Copyright 2024</p>",
    "<div><p>short</p><ul><li>a</ul></div><a href=/a>x</a><a href='/a#b'>y</a><p hidden>z</p><script>s</script>",
]


@pytest.mark.parametrize(
    "changes, matches",
    [
        ({"short_text": True, "min_text": 20}, lambda n: relational.short_text_matches(n, 20)), ({"dedupe": True}, relational.duplicate_matches), ({"boilerplate": True}, relational.boilerplate_matches),
        ({"by_link_density": True}, lambda n: relational.link_density(n).filter("density > 0.5")), ({"strip_scripts": True}, lambda n: relational.tag_matches(n, "script")), ({"strip_hidden": True}, relational.hidden_matches),
    ],
)
def test_relational_phases_equal_kernel(spark, changes, matches):
    from tessera.operators.cleaning import Config

    p = spark.createDataFrame(list(enumerate(HTML)), "page_id long, html string")
    nodes = pages.dom_nodes(p).cache()
    found = matches(nodes)
    got = {r.page_id: r.text for r in relational.page_texts(relational.drop_subtrees(nodes, found)).collect()}
    many = {r.page_id: r["count"] for r in found.groupBy("page_id").count().collect()}
    for k, h in enumerate(HTML):
        r = clean(h, Config(output="text", collapse=True, **changes))
        assert got.get(k, "") == r.content and many.get(k, 0) == sum(x.removed for x in r.stats.phases)


def test_nodes_come_in_small_batches():
    import pyarrow as pa

    html = ["<p>x</p>" * 1000] * 90 + [None, ""]
    got = list(pages.node_batches(iter([pa.RecordBatch.from_pydict({"page_id": pa.array(range(92), pa.int64()), "html": pa.array(html)})])))
    assert max(b.num_rows for b in got) < pages.NODES_HELD + 2100 and len(got) > 9
    want = [{"page_id": k} | n for k, h in enumerate(html) if h is not None for n in pages.node_rows(h)]
    assert [r for b in got for r in b.to_pylist()] == want


def test_results_of_a_batch_are_not_held_at_once(spark):
    held = []

    def one(h):
        import weakref

        class Result(dict):
            pass

        held.append(weakref.ref(r := Result(size=len(h))))
        r["n"] = sum(x() is not None for x in held)
        return r

    df = spark.range(40, numPartitions=1).select(F.when(F.col("id") != 7, F.repeat(F.lit("x"), F.lit(1 << 18))).alias("h"))
    got = [r.x for r in df.select(pages._column("struct<size:int,n:int>", one, F.col("h")).alias("x")).collect()]
    assert [k for k, x in enumerate(got) if x is None] == [7] and {x["size"] for x in got if x} == {1 << 18}
    assert max(x["n"] for x in got if x) <= 8


def test_sinks(spark, tmp_path):
    from tessera.sources import sinks

    assert sinks.json_text([{"a": 1}], pretty=False) == '{"a":1}\n' and sinks.json_text([]) == "[]\n" and sinks.yaml_text([{"b": 1, "a": [2]}]) == "b: 1\na:\n- 2\n"
    df = spark.createDataFrame([(1, "é"), (2, None)], "a int, b string")
    sinks.write(df, f"{tmp_path}/x.json", "json", pretty=False)
    assert open(f"{tmp_path}/x.json", encoding="utf-8").read() == '[{"a":1,"b":"é"},{"a":2,"b":null}]\n'
    sinks.write(df, f"{tmp_path}/x.jsonl", "jsonl")
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/x.jsonl").collect()) == ['{"a":1,"b":"é"}', '{"a":2,"b":null}']
    sinks.write(df, f"{tmp_path}/x.yaml", "yaml")
    assert open(f"{tmp_path}/x.yaml", encoding="utf-8").read() == "- a: 1\n  b: é\n- a: 2\n  b: null\n"
    import json

    for items in ([], [{"a": [1, {"b": None}]}], [{"a": "x\ny"}, [], {}, 3], [1, 2]):
        for pretty in (True, False):
            want = json.dumps(items[0] if len(items) == 1 else items, indent=2, ensure_ascii=False) if pretty else json.dumps(items[0] if len(items) == 1 else items, ensure_ascii=False, separators=(",", ":"))
            assert sinks.json_text(items, pretty) == want + "\n"
    with pytest.raises(ValueError):
        sinks.write(df, "x", "csv")


def test_stream(spark, tmp_path):
    from tessera.streaming import pages as stream

    spark.createDataFrame([(1, "http://h/a", "<p>x</p>"), (2, "http://h/a#f", "<p>y</p>"), (3, "http://h/b/", "<p>z</p><script>q</script>")], "page_id long, url string, html string").write.parquet(f"{tmp_path}/in")
    rows = stream.cleaned_stream(stream.page_stream(spark, f"{tmp_path}/in"))
    stream.write_jsonl(rows, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination(120)
    got = spark.read.json(f"{tmp_path}/out/*")
    assert got.count() == 2 and {r.content for r in got.collect()} <= {"x", "y", "z"}


def test_extract_pages(spark):
    p = spark.createDataFrame([("u", "<h1>T</h1>" + "<p>x</p>" * 9), ("v", "<p>y</p>")], "url string, html string")
    rules = extract.RuleExtractor({"a": "h1"})
    got = {r.url: r for r in extract.extract_pages(p, rules, ONE, output="html", min_content=20).collect()}
    assert got["u"].data == '{"a": "T"}' and got["v"].error == "insufficient content"
    urls = spark.createDataFrame([("u",), ("w",)], "url string")
    assert {r.url: r.error for r in extract.extract_many(urls, p, rules, ONE, output="html").collect()} == {"u": None, "w": "fetch error: not in the snapshot"}


def test_costs(spark):
    df = spark.createDataFrame([("gpt-4o-mini", 0.15 + 0.6), ("GPT-4", 75.0), ("x:free", 0.0), ("llama:free", 0.5), ("other", 1.25)], "m string, want double")
    assert df.filter(F.abs(costs.tier_cost(F.col("m"), F.lit(1_000_000), F.lit(1_000_000)) - F.col("want")) > 1e-9).count() == 0
    assert one(spark, costs.parse_price, ["", "0", "1e-6x", ".5", "free", None]) == [0, 0, 1e-6, 0.5, 0, 0]
