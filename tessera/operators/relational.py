"""Cleaning phases as relations over the nodes of pages (see ``pages.dom_nodes``).

For analytics and as a cross-check of the kernel. Each phase judges all nodes of its
input tree at once and then drops the matched nodes with everything inside them, which
is what the kernel's node-by-node phases amount to: a node's text and inner matches
depend on its own subtree only, and that comes later in document order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T

BLOCKS = ("div", "section", "aside", "article", "nav", "header", "footer", "p")


def drop_subtrees(nodes: DataFrame, matched: DataFrame) -> DataFrame:
    """``nodes`` without those of ``matched`` (page_id, pre, post) and what they contain."""
    m = matched.select("page_id", F.col("pre").alias("m_pre"), F.col("post").alias("m_post"))
    inside = (nodes["page_id"] == m["page_id"]) & (nodes["pre"] >= m["m_pre"]) & (nodes["pre"] < m["m_post"])
    return nodes.join(m, inside, "left_anti")


def attribute(name: str) -> Column:
    """The value of an attribute, null if a node lacks it."""
    return F.get(F.filter("attrs", lambda a: a["k"] == name), F.lit(0))["v"]


def subtree_texts(nodes: DataFrame, tags: tuple[str, ...]) -> DataFrame:
    """(page_id, pre, post, tag, text) of the elements of some tags, with all text in them."""
    e = nodes.filter(F.col("tag").isin(*tags)).select("page_id", "pre", "post", "tag")
    t = nodes.filter("kind = 'text'").select(F.col("page_id").alias("tp"), F.col("pre").alias("t_pre"), "data")
    both = e.join(t, (F.col("page_id") == F.col("tp")) & (F.col("t_pre") > F.col("pre")) & (F.col("t_pre") < F.col("post")), "left")
    parts = F.array_sort(F.collect_list(F.when(F.col("data").isNotNull(), F.struct("t_pre", "data"))))
    return both.groupBy("page_id", "pre", "post", "tag").agg(parts.alias("p")).select("page_id", "pre", "post", "tag", F.array_join("p.data", "").alias("text"))


def inside_counts(nodes: DataFrame, outer: DataFrame, tags: tuple[str, ...]) -> DataFrame:
    """``outer`` (page_id, pre, post, ...) with ``inner_n``, the elements of some tags inside each."""
    i = nodes.filter(F.col("tag").isin(*tags)).select(F.col("page_id").alias("ip"), F.col("pre").alias("i_pre"))
    both = outer.join(i, (F.col("page_id") == F.col("ip")) & (F.col("i_pre") > F.col("pre")) & (F.col("i_pre") < F.col("post")), "left")
    return both.groupBy(*outer.columns).agg(F.count("i_pre").alias("inner_n"))


def tag_matches(nodes: DataFrame, *tags: str) -> DataFrame:
    return nodes.filter(F.col("tag").isin(*tags))


def hidden_matches(nodes: DataFrame) -> DataFrame:
    return nodes.filter(attribute("hidden").isNotNull() | (attribute("aria-hidden") == "true"))


def link_density(nodes: DataFrame) -> DataFrame:
    """(page_id, pre, post, tag, density): bytes of link texts over bytes of all text, of blocks that have text."""
    blocks = subtree_texts(nodes, BLOCKS).withColumn("n", F.octet_length(T.trim_text(F.col("text")))).filter("n > 0")
    links = subtree_texts(nodes, ("a",)).select(F.col("page_id").alias("ap"), F.col("pre").alias("a_pre"), F.octet_length(T.trim_text(F.col("text"))).alias("a_n"))
    both = blocks.join(links, (F.col("page_id") == F.col("ap")) & (F.col("a_pre") > F.col("pre")) & (F.col("a_pre") < F.col("post")), "left")
    return both.groupBy("page_id", "pre", "post", "tag", "n").agg(F.coalesce(F.sum("a_n"), F.lit(0)).alias("a")).select("page_id", "pre", "post", "tag", (F.col("a") / F.col("n")).alias("density"))


def short_text_matches(nodes: DataFrame, least: int = 20) -> DataFrame:
    outer = subtree_texts(nodes, ("p", "span", "div")).withColumn("n", F.octet_length(T.trim_text(F.col("text")))).filter((F.col("n") > 0) & (F.col("n") < least))
    return inside_counts(nodes, outer.select("page_id", "pre", "post", "tag"), ("img", "table", "ul", "ol", "form")).filter("inner_n = 0")


def duplicate_matches(nodes: DataFrame, least: int = 15) -> DataFrame:
    """Later elements with the text of an earlier one of the page."""
    e = subtree_texts(nodes, ("p", "span", "div", "a", "li", "td", "th")).withColumn("text", T.trim_text(F.col("text"))).filter(F.octet_length("text") >= least)
    leaf = inside_counts(nodes, e, ("p", "div", "article", "section")).filter("inner_n = 0")
    return leaf.withColumn("k", F.expr("row_number() over (partition by page_id, text order by pre)")).filter("k > 1").select("page_id", "pre", "post", "tag")


def boilerplate_matches(nodes: DataFrame) -> DataFrame:
    t = subtree_texts(nodes, ("p", "span", "div", "footer", "small")).withColumn("text", T.trim_text(F.col("text")))
    return t.filter(F.octet_length("text").between(1, 200) & T.boilerplate(F.col("text"))).select("page_id", "pre", "post", "tag")


def repeated_link_matches(nodes: DataFrame) -> DataFrame:
    from tessera.functions.url import link_key

    a = nodes.filter("tag = 'a'").withColumn("href", attribute("href")).filter("href is not null and href not in ('', '#')")
    return a.withColumn("k", F.row_number().over(_first("page_id", link_key(F.col("href"))))).filter("k > 1").select("page_id", "pre", "post", "tag")


def _first(*keys):
    from pyspark.sql import Window

    return Window.partitionBy(*keys).orderBy("pre")


def page_texts(nodes: DataFrame) -> DataFrame:
    """(page_id, text): the body's text, white space collapsed and trimmed."""
    body = subtree_texts(nodes, ("body",))
    return body.select("page_id", T.trim_text(T.collapse_spaces(F.col("text"))).alias("text"))
