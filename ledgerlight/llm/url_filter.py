"""URL filters with redirect equivalence, in DataFrame functions alone.

Rules name a host and the beginning of a path; a rule fits its host, all subdomains of it and all
paths that begin with it, and the longest fitting rule decides. A URL that no rule fits takes over
the decision of the URLs it is equivalent to: redirects and canonical links join URLs into
components (:mod:`ledgerlight.llm.components`), and a component that holds a blocked URL and no
explicitly allowed one is blocked as a whole.

All URLs are matched by an equality join on (rule, possible rule of the URL): a host of k labels
has at most k+1 suffixes and a path as many prefixes as there are distinct rule path lengths.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlight.llm import scratch
from ledgerlight.llm.components import connected_components

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(c: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(c, _UPPER, _LOWER)


def _rest(url: Column) -> Column:
    """What follows the first ``://``; empty without one and for null."""
    at = F.instr(url, "://")
    return F.when(url.isNotNull() & (at > 0), url.substr(at + 3, F.length(url))).otherwise(F.lit(""))


def with_parts(df: DataFrame, url: str, *parts: str) -> DataFrame:
    """Add the columns named in ``parts``: ``host``, ``path`` and ``address`` of the column ``url``.

    Host: up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased. Path: from there up to ``?``, ``#``
    or the end. Address, the vertex a URL stands for: host, path and query without scheme and
    fragment; null without a host.
    """
    cut = df.withColumn("_rest", _rest(F.col(url)))
    cut = cut.withColumn("_host", F.regexp_extract("_rest", r"^[^/?#]*", 0))
    cut = cut.withColumn("_tail", F.regexp_extract(F.col("_rest").substr(F.length("_host") + 1, F.length("_rest")), r"(?s)^[^#]*", 0))
    made = {
        "host": lower_ascii(F.col("_host")),
        "path": F.regexp_extract("_tail", r"(?s)^[^?]*", 0),
        "address": F.when(F.col("_host") != "", F.concat(lower_ascii(F.col("_host")), F.when(F.col("_tail").startswith("/"), "").otherwise("/"), F.col("_tail"))),
    }
    return cut.select(*df.columns, *[made[p].alias(p) for p in parts])


def _unescape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&quot;"), F.lit('"')), F.lit("&#38;"), F.lit("&")), F.lit("&amp;"), F.lit("&"))


def resolve(links: DataFrame) -> DataFrame:
    """(src, dst) for rows (src, href): the absolute URL of each link that is one, else null.

    ``.`` and ``..`` segments stay as they are; other schemes and links within the page drop out.
    """
    cut = links.withColumn("_base", F.regexp_extract("src", r"(?s)^[^#]*", 0))
    cut = cut.withColumn("_page", F.regexp_extract("_base", r"(?s)^[^?]*", 0)).withColumn("_origin", F.regexp_extract("_base", r"^.*?://[^/?]*", 0))
    cut = cut.withColumn("_folder", F.when(F.col("_page") == F.col("_origin"), F.concat("_origin", F.lit("/"))).otherwise(F.regexp_extract("_page", r"(?s)^(.*?://.*/)[^/]*$", 1)))
    href = F.col("href")
    dst = (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), href)
        .when(href.isNull() | href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:") | href.startswith("#") | (href == ""), F.lit(None).cast("string"))
        .when(href.startswith("//"), F.concat(F.lit("http:"), href))
        .when(href.startswith("/"), F.concat("_origin", href))
        .when(href.startswith("?"), F.concat("_page", href))
        .otherwise(F.concat("_folder", href))
    )
    return cut.select("src", dst.alias("dst"))


def page_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Rows (src, dst) of URLs for each canonical link and each refresh redirect in a page.

    Links inside comments, scripts and styles are not links. Null pages have none.
    """
    marked = pages.select(F.col(url).alias("src"), F.col(html).alias("html")).where(
        F.col("src").isNotNull() & F.col("html").rlike(r"(?i)canonical|refresh")
    )
    visible = F.regexp_replace("html", r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>", " ")
    tags = marked.select("src", F.explode(F.regexp_extract_all(visible, F.lit(r"(?is)<(?:link|meta)\b(?:[^'\">]++|\"[^\"]*+\"|'[^']*+')*+>"), 0)).alias("tag"))

    def attribute(name: str) -> Column:
        found = F.regexp_extract("tag", rf"(?is)[\s\"'/]{name}\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", 1)
        return F.trim(F.regexp_replace(found, r"^[\"']|[\"']$", ""))

    read = tags.select(
        "src", F.lower(F.substring("tag", 2, 4)).alias("kind"), F.lower(attribute("rel")).alias("rel"), attribute("href").alias("link"),
        F.lower(attribute("http-equiv")).alias("equiv"), attribute("content").alias("content"),
    )
    canonical = (F.col("kind") == "link") & F.col("rel").rlike(r"(^|\s)canonical(\s|$)")
    refresh = (F.col("kind") == "meta") & (F.col("equiv") == "refresh")
    to = F.when(canonical, F.col("link")).when(refresh, F.regexp_replace(F.regexp_extract("content", r"(?is)url\s*=\s*(.*)$", 1), r"^[\"']|[\"']$", ""))
    # Stored before the last filter, which would otherwise repeat every expression it rests on.
    found = scratch.keep(resolve(read.select("src", _unescape(to).alias("href"))), "page-links")
    return found.where("dst is not null")


def match_rules(urls: DataFrame, rules: Sequence[tuple[str, str]], key: str, host: str, path: str) -> DataFrame:
    """Rows (key, rule, decision) for the distinct keys of ``urls`` that a rule fits; longest wins.

    ``rules`` are (decision, "host/path-prefix"); they are a short list in the plan. Length is the
    number of characters of the whole rule; equally long rules are decided allow first.
    """
    spark = urls.sparkSession
    split = [(f"{h.lower()}/{p}", h.lower(), f"/{p}", d) for d, rule in rules for h, _, p in [rule.partition("/")]]
    if not split:
        return urls.select(F.col(key).alias("key"), F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("decision")).limit(0)
    table = spark.createDataFrame(split, "rule string, rule_host string, rule_path string, decision string")
    lengths = F.array(*[F.lit(n) for n in sorted({len(p) for _, _, p, _ in split})])
    labels = F.split(F.col("host"), r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    wide = urls.select(F.col(key).alias("key"), F.col(host).alias("host"), F.col(path).alias("path")).where("host <> ''")
    possible = wide.select("key", "path", F.explode(suffixes).alias("rule_host")).select(
        "key", "rule_host", F.explode(F.array_distinct(F.transform(F.filter(lengths, lambda n: n <= F.length("path")), lambda n: F.substring("path", F.lit(1), n)))).alias("rule_path")
    )
    fit = possible.join(F.broadcast(table), ["rule_host", "rule_path"])
    best = F.max(F.struct(F.length("rule").alias("n"), (F.col("decision") == "allow").alias("allow"), "rule", "decision"))
    return fit.groupBy("key").agg(best.alias("best")).select("key", "best.rule", "best.decision")


def judge_urls(
    pages: DataFrame,
    rules: Sequence[tuple[str, str]],
    links: DataFrame | None = None,
    page_id: str = "page_id",
    url: str = "url",
    html: str = "html",
) -> DataFrame:
    """One row (page_id, url, host, path, rule, verdict, source, alias) per page.

    ``links`` (src, dst) are further redirects, for example from a crawl log; canonical links and
    refresh redirects are read from the pages. ``source`` says what decided: ``rule``, ``alias`` (a
    blocked or allowed URL of the component, the component's smallest address in ``alias``) or
    ``default`` (allow). A page with a rule keeps the rule's decision, so an explicit allow is
    never overruled; in a component that holds both decisions the allow counts for URLs without a
    rule. Pages without an address (null, no ``://`` or no host) are allowed. Repeated rows give
    repeated rows; other columns are not read.
    """
    base = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    edges = page_links(base)
    if links is not None:
        edges = edges.unionByName(links.select(F.col("src").cast("string"), F.col("dst").cast("string")))
    ends = with_parts(edges.select("src", "dst", F.col("dst").alias("_to")), "src", "address").withColumnRenamed("address", "u")
    ends = with_parts(ends, "_to", "address").select("src", "dst", "u", F.col("address").alias("v"))
    edges = scratch.keep(ends, "links").where("u is not null and v is not null")
    members = scratch.keep(connected_components(edges), "url-members")

    known = edges.select(F.col("u").alias("address"), F.col("src").alias("url")).unionByName(edges.select(F.col("v").alias("address"), F.col("dst").alias("url")))
    # One address has several spellings (``http://a.com``, ``http://a.com/``) with paths of their own.
    places = with_parts(known.distinct(), "url", "host", "path").select("address", "host", "path").distinct().withColumn("place", F.struct("address", "host", "path"))
    ruled = match_rules(places, rules, "place", "host", "path").select(F.col("key.address").alias("vertex"), "decision")
    # Stored, so that both sides of the next join are plain shuffles and a huge component can be split.
    decided = scratch.keep(
        members.join(ruled.groupBy("vertex").agg(F.min("decision").alias("decision")), "vertex")
        .groupBy("component")
        .agg(F.min("decision").alias("decision")),  # allow comes before block
        "url-decided",
    )
    inherited = members.join(decided, "component").select(F.col("vertex").alias("address"), F.col("component").alias("alias"), F.col("decision").alias("inherited"))

    own = with_parts(base.select("page_id", "url"), "url", "host", "path", "address")
    places = own.select("host", "path").where("host <> ''").distinct().withColumn("place", F.struct("host", "path"))
    fitting = match_rules(places, rules, "place", "host", "path").select("key.host", "key.path", "rule", F.col("decision").alias("explicit"))
    return (
        own.join(fitting, ["host", "path"], "left")
        .join(inherited, "address", "left")
        .select(
            "page_id", "url", "host", "path", "rule",
            F.coalesce("explicit", "inherited", F.lit("allow")).alias("verdict"),
            F.when(F.col("explicit").isNotNull(), "rule").when(F.col("inherited").isNotNull(), "alias").otherwise("default").alias("source"),
            F.when(F.col("explicit").isNull(), F.col("alias")).alias("alias"),
        )
    )
