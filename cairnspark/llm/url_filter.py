"""URL filter: longest-prefix rules on hosts and paths, with block decisions carried to aliases.

Aliases are URLs that redirect to each other or name each other canonical. They form the connected
components of a graph over (host, path) keys. DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, discard, fresh, materialize
from .components import connected_components

#: A rule table of at most so many rows is broadcast; a larger one is joined by a shuffle.
BROADCAST_RULES = 100_000
# Elements whose content holds no tags of the page.
_RAW = ("script", "style", "title", "textarea")
#: Pieces of a page (each from a < to the next) that count where no tag is open, and tags that are open at their end.
_COUNTS = r"(?i)^(?:!--|/?(?:script|style|title|textarea)[\s/>]|(?:link|meta)\s)"
_OPEN = r"(?s)^[a-zA-Z](?!(?:[^>=]++|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|=(?!\s*+[\"']))*+>)"
#: A tag's inside up to the > that ends it: a quoted value, which may hold one, follows an equals sign.
_INSIDE = r"(?s)^(?:[^>=]++|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|=(?!\s*+[\"']))*+"
_ABSOLUTE, _SCHEME = r"(?i)^[a-z][a-z0-9+.-]*://", r"(?i)^[a-z][a-z0-9+.-]*:"


def url_host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; else empty."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def url_path(url: Column) -> Column:
    """After the host up to ?, # or the end; empty without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _attribute(tag: Column, name: str) -> Column:
    """The value of a tag's attribute, quoted or not; empty without it. data-href is no href."""
    found = [F.regexp_extract(tag, rf"(?is)[\s\"']{name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", g) for g in (1, 2, 3)]
    return F.concat(*found)


def _decoded(value: Column) -> Column:
    """Character references that URLs hold: numbers of ASCII characters and the common names."""

    def one(part: Column, at: Column) -> Column:
        ten, hexa = F.regexp_extract(part, "^([0-9]{1,7});?", 1), F.regexp_extract(part, "^[xX]([0-9a-fA-F]{1,6});?", 1)
        code = F.when(ten != "", ten.cast("int")).when(hexa != "", F.conv(hexa, 16, 10).cast("int"))
        rest = F.regexp_replace(part, "^([0-9]{1,7}|[xX][0-9a-fA-F]{1,6});?", "")
        return F.when(at == 0, part).when(code.between(1, 127), F.concat(F.char(code), rest)).otherwise(F.concat(F.lit("&#"), part))

    out = F.array_join(F.transform(F.split(value, "&#"), one), "")
    for name, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("sol", "/"), ("colon", ":"), ("quest", "?"), ("num", "#"), ("amp", "&")):
        out = F.replace(out, F.lit(f"&{name};"), F.lit(char))
    return F.trim(out)


def _without_dots(path: Column) -> Column:
    """A path without . and .. segments."""
    parts = F.split(path, "/")
    last = F.element_at(parts, -1).isin(".", "..")
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda a, x: F.when(x == ".", a).when(x == "..", F.when(F.size(a) > 1, F.slice(a, 1, F.size(a) - 1)).otherwise(a)).otherwise(F.concat(a, F.array(x))))
    return F.when(path.rlike(r"(^|/)\.\.?(/|$)"), F.array_join(F.when(last, F.concat(kept, F.array(F.lit("")))).otherwise(kept), "/")).otherwise(path)


def _link_tags(html: Column) -> Column:
    """The link and meta tags of a page, as an array of their insides.

    The page is cut at each < and its pieces are gone through once, with what is open: an element without tags, a
    comment, or a tag (a quoted value may hold a <, so a tag may go over several pieces; what is kept of it are the
    numbers of its first and last piece). The work grows with the page's length, whatever is left open in it.
    """
    every = F.filter(F.transform(F.split(html, "<"), lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda p: p["i"] > 0)
    # Most pages leave no tag open, and most of their pieces change nothing.
    few = F.filter(every, lambda p: p["x"].rlike(_COUNTS) | p["x"].contains("-->") | p["x"].rlike(_OPEN))
    pieces = F.transform(
        F.when(F.exists(few, lambda p: p["x"].rlike(_OPEN)), every).otherwise(few),
        lambda p: F.struct(
            p["i"].alias("i"),
            F.lower(F.regexp_extract(p["x"], r"^([a-zA-Z][a-zA-Z0-9:-]*)", 1)).alias("name"),
            F.lower(F.regexp_extract(p["x"], r"^/([a-zA-Z]+)[\s/>]", 1)).alias("closes"),
            p["x"].startswith("!--").alias("opens_comment"),
            p["x"].contains("-->").alias("ends_comment"),
            p["x"].alias("x"),
            F.regexp_extract(p["x"], _INSIDE, 0).alias("inside"),
        ),
    )
    # A < within a quoted value: the piece goes on in the quote, or closes it.
    state = F.struct(F.lit("").alias("raw"), F.lit("").alias("tag"), F.lit("").alias("quote"), F.lit(0).alias("first"), F.array().cast("array<struct<a:int,z:int,tag:string>>").alias("found"))

    def opened(inside: Column, x: Column) -> Column:
        """The quote that a piece leaves open behind the inside of its tag; empty if the tag ends, a space if it is
        open without a quote."""
        rest = F.substring(x, F.length(inside) + 1, F.length(x))
        return F.when(rest.startswith(">"), "").otherwise(F.coalesce(F.nullif(F.regexp_extract(rest, r"^=\s*+([\"'])", 1), F.lit("")), F.lit(" ")))

    def step(s: Column, p: Column) -> Column:
        new = lambda raw, tag, quote, first, found: F.struct(raw.alias("raw"), tag.alias("tag"), quote.alias("quote"), first.alias("first"), found.alias("found"))
        none = F.lit("")

        def after(name: Column, quote: Column, first: Column) -> Column:
            """Of a tag of which another piece has been read."""
            wanted = name.isin("link", "meta")
            ended = new(F.when(name.isin(*_RAW), name).otherwise(none), none, none, F.lit(0), F.when(wanted, F.concat(s["found"], F.array(F.struct(first.alias("a"), p["i"].alias("z"), F.when(first == p["i"], p["inside"]).alias("tag"))))).otherwise(s["found"]))
            return F.when(quote == "", ended).otherwise(new(none, name, quote, first, s["found"]))

        going = F.when(s["quote"] == " ", p["x"]).otherwise(F.concat(F.lit("="), s["quote"], F.lit("<"), p["x"]))
        raw = F.when(s["raw"] == "!--", F.when(p["ends_comment"], none).otherwise(s["raw"])).otherwise(F.when(p["closes"] == s["raw"], none).otherwise(s["raw"]))
        return (
            F.when(s["raw"] != "", new(raw, none, none, F.lit(0), s["found"]))
            .when(s["tag"] != "", after(s["tag"], opened(F.regexp_extract(going, _INSIDE, 0), going), s["first"]))
            .when(p["opens_comment"], new(F.when(p["ends_comment"], none).otherwise("!--"), none, none, F.lit(0), s["found"]))
            .when(p["name"] == "", s)
            .otherwise(after(p["name"], opened(p["inside"], p["x"]), p["i"]))
        )

    found = F.aggregate(pieces, state, step, lambda s: s["found"])
    return F.transform(found, lambda t: F.when(t["tag"].isNotNull(), t["tag"]).otherwise(F.regexp_extract(F.array_join(F.slice(F.split(html, "<"), t["a"] + 1, t["z"] - t["a"] + 1), "<"), _INSIDE, 0)))


def alias_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(a, b): host+path of a page and of the target of each of its canonical links (rel may name other relations
    too) and refresh redirects.

    Targets may be absolute (a scheme and ://), //host/path, /path, relative to the page's folder, or a query or
    fragment of the page itself; other schemes are no targets. Null pages and URLs, and targets without a host, give
    no edge. base elements are not followed.
    """
    here = pages.select(F.col(html).alias("h"), url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path")).filter("host <> '' and h is not null")
    here = here.filter(F.col("h").rlike("(?i)canonical|refresh"))  # without either word there is no link
    tag = here.select("host", "path", F.explode(_link_tags(F.col("h"))).alias("tag"))
    relations = F.split(F.lower(F.trim(_attribute(F.col("tag"), "rel"))), r"\s+")
    canonical = F.col("tag").rlike(r"(?i)^link\s") & F.array_contains(relations, "canonical")
    refresh = F.col("tag").rlike(r"(?i)^meta\s") & (F.lower(F.trim(_attribute(F.col("tag"), "http-equiv"))) == "refresh")
    to = F.when(canonical, _decoded(_attribute(F.col("tag"), "href"))).when(refresh, F.regexp_extract(_decoded(_attribute(F.col("tag"), "content")), r"(?is)\burl\s*=\s*[\"']?\s*([^\"'\s>]+)", 1))
    found = tag.select("host", "path", to.alias("to")).filter("to <> ''")
    whole = (
        F.when(F.col("to").rlike(_ABSOLUTE), F.col("to"))
        .when(F.col("to").rlike(_SCHEME), F.lit(None))
        .when(F.col("to").startswith("//"), F.concat(F.lit("http:"), "to"))
        .when(F.col("to").startswith("/"), F.concat(F.lit("http://"), "host", "to"))
        .when(F.col("to").rlike("^[?#]"), F.concat(F.lit("http://"), "host", "path", "to"))
        .otherwise(F.concat(F.lit("http://"), "host", F.regexp_replace(F.when(F.col("path") == "", "/").otherwise(F.col("path")), r"[^/]*$", ""), "to"))
    )
    links = found.select(F.concat("host", "path").alias("a"), whole.alias("to")).filter("to is not null")
    links = links.select("a", url_host(F.col("to")).alias("host"), url_path(F.col("to")).alias("path")).filter("host <> ''")
    return links.select("a", F.concat("host", _without_dots(F.col("path"))).alias("b")).filter("a <> b")


def match_rules(keys: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, rule, action): the longest rule that fits each key, for the keys that one fits.

    keys: distinct (host, path). rules: (rule_host, rule_path, action). A rule fits its host and all
    subdomains if the path starts with the rule's. Of equally long rules an allow wins, then the lesser.
    """
    rules = rules.select("rule_host", "rule_path", "action")
    if rules.count() <= BROADCAST_RULES:
        rules = F.broadcast(rules)
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fit = keys.select("host", "path", F.explode(suffixes).alias("rule_host")).join(rules, "rule_host").filter(F.expr("startswith(path, rule_path)"))
    rule = F.concat("rule_host", "rule_path")
    best = F.min(F.struct((-F.length(rule)).alias("n"), (F.col("action") != "allow").alias("b"), rule.alias("rule"), F.col("action").alias("action")))
    return fit.groupBy("host", "path").agg(best.alias("best")).select("host", "path", "best.rule", "best.action")


def judge_urls(pages: DataFrame, rules: DataFrame, edges: DataFrame | None = None, url: str = "url") -> DataFrame:
    """pages' columns (all of them, renamed apart only where they clash) and host, path, rule, verdict, component.

    A URL that a rule fits gets that rule's action: an explicit allow holds even among blocked aliases.
    Any other URL is blocked if an alias of it is blocked by a rule, and allowed otherwise. Null URLs
    have an empty host and path and are allowed. Equal rows get equal results; nothing is dropped.
    """
    clash = [c for c in pages.columns if c.lower() in ("host", "path", "rule", "action", "component", "verdict")]
    pages = pages.withColumnsRenamed({c: f"input_{c}" for c in clash})
    url = f"input_{url}" if url in clash else url
    node, spread = fresh([*pages.columns, "host", "path", "rule", "action", "component"], "node", "spread")
    parsed = pages.withColumns({"host": url_host(F.col(url)), "path": url_path(F.col(url))})
    # Tables that grow with the pages are joined by merging, never broadcast.
    matched = materialize(match_rules(parsed.select("host", "path").distinct(), rules), "url-rules").hint("merge")
    out = parsed.join(matched, ["host", "path"], "left").withColumn(node, F.concat("host", "path"))
    if edges is None:
        out = out.withColumns({"component": F.col(node), spread: F.lit(False)})
    else:
        edges = materialize(edges.select("a", "b").distinct(), "url-links")
        ends = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
        # Targets of links need not be pages; rules are matched for them too.
        cut = ends.select(F.regexp_extract("node", "^([^/]*)", 1).alias("host"), F.regexp_extract("node", "(?s)^[^/]*(.*)$", 1).alias("path"))
        blocked = match_rules(cut, rules).filter("action = 'block'").select(F.concat("host", "path").alias("node"))
        cc = materialize(connected_components(edges), "url-components")
        bad = materialize(cc.join(blocked, "node").select("component").distinct(), "url-blocked").hint("merge")
        alias = cc.join(bad.withColumn(spread, F.lit(True)), "component", "left").select(F.col("node").alias(node), "component", F.coalesce(spread, F.lit(False)).alias(spread))
        alias = materialize(alias, "url-aliases")
        out = out.join(alias.hint("merge"), node, "left").withColumn("component", F.coalesce("component", node))
        discard(cc)
    verdict = F.coalesce("action", F.when(F.col(spread), "block").otherwise("allow"))
    return out.withColumn("verdict", verdict).drop("action", spread, node)
