"""URL rules, and what the method adds: pages that are aliases of each other share decisions. DataFrame functions only.

Aliases are found from the pages themselves: a canonical link and a refresh redirect are edges between URLs, taken
without scheme, default port and fragment, and with escapes of characters that need none undone. Connected components over the edges carry a rule's decision to the pages no rule fits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.functions.urls import url_join
from pageloom.llm.common import LOWER, UPPER, written
from pageloom.llm.components import components

# Fixed values: (verdict, host, start of the path).
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
HIDDEN = r"""(?is)<!--.*?(?:-->|$)|<(script|style|textarea|title|template)\b(?:[^>"']++|"[^"]*+"|'[^']*+')*+>.*?(?:</\1\s*>|$)"""
TAG = r"""(?i)<(?:link|meta)\b(?:[^>"']|"[^"]*+"|'[^']*+')*+>"""
ESCAPE, NEEDLESS = "%[0-9A-Fa-f]{2}", "%(2[DdEe]|3[0-9]|[46][1-9A-Fa-f]|[57][0-9Aa]|5[Ff]|7[Ee])"
REFRESH = r"""(?is)^\s*[\d.]*\s*[;,]?\s*url\s*=\s*['"]?([^'"]*)"""


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty without one or for null."""
    return F.translate(F.coalesce(F.regexp_extract(url, "(?s)://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "(?s)://[^/?#]*([^?#]*)", 1), F.lit(""))


def plain_escapes(text: Column) -> Column:
    """Escapes of letters, digits and `-._~` undone, the others in capitals; anything else as it is."""
    def plain(piece: Column) -> Column:
        return F.when(piece.rlike(f"^{NEEDLESS}$"), F.decode(F.unhex(F.substring(piece, 2, 2)), "UTF-8")).when(piece.rlike(f"^{ESCAPE}$"), F.upper(piece)).otherwise(piece)

    pieces = F.regexp_extract_all(text, F.lit(f"{ESCAPE}|%|[^%]+"), F.lit(0))
    return F.when(text.contains("%"), F.array_join(F.transform(pieces, plain), "")).otherwise(text)


def node_of(url: Column) -> Column:
    """Host, path and query of an absolute URL, null for others: what names a document whatever the scheme.

    Twins have one node: ports 80 and 443 or none, `%70` or `p`, `%2f` or `%2F`.
    """
    host, rest = F.regexp_replace(host_of(url), ":(80|443)?$", ""), plain_escapes(F.regexp_extract(url, "(?s)://[^/?#]*([^#]*)", 1))
    return F.when(url.contains("://") & (host != ""), F.concat(host, F.when(rest.startswith("/"), F.lit("")).otherwise("/"), rest))


def best_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, null if none does; of equal ones the first listed.

    A rule fits its host and all subdomains where the path starts with the rule's.
    """
    cases = None
    for verdict, rule_host, start in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(start)
        found = F.struct(F.lit(rule_host + start).alias("rule"), F.lit(verdict).alias("verdict"))
        cases = F.when(fits, found) if cases is None else cases.when(fits, found)
    return F.lit(None).cast("struct<rule:string,verdict:string>") if cases is None else cases


def attribute(tag: Column, name: str) -> Column:
    """The value of a tag's attribute as written, empty without one."""
    value = F.regexp_extract(tag, rf"""(?is)[\s"']{name}\s*=\s*("[^"]*|'[^']*|[^\s"'>]+)""", 1)
    return F.trim(F.ltrim(value, F.lit("\"'")))


def bound(column: Column) -> Column:
    """The value as a generator's, so that the optimizer does not copy its definition into every use."""
    return F.explode(F.array(column))


def alias_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(a, b): a page's node, and the node its canonical link or refresh redirect names.

    Relative targets are resolved against the page's URL; absolute ones stay as written. Tags in comments, scripts, styles,
    templates, titles and text areas are text, not links.
    """
    html = F.col(html_col)
    shown = F.when(html.rlike("(?i)canonical|refresh"), F.regexp_replace(html, HIDDEN, " "))
    tags = F.filter(F.regexp_extract_all(shown, F.lit(TAG), F.lit(0)), lambda t: t.rlike("(?i)canonical|refresh"))
    rows = pages.select(F.col(url_col).alias("url"), F.explode(tags).alias("tag"))
    rows = rows.withColumn("target", bound(F.when(attribute(F.col("tag"), "rel").rlike(r"(?i)(^|\s)canonical(\s|$)"), attribute(F.col("tag"), "href")).when(
        attribute(F.col("tag"), "http-equiv").rlike("(?i)^refresh$"), F.regexp_extract(attribute(F.col("tag"), "content"), REFRESH, 1))))
    rows = rows.where("target <> ''").withColumn("target", bound(F.trim(F.regexp_replace("target", "(?i)&(amp|#38|#x26);", "&"))))
    target = F.col("target")
    rows = rows.withColumn("full", bound(F.when(target.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), target).otherwise(url_join(F.col("url"), target))))
    rows = rows.select(bound(F.struct(node_of(F.col("url")).alias("a"), node_of(F.col("full")).alias("b"))).alias("e")).select("e.a", "e.b")
    return rows.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").distinct()


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, host, path, rule, verdict, via) per row.

    The verdict is the longest fitting rule's. A page without one takes its component's: allow if any alias is
    explicitly allowed, else block if any is blocked, else allow; `via` tells rule, alias or default. A page whose URL only
    differs in a default port or needless escapes from one that a rule fits is an alias of that one. A null URL, or one
    without `://`, has an empty host and path and is allowed. Null markup has no aliases. Rows that repeat come out
    repeated; an empty table gives an empty one.
    """
    def ruled(df: DataFrame) -> DataFrame:
        placed = df.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
        return placed.withColumn("found", best_rule(F.col("host"), F.col("path"), rules))

    edges = written(alias_edges(pages, url_col, html_col), "aliases")
    roots = components(edges, "redirects")
    own = ruled(pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"))).withColumn("node", bound(node_of(F.col("url"))))
    twin = F.concat(F.lit("x://"), F.col("node"))
    own = own.withColumn("twin", best_rule(host_of(twin), path_of(twin), rules).getField("verdict"))
    # A node's rule is that of any URL with its host and path, so alias targets count even where no page has them.
    decided = ruled(roots.withColumn("url", F.concat(F.lit("x://"), F.col("node")))).where("found IS NOT NULL")
    shared = decided.groupBy("root").agg(F.min("found.verdict").alias("shared"))  # allow comes before block
    aliases = roots.join(shared, "root").select("node", "shared")
    joined = own.join(aliases, "node", "left").withColumn("shared", F.coalesce("shared", "twin"))
    return joined.select(
        "page_id", "host", "path", F.col("found.rule").alias("rule"),
        F.coalesce("found.verdict", "shared", F.lit("allow")).alias("verdict"),
        F.when(F.col("found").isNotNull(), "rule").when(F.col("shared").isNotNull(), "alias").otherwise("default").alias("via"))
