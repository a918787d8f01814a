"""Pages enriched by ``page_id`` arithmetic, so that every expected value is known without parsing.

One SELECT over the ``pages`` table that Spark and an ANSI SQL engine both run. It adds metadata, JSON-LD, links
forming a binary tree per site, images, formulas, a table with spans, code, lists and quotes to every page.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

HEAD = """'</title>'
 || '<meta property="og:title" content="T' || k || '">'
 || '<meta name="author" content="A' || CAST(page_id % 7 AS STRING) || '">'
 || CASE WHEN page_id % 3 = 0 THEN '<meta name="description" content="">'
         ELSE '<meta name="description" content="D: ' || k || '">' END
 || '<meta name="description" content="second">'
 || '<meta name="keywords" content="k' || CAST(page_id % 5 AS STRING) || ', news ,, x">'
 || '<meta property="article:published_time" content="2024-01-' || lpad(CAST(1 + page_id % 28 AS STRING), 2, '0') || '">'
 || '<meta property="og:site_name" content="Site &amp; ' || s || '"><meta property="og:image" content="/og' || k || '.png">'
 || '<link rel="alternate canonical" href="/c/' || k || '">'
 || CASE WHEN page_id % 4 = 0 THEN '<script type="application/ld+json">{"@type":"Article","headline":"H' || k
           || '","author":[{"name":"J"},"K",{"x":1}],"mainEntityOfPage":"' || u || '?utm_source=z"}</script>'
         WHEN page_id % 4 = 1 THEN '<script type="application/ld+json">{"@type":"Article","headline":</script>'
         WHEN page_id % 4 = 2 THEN '<script type="application/ld+json">[{"@type":"BreadcrumbList"},{"@type":"BlogPosting","description":"J'
           || k || '","datePublished":"2025-02-03","author":{"name":"N' || k || '"},"about":[{"deep":{"url":"' || u || '/"}}]}]</script>'
         ELSE '<script type="application/ld+json">{"@type":"WebPage","author":"S' || k || '","dateModified":"2025-03-04"}</script>'
           || '<script type="application/ld+json">{"@type":["Article"],"headline":"no"}</script>' END"""

OPEN = """CASE page_id % 6 WHEN 0 THEN '<article>' WHEN 1 THEN '<main>' WHEN 2 THEN '<div role="main">'
 WHEN 3 THEN '<div id="page-Content">' WHEN 4 THEN '<div class="x post-body">' ELSE '<section>' END"""

CLOSE = """CASE page_id % 6 WHEN 0 THEN '</article>' WHEN 1 THEN '</main>' WHEN 5 THEN '</section>' ELSE '</div>' END"""

FORMULA = """CASE page_id % 5
 WHEN 0 THEN '<math alttext=" x^2 " display="block"><mi>x</mi></math>'
 WHEN 1 THEN '<script type="math/tex; mode=display"> a+b </script>'
 WHEN 2 THEN '<math><mfrac><mi>a</mi><mn>2</mn></mfrac></math>'
 WHEN 3 THEN '<mjx-container aria-label="y"><svg></svg></mjx-container>'
 ELSE '<img src="/tex.svg" alt="z_1">' END"""

CONTENT = """'<p><a href="/p/' || CAST(2 * i + 1 AS STRING) || '">L</a> <a href=" /p/' || CAST(2 * i + 2 AS STRING)
 || '/?utm_medium=q#t">R</a> <a href="/p/' || CAST(CAST(floor((i - 1) / 2) AS BIGINT) AS STRING) || '">U</a></p>'
 || '<p><a href="mailto:x@y.z">m</a> <a href="/f/' || n || '.PDF">f</a> <a href="https://other.example.org/">o</a>'
 || ' <b data-href="/p/' || n || '">d</b></p>'
 || '<h2>Figure ' || k || '</h2><p><img src="/img/' || k || '.png" alt="Alt ' || k || '"></p>'
 || '<p><img data-src="lazy-' || CAST(page_id % 10 AS STRING) || '_a.jpg" srcset="/s1.png 1x, /s2.png 2x"></p>'
 || '<div style="background-image: url(/bg' || CAST(page_id % 4 AS STRING) || '.png)">bg</div>'
 || '<p>F ' || formula || ' G</p>'
 || '<table><tr><th colspan="' || CAST(1 + page_id % 3 AS STRING) || '">h</th><th>i</th></tr>'
 || '<tr><td rowspan="' || CAST(1 + page_id % 2 AS STRING) || '">r' || k || '</td><td>v</td></tr><tr><td>w</td></tr></table>'
 || '<pre><code class="' || CASE page_id % 4 WHEN 0 THEN 'language-python' WHEN 1 THEN 'hl lang-sql' WHEN 2 THEN 'hl Rust' ELSE 'plain' END
 || '">p(' || k || ')</code></pre>'
 || '<ol><li>one ' || k || '</li><li>two<ul><li>sub</li></ul></li></ol>'
 || '<blockquote><p>quote ' || k || '</p></blockquote><hr>'
 || '<p>1. start</p><p>- dash</p><p><em>em</em> <code>c' || k || '</code></p>'
 || '<p><abbr title="Long ' || k || '">AB' || k || '</abbr></p>'"""

NUMBERS = [
    "page_id", "html", "CAST(page_id AS STRING) AS k", "CAST(page_id % 3 AS STRING) AS s",
    "CAST(floor(page_id / 3) AS BIGINT) AS i", "CAST(CAST(floor(page_id / 3) AS BIGINT) AS STRING) AS n",
]
PLACES = ["*", "'https://site' || s || '.example.org/p/' || n AS u", f"{FORMULA} AS formula"]
PAGE = [
    "page_id", "u AS url",
    f"replace(replace(replace(html, '</title>', {HEAD}), '<article>', {OPEN} || {CONTENT}), '</article>', {CLOSE}) AS html",
]

PAGES_X = f"""SELECT {', '.join(PAGE)} FROM (
  SELECT {', '.join(PLACES)} FROM (SELECT {', '.join(NUMBERS)} FROM pages) AS numbered) AS placed"""


def pages_x(pages: DataFrame) -> DataFrame:
    """The enriched pages, derived from a ``pages`` table."""
    return pages.selectExpr(*NUMBERS).selectExpr(*PLACES).selectExpr(*PAGE)
