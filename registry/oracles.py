"""ANSI SQL counterparts of the registered queries, for an engine that shares no code with them.

Expected values of enriched pages come from ``page_id`` arithmetic, those of raw pages from simple patterns that
hold for the given pages only.
"""

from __future__ import annotations

from pageloom.fixtures import PAGES_X
from registry.queries import CONTENT_TYPE, SHARED_PATH, START

ORACLES: dict[str, str] = {}

X = f"WITH RECURSIVE x AS ({PAGES_X})"
K = """k AS (SELECT page_id, CAST(page_id AS VARCHAR) AS k, CAST(page_id % 3 AS VARCHAR) AS s,
  CAST(floor(page_id / 3) AS BIGINT) AS i, 'https://site' || CAST(page_id % 3 AS VARCHAR) || '.example.org' AS site FROM pages)"""
FILE = "replace(site, 'https://', '') || '/p/' || CAST(i AS VARCHAR) || '.md'"
URL = "site || '/p/' || CAST(i AS VARCHAR)"

# URLs of the raw pages: tracking key, page parameter, fragment and trailing slash are the only variants.
NORM = """rtrim(regexp_replace(url, '[?#].*$', ''), '/') || CASE WHEN url LIKE '%?page=2%' THEN '?page=2' ELSE '' END"""
HOST = "split_part(split_part(url, '://', 2), '/', 1)"


def decoded(text: str) -> str:
    for name, char in (("quot", '"'), ("lt", "<"), ("gt", ">"), ("copy", "©"), ("middot", "·"), ("#39", "''"), ("amp", "&")):
        text = f"replace({text}, '&{name};', '{char}')"
    # Titles may be cut inside a reference.
    return f"regexp_replace({text}, '&amp$', '&')"


def squeezed(text: str) -> str:
    return rf"trim(regexp_replace({text}, '\s+', ' ', 'g'))"


BARE = """regexp_replace(regexp_replace(regexp_replace(html, '<style>.*?</style>', '', 'gs'), '<script>.*?</script>', '', 'gs'), '<!--.*?-->', chr(1), 'gs')"""
NODES = f"list_filter(list_transform(regexp_split_to_array({{}}, '<[^>]*>|' || chr(1)), lambda t: trim({decoded('t')}, ' ' || chr(10))), lambda t: t <> '')"
PLAIN = f"array_to_string({NODES.format(BARE)}, chr(10))"

# The article of a raw page: a title, then paragraphs, some of them unclosed with an unclosed <b> and a <br>.
MARK = "chr(1)"
ARTICLE = f"""art AS (SELECT page_id, url, html, {decoded("ltrim(regexp_replace(regexp_extract(html, '<h1>(.*?)</h1>', 1, 's'), '\\s+', ' ', 'g'))")} AS h1,
  regexp_extract(html, '<article>.*?</h1>(.*)</article>', 1, 's') AS rest FROM pages),
md AS (SELECT page_id, url, html, h1, '# ' || h1 || chr(10) || chr(10) || {{strip}}(regexp_replace(
  {decoded(f'''regexp_replace(
  replace(replace(replace(replace(regexp_replace(regexp_replace(rest, '\\s+', ' ', 'g'), '(<b>) +| +(<br>)', '\\1\\2', 'g'),
    '<b>', '**'), '<br>', '  ' || chr(10)), '<p>', {MARK}), '</p>', {MARK})
  || repeat('**' || {MARK}, CAST((length(rest) - length(replace(rest, '<b>', ''))) / 3 AS BIGINT)), chr(1) || ' +', chr(1), 'g')''')},
  '(' || chr(1) || ')+', chr(10) || chr(10), 'g'), chr(10) || ' ') AS body FROM art)"""
MD = ARTICLE.format(strip="trim")
WORDS = "CAST(length(regexp_replace({0}, '[^\\s]+', 'w', 'g')) - length(regexp_replace({0}, '[^\\s]+', '', 'g')) AS BIGINT)"
WORDS = "len(list_filter(regexp_split_to_array({0}, '\\s+'), lambda w: w <> ''))"


def add(name: str, sql: str) -> None:
    ORACLES[name] = sql


# Sources
add("src1_page_source", "SELECT page_id, url, CAST(length(html) AS BIGINT) AS chars FROM pages")
add("src2_html_only", f"SELECT page_id, {CONTENT_TYPE} AS content_type FROM pages WHERE page_id % 5 <> 0")
add("src3_decode_charset", "SELECT page_id, html FROM pages")
add("src4_fetch_outcome", """SELECT CASE WHEN e = '' THEN 'ok' ELSE 'error' END AS status, e AS error, count(*) AS n FROM (
  SELECT CASE WHEN page_id % 7 = 0 THEN 'no content' WHEN page_id % 5 = 0 THEN 'not HTML content' ELSE '' END AS e FROM pages)
  GROUP BY e""")

# Stored corpus
add("snk2_write_raw_html_x", f"""{X}, {K} SELECT k.page_id, replace({FILE}, '.md', '.html') AS html_path, md5(html) AS html_md5
  FROM k JOIN x USING (page_id)""")
add("snk3_skip_existing_x", f"WITH {K} SELECT page_id, {FILE} AS file_path FROM k WHERE page_id % 4 <> 0")
add("snk3_existing_counts_x", """SELECT count(*) FILTER (WHERE page_id % 4 = 0) AS already_exists,
  count(*) FILTER (WHERE page_id % 4 <> 0) AS remaining FROM pages""")
add("snk4_overwrite_x", f"""WITH {K} SELECT page_id, {FILE} AS file_path,
  CASE WHEN page_id % 2 = 0 THEN 'new ' ELSE 'old ' END || k AS content FROM k""")
add("snk5_path_collision", f"""SELECT file_path, min(page_id) AS first_page, max(page_id) AS last_page FROM (
  SELECT page_id, {SHARED_PATH} AS file_path FROM pages) GROUP BY file_path""")
STORED = f"WITH {K} SELECT page_id, replace(site, 'https://', '') AS site, {FILE} AS file_path FROM k"
add("snk6_stream_ingest_x", STORED)
add("snk6_stream_repeats_x", STORED)

# URLs
add("url1_ensure_scheme", """SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'https://' || split_part(url, '://', 2) ELSE url END AS url
  FROM pages""")
add("url2_url_parts", f"""SELECT page_id, split_part(url, '://', 1) AS scheme, {HOST} AS netloc,
  regexp_extract(url, '^[a-z]+://[^/]*([^?#]*)', 1) AS path, '' AS params, regexp_extract(url, '\\?([^#]*)', 1) AS query,
  regexp_extract(url, '#(.*)$', 1) AS fragment FROM pages""")
add("url3_normalize_url", f"SELECT page_id, {NORM} AS norm_url FROM pages")
add("url4_urljoin", f"""WITH refs AS (SELECT page_id, split_part(url, '://', 1) || '://' || {HOST}
    || unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS target FROM pages)
  SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY target) AS BIGINT) AS n, target FROM refs""")

NAV = "nav AS (SELECT page_id, unnest(regexp_extract_all(html, '<li><a href=\"([^\"]*)\"', 1)) AS ref FROM pages)"
TARGETS = f"""targets AS (
  SELECT page_id, site || ref AS target, 'href' AS via FROM nav JOIN k USING (page_id)
  UNION ALL SELECT page_id, site || '/p/' || CAST(2 * i + 1 AS VARCHAR), 'href' FROM k
  UNION ALL SELECT page_id, site || '/p/' || CAST(2 * i + 2 AS VARCHAR) || '/?utm_medium=q#t', 'href' FROM k
  UNION ALL SELECT page_id, site || '/p/' || CAST(CAST(floor((i - 1) / 2) AS BIGINT) AS VARCHAR), 'href' FROM k
  UNION ALL SELECT page_id, site || '/f/' || CAST(i AS VARCHAR) || '.PDF', 'href' FROM k
  UNION ALL SELECT page_id, 'https://other.example.org/', 'href' FROM k
  UNION ALL SELECT page_id, site || '/p/' || CAST(i AS VARCHAR), 'data-href' FROM k
  UNION ALL SELECT page_id, site || '/p/' || CAST(i AS VARCHAR) || '?utm_source=z', 'json-ld' FROM k WHERE page_id % 4 = 0
  UNION ALL SELECT page_id, site || '/p/' || CAST(i AS VARCHAR) || '/', 'json-ld' FROM k WHERE page_id % 4 = 2)"""
LINKS = """found AS (SELECT DISTINCT page_id, via, rtrim(regexp_replace(target, '[?#].*$', ''), '/') AS url FROM targets
  WHERE target NOT LIKE 'https://other%' AND target NOT LIKE '%.PDF')"""
LINKED = f"WITH RECURSIVE {K}, {NAV}, {TARGETS}, {LINKS}"
add("url5_is_internal_x", f"""{LINKED} SELECT DISTINCT page_id, target,
  CASE WHEN target LIKE 'https://other%' THEN 'false' ELSE 'true' END AS internal FROM targets""")
add("url6_should_skip_x", f"""{LINKED} SELECT DISTINCT page_id, target,
  CASE WHEN target LIKE '%.PDF' THEN 'true' ELSE 'false' END AS skipped FROM targets""")
PATH = "regexp_replace(regexp_replace({0}, '^[a-z]+://[^/]*/', ''), '\\?.*$', '')"
add("url7_site_file_path", f"""SELECT page_id, {HOST} || '/' || CASE WHEN norm LIKE '%.html%' THEN regexp_replace({PATH.format('norm')}, '\\.html$', '')
  ELSE {PATH.format('norm')} END || CASE WHEN norm LIKE '%?page=2' THEN '_page=2' ELSE '' END || '.md' AS file_path
  FROM (SELECT page_id, url, {NORM} AS norm FROM pages)""")
add("url8_page_file_name", f"""SELECT page_id, regexp_replace(split_part({PATH.format('norm')}, '/', 2), '\\.html$', '') AS file_name
  FROM (SELECT page_id, {NORM} AS norm FROM pages)""")
add("url9_sanitize_filename", r"""SELECT page_id, CASE WHEN f = '' THEN 'untitled' ELSE f END AS file_name FROM (
  SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(t, '[<>:"/\\|?*\x00-\x1f]', '_', 'g'), '\s+', '-', 'g'), '-+', '-', 'g'), '.-') AS f
  FROM (SELECT page_id, regexp_extract(html, '<h1>([^<]*)</h1>', 1) AS t FROM pages))""")
IMAGES = """images AS (
  SELECT page_id, site, 1 AS ord, 'src' AS via, site || '/img/' || k || '.png' AS url, 'Alt ' || k AS alt, 'Figure ' || k AS heading FROM k
  UNION ALL SELECT page_id, site, 2, 'data-src', site || '/p/lazy-' || CAST(page_id % 10 AS VARCHAR) || '_a.jpg', 'lazy ' || CAST(page_id % 10 AS VARCHAR) || ' a', '' FROM k
  UNION ALL SELECT page_id, site, 3, 'srcset', site || '/s1.png', 's1', '' FROM k
  UNION ALL SELECT page_id, site, 4, 'srcset', site || '/s2.png', 's2', '' FROM k
  UNION ALL SELECT page_id, site, 5, 'background', site || '/bg' || CAST(page_id % 4 AS VARCHAR) || '.png', 'bg' || CAST(page_id % 4 AS VARCHAR), '' FROM k
  UNION ALL SELECT page_id, site, 6, 'src', site || '/tex.svg', 'z_1', 'Figure ' || k FROM k WHERE page_id % 5 = 4)"""
IMG = f"WITH {K}, {IMAGES}"
STORE_PATH = "replace(url, site || '/', 'images/')"
add("url10_image_path_x", f"{IMG} SELECT page_id, url, {STORE_PATH} AS image_path FROM images")
add("url11_relative_path_x", f"{IMG} SELECT page_id, url, '../' || {STORE_PATH} AS rel_path FROM images")
add("url12_site_dir", f"SELECT page_id, {HOST} || '_8080' AS site_dir FROM pages")

# Tokens
add("tok1_round_trip", "SELECT page_id, html FROM pages")


def times(pattern: str, text: str = "html", flags: str = "s") -> str:
    return f"CAST(len(regexp_extract_all({text}, '{pattern}', 0, '{flags}')) AS BIGINT)"


REDUCED = """regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<style>.*?</style>', '<!r>', 'gs'),
  '<script>.*?</script>', '<!r>', 'gs'), '<!--.*?-->', '<!c>', 'gs'), '<title>.*?</title>', '<!t>', 'gs')"""
add("tok1_token_kinds", f"""SELECT page_id, CAST(len(list_filter(regexp_split_to_array(h, '<[^>]*>'), lambda t: t <> '')) AS BIGINT) AS n_text,
  {times('<[a-z][^>]*>', 'h')} AS n_open, {times('</[^>]*>', 'h')} AS n_close, {times('<!c>', 'h')} AS n_comment,
  {times('<!r>', 'h')} AS n_raw, {times('<!t>', 'h')} AS n_rcdata, {times('<!D[^>]*>', 'h')} AS n_declaration
  FROM (SELECT page_id, {REDUCED} AS h FROM pages)""")
add("tok2_attrs_x", f"""{X}, refs AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS value,
    generate_subscripts(regexp_extract_all(html, '<a href="([^"]*)"', 1), 1) AS n FROM x)
  SELECT page_id, CAST(n AS BIGINT) AS n, {decoded('value')} AS value FROM refs""")
FOOTER = "regexp_extract(html, '<footer>(.*?)</footer>', 1, 's')"
add("tok3_entities", f"SELECT page_id, {decoded(f'trim({FOOTER})')} AS text FROM pages")
add("tok4_element_span", f"""SELECT * FROM (
  SELECT page_id, 'nav' AS tag, 1 AS spans, 1 AS depth, 3 + 5 * {times('<li>')} AS width FROM pages
  UNION ALL SELECT page_id, 'ul', 1, 1, 1 + 5 * {times('<li>')} FROM pages
  UNION ALL SELECT page_id, 'li', {times('<li>')}, 1, 4 * {times('<li>')} FROM pages
  UNION ALL SELECT page_id, 'article', 1, 1, 1 + len(regexp_extract_all(inside, '<[^>]*>')) + len(list_filter(regexp_split_to_array(inside, '<[^>]*>'), lambda t: t <> ''))
      + len(regexp_extract_all(inside, '<[pb]>')) - len(regexp_extract_all(inside, '</[pb]>'))  -- ends of elements nobody closed
    FROM (SELECT page_id, regexp_extract(html, '<article>(.*)</article>', 1, 's') AS inside FROM pages)) WHERE spans > 0""")
add("tok5_element_text", f"""WITH found AS (
  SELECT page_id, 'title' AS tag, 1 AS n, regexp_extract(html, '<title>(.*?)</title>', 1, 's') AS t FROM pages
  UNION ALL SELECT page_id, 'h1', 1, regexp_extract(html, '<h1>(.*?)</h1>', 1, 's') FROM pages
  UNION ALL SELECT page_id, 'li', generate_subscripts(regexp_extract_all(html, '<li><a [^>]*>(.*?)</a>', 1), 1),
    unnest(regexp_extract_all(html, '<li><a [^>]*>(.*?)</a>', 1)) FROM pages)
  SELECT page_id, tag, CAST(n AS BIGINT) AS n, {decoded('trim(t)')} AS text FROM found""")
add("tok6_strip_boilerplate", f"SELECT page_id, {PLAIN} AS text FROM pages")
add("tok2_quoted_gt", "SELECT page_id, CAST(4 AS INTEGER) AS rule, CAST(3 AS INTEGER) AS columns, CAST(1 AS BIGINT) AS n_links FROM pages")
add("tok7_plaintext", f"SELECT page_id, {PLAIN} AS plaintext FROM pages")

# Content extraction
ART = "regexp_extract(html, '<article>(.*)</article>', 1, 's')"
add("ext1_heuristic", f"SELECT page_id, array_to_string({NODES.format(ART)}, chr(10)) AS text FROM pages")
add("ext1_heuristic_rule_x", "SELECT page_id, CASE WHEN page_id % 6 = 5 THEN 0 ELSE CAST(1 + page_id % 6 AS INTEGER) END AS rule FROM pages")
add("ext2_density", f"SELECT page_id, array_to_string({NODES.format(ART)}, chr(10)) AS text FROM pages")
# Each block by the rule: 1 + commas + a point per 100 characters (3 at most) a paragraph, less the share of link text, 25 for
# the name; the body gets half the points of the blocks in it. The first of the best counts.
add("ext2_density_scored", """WITH made AS (
  SELECT page_id, 1 + page_id % 3 AS ap, 6 + length(html) % 8 AS an, 1 + page_id % 13 AS bp, 30 + page_id % 400 AS bn, 40 + length(html) % 9 AS cn, 1 + page_id % 50 AS cl FROM pages),
points AS (SELECT *, CAST(ap * (1 + an + least(5 * an // 100, 3)) AS DOUBLE) AS a, CAST(bp * (1 + least(bn // 100, 3)) AS DOUBLE) AS b,
  CAST(1 + least((cn + cl) // 100, 3) AS DOUBLE) AS c, 5 * an * ap + bn * bp + cn + cl AS chars FROM made),
texts AS (SELECT *, array_to_string(list_transform(range(ap), lambda i: repeat('abcd,', an)), chr(10)) AS text_a,
  array_to_string(list_transform(range(bp), lambda i: repeat('z', bn)), chr(10)) AS text_b, repeat('y', cn) || chr(10) || repeat('x', cl) AS text_c FROM points),
blocks AS (
  SELECT page_id, 0 AS place, (a + b + c) / 2 * (1 - CAST(cl AS DOUBLE) / chars) AS score, text_a || chr(10) || text_b || chr(10) || text_c AS text FROM texts
  UNION ALL SELECT page_id, 1, a, text_a FROM texts UNION ALL SELECT page_id, 2, b - 25, text_b FROM texts
  UNION ALL SELECT page_id, 3, c * (1 - CAST(cl AS DOUBLE) / (cn + cl)) + 25, text_c FROM texts)
SELECT page_id, text FROM blocks QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY score DESC, place) = 1""")
add("ext3_full", f"SELECT page_id, {PLAIN} AS text FROM pages")
add("ext4_extract_fallback_x", f"""SELECT page_id, CASE WHEN {PLAIN} LIKE 'T%' THEN 'true' ELSE 'false' END AS from_top
  FROM pages WHERE page_id % 6 = 5""")
add("ext4_extract_fallback", f"SELECT page_id, {PLAIN} AS text FROM pages")
TITLE = decoded(r"trim(regexp_extract(html, '<title>(.*?)</title>', 1, 's'))")
add("ext5_title", f"SELECT page_id, {TITLE} AS title FROM pages")

# Metadata
META = """m AS (SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'H' ELSE 'T' END || CAST(page_id AS VARCHAR) AS title,
  CASE WHEN page_id % 4 = 2 THEN 'J' || CAST(page_id AS VARCHAR) WHEN page_id % 3 = 0 THEN NULL
    ELSE 'D: ' || CAST(page_id AS VARCHAR) END AS description,
  CASE page_id % 4 WHEN 0 THEN 'J, K' WHEN 2 THEN 'N' || CAST(page_id AS VARCHAR) WHEN 3 THEN 'S' || CAST(page_id AS VARCHAR)
    ELSE 'A' || CAST(page_id % 7 AS VARCHAR) END AS author,
  CASE WHEN page_id % 4 = 2 THEN '2025-02-03' ELSE '2024-01-' || lpad(CAST(1 + page_id % 28 AS VARCHAR), 2, '0') END AS published,
  CASE WHEN page_id % 4 = 3 THEN '2025-03-04' END AS modified, '/c/' || CAST(page_id AS VARCHAR) AS canonical_url,
  regexp_extract(html, '<html lang="([a-z]+)"', 1) AS language, 'k' || CAST(page_id % 5 AS VARCHAR) || '|news|x' AS keywords,
  'Site & ' || CAST(page_id % 3 AS VARCHAR) AS site_name, '/og' || CAST(page_id AS VARCHAR) || '.png' AS image,
  CASE page_id % 4 WHEN 0 THEN 'Article' WHEN 2 THEN 'BlogPosting' WHEN 3 THEN 'WebPage' END AS schema_type FROM pages)"""
for _name, _columns in {
    "mta1_title_x": "title", "mta2_description_x": "description", "mta3_author_x": "author", "mta4_published_x": "published",
    "mta5_modified_x": "modified", "mta6_canonical_url_x": "canonical_url", "mta8_keywords_x": "keywords",
    "mta9_site_name_image_x": "site_name, image", "mta12_schema_type_x": "schema_type",
}.items():
    add(_name, f"WITH {META} SELECT page_id, {_columns} FROM m")
add("mta1_title", f"SELECT page_id, {TITLE} AS title FROM pages")
add("mta7_language", "SELECT page_id, regexp_extract(html, '<html lang=\"([a-z]+)\"', 1) AS language FROM pages")
add("mta10_jsonld_override_x", """SELECT page_id,
  CASE page_id % 4 WHEN 0 THEN 'Article' WHEN 2 THEN 'BlogPosting' ELSE 'WebPage' END AS schema_type,
  CASE WHEN page_id % 4 = 0 THEN 'H' || CAST(page_id AS VARCHAR) END AS headline,
  CASE WHEN page_id % 4 = 2 THEN 'J' || CAST(page_id AS VARCHAR) END AS description,
  CASE WHEN page_id % 4 = 2 THEN '2025-02-03' END AS published, CASE WHEN page_id % 4 = 3 THEN '2025-03-04' END AS modified
  FROM pages WHERE page_id % 4 <> 1""")
add("mta10_repeated_keys", """SELECT page_id, 'H' || page_id AS headline, 'A' || page_id AS author, 'https://a.example.org/' || page_id AS target FROM pages""")
add("mta11_jsonld_author_x", f"WITH {META} SELECT page_id, author FROM m WHERE page_id % 4 <> 1")
_FIELDS = ["title", "description", "author", "published", "modified", "canonical_url", "language", "keywords", "site_name", "image", "schema_type"]
add("mta13_null_drop_x", f"WITH {META} SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT page_id, CAST({n} AS BIGINT) AS n, '{f}' AS key, {f} AS value FROM m" for n, f in enumerate(_FIELDS)) + ") WHERE value IS NOT NULL")


def front(url: str, words: str, tokens: str) -> str:
    """Front matter of an enriched page; only descriptions with a colon and URLs need quotes."""
    def line(key: str, value: str) -> str:
        return f"coalesce('{key}: ' || {value} || chr(10), '')"

    quoted = "CASE WHEN description LIKE '%:%' THEN '\"' || description || '\"' ELSE description END"
    parts = [
        line("title", "title"), line("description", quoted), line("author", "author"), line("published", "published"),
        line("modified", "modified"), line("canonical_url", "canonical_url"), line("language", "language"),
        "'keywords:' || chr(10) || '  - ' || replace(keywords, '|', chr(10) || '  - ') || chr(10)",
        line("site_name", "site_name"), line("image", "image"), line("schema_type", "schema_type"),
        f"'url: \"' || {url} || '\"' || chr(10)", f"'word_count: ' || CAST({words} AS VARCHAR) || chr(10)",
        f"'estimated_tokens: ' || CAST({tokens} AS VARCHAR) || chr(10)"]
    return "'---' || chr(10) || " + " || ".join(parts) + " || '---'"


add("mta14_front_matter_x", f"""WITH {K}, {META} SELECT m.page_id, {front(URL, 'm.page_id', 'm.page_id + 1')} AS front_matter
  FROM m JOIN k USING (page_id)""")

# Links and the walk
add("lnk1_extract_links", f"""SELECT DISTINCT page_id, split_part(url, '://', 1) || '://' || {HOST}
  || unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS url FROM pages""")
add("lnk1_extract_links_x", f"{LINKED} SELECT DISTINCT page_id, url FROM found WHERE via = 'href' AND url LIKE '%.org/p/%'")
add("lnk2_data_href_x", f"{LINKED} SELECT DISTINCT page_id, url FROM found WHERE via = 'data-href'")
add("lnk3_jsonld_links_x", f"{LINKED} SELECT DISTINCT page_id, url FROM found WHERE via = 'json-ld'")
add("lnk4_link_counts_x", f"""{LINKED}, once AS (SELECT DISTINCT page_id, url FROM found)
  SELECT once.page_id, count(*) AS found, count(*) FILTER (WHERE own.url IS NULL) AS enqueued
  FROM once LEFT JOIN (SELECT {URL} AS url FROM k) AS own USING (url) GROUP BY once.page_id""")


def walk(where: str, expand: str = "true") -> str:
    """Breadth-first walk: shortest chain of URLs from the start, smallest first among equals."""
    return f"""{LINKED}, own AS (SELECT page_id, {URL} AS url FROM k WHERE page_id % 3 = 0),
  edges AS (SELECT DISTINCT own.url AS source, found.url FROM found JOIN own USING (page_id)
    WHERE found.url LIKE '{where}' AND {expand}),
  reach(url, depth, chain) AS (
    SELECT '{START}', 0, ['{START}']
    UNION ALL SELECT e.url, r.depth + 1, list_append(r.chain, e.url) FROM reach r JOIN edges e ON e.source = r.url
    WHERE NOT list_contains(r.chain, e.url)),
  best AS (SELECT url, min(depth) AS depth FROM reach GROUP BY url),
  first AS (SELECT r.url, r.depth, min(r.chain) AS chain FROM reach r JOIN best USING (url, depth) GROUP BY r.url, r.depth),
  walk AS (SELECT CAST(row_number() OVER (ORDER BY depth, chain) AS BIGINT) AS rank, depth, f.url,
    CASE WHEN own.page_id IS NULL THEN 'skipped' ELSE 'saved' END AS status, coalesce(own.page_id, -1) AS page_id
    FROM first f LEFT JOIN own USING (url))"""


add("crl1_crawl_x", f"{walk('%')} SELECT * FROM walk")
add("crl3_prefix_x", f"{walk('%.org/p/%')} SELECT * FROM walk")
add("crl2_max_pages_x", f"""{walk('%.org/p/%')} SELECT * FROM walk WHERE rank <= (
  SELECT max(rank) FROM (SELECT rank FROM walk WHERE status = 'saved' ORDER BY rank LIMIT 10))""")
add("crl4_single_x", f"SELECT CAST(1 AS BIGINT) AS rank, 0 AS depth, '{START}' AS url, 'saved' AS status, CAST(0 AS BIGINT) AS page_id")
add("crl5_missing_pages", f"""WITH start AS (SELECT split_part(url, '://', 1) AS scheme, {HOST} AS host, {NORM} AS norm, html FROM pages WHERE page_id = 0)
  SELECT 0 AS depth, norm AS url, 'saved' AS status FROM start
  UNION ALL SELECT DISTINCT 1, scheme || '://' || host || unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)), 'skipped' FROM start""")
_STORED = "own.page_id % 12 <> 3"
add("crl6_resume_x", f"""{walk('%.org/p/%', _STORED)} SELECT rank, depth, url,
  CASE WHEN page_id % 12 = 3 AND page_id > 0 THEN 'exists' ELSE status END AS status, page_id FROM walk""")

# Images
for _name, _via in {"img1_img_urls_x": "'src', 'data-src'", "img2_srcset_urls_x": "'srcset'", "img3_css_background_x": "'background'"}.items():
    add(_name, f"{IMG} SELECT page_id, via, url FROM images WHERE via IN ({_via})")
add("img4_image_set_x", f"{IMG} SELECT page_id, url FROM images")
add("img5_image_manifest_x", f"""{IMG}, each AS (SELECT DISTINCT url, {STORE_PATH} AS path FROM images),
  known AS (SELECT DISTINCT {STORE_PATH} AS path FROM images WHERE page_id % 2 = 0)
  SELECT url, path, CASE WHEN path IN (SELECT path FROM known) THEN 'exists' ELSE 'to fetch' END AS status,
  CASE WHEN count(*) OVER (PARTITION BY path) > 1 THEN 'true' ELSE 'false' END AS collides FROM each""")
add("img6_alt_text_x", f"{IMG} SELECT page_id, url, alt FROM images")
add("img7_image_heading_x", f"{IMG} SELECT page_id, url, heading FROM images")
add("img8_inline_image_x", "SELECT page_id, '![Alt ' || CAST(page_id AS VARCHAR) || '](../images/img/' || CAST(page_id AS VARCHAR) || '.png)' AS md FROM pages")
MD_IMG = f"'![' || alt || '](../' || {STORE_PATH} || ')'"
add("img9_place_image_x", f"""{IMG} SELECT page_id, CAST(ord AS BIGINT) AS n, {MD_IMG} AS line FROM images WHERE ord < 6""")

# Formulas
FORMULAS = """SELECT page_id, CASE page_id % 5 WHEN 1 THEN 'script' WHEN 3 THEN 'mathjax' WHEN 4 THEN 'image' ELSE 'mathml' END AS source,
  CASE WHEN page_id % 5 IN (0, 1, 4) THEN 'true' ELSE 'false' END AS is_block,
  CASE page_id % 5 WHEN 0 THEN 'x^2' WHEN 1 THEN 'a+b' WHEN 2 THEN chr(92) || 'frac{a}{2}' WHEN 3 THEN 'y' ELSE 'z_1' END AS latex FROM pages"""
add("mth1_mathml_alttext_x", FORMULAS + " WHERE page_id % 5 IN (0, 2)")
add("mth2_mathjax_script_x", FORMULAS + " WHERE page_id % 5 = 1")
add("mth3_katex", """SELECT page_id, 'katex' AS source, CASE WHEN page_id % 2 = 0 THEN 'true' ELSE 'false' END AS is_block,
  'v_{' || CAST(page_id AS VARCHAR) || '}' AS latex FROM pages""")
add("mth4_mjx_container_x", FORMULAS + " WHERE page_id % 5 = 3")
add("mth5_equation_image_x", FORMULAS + " WHERE page_id % 5 = 4")
add("mth6_mathml_fold", """SELECT page_id, chr(92) || 'frac{{a}^{' || CAST(page_id AS VARCHAR) || '} - ' || chr(92) || 'sqrt{b}}{' || chr(92)
  || 'left( c , ' || CAST(page_id AS VARCHAR) || ' ' || chr(92) || 'right)} ' || chr(92) || 'leq {' || chr(92) || 'sum}_{i}^{'
  || chr(92) || 'mathrm{max}}' AS latex FROM pages""")

# Tables and code
add("tbl1_flatten_nested", """SELECT page_id, CAST(1 AS INTEGER) AS table_no, 1 AS row_no, 1 AS col_no,
    'a' || CAST(page_id AS VARCHAR) || ' n' || CAST(page_id AS VARCHAR) || ' m z' AS text FROM pages
  UNION ALL SELECT page_id, 1, 1, 2, 'b' FROM pages""")
CELLS = """cells AS (
  SELECT page_id, 1 AS row_no, CAST(1 + g AS INTEGER) AS col_no, 'true' AS is_header, CASE WHEN g = 0 THEN 'false' ELSE 'true' END AS filled,
    CASE WHEN g = 0 THEN 'h' ELSE '' END AS text FROM pages, generate_series(0, 2) AS t(g) WHERE g <= page_id % 3
  UNION ALL SELECT page_id, 1, CAST(2 + page_id % 3 AS INTEGER), 'true', 'false', 'i' FROM pages
  UNION ALL SELECT page_id, 2, 1, 'false', 'false', 'r' || CAST(page_id AS VARCHAR) FROM pages
  UNION ALL SELECT page_id, 2, 2, 'false', 'false', 'v' FROM pages
  UNION ALL SELECT page_id, 3, 1, 'false', 'true', '' FROM pages WHERE page_id % 2 = 1
  UNION ALL SELECT page_id, 3, CAST(1 + page_id % 2 AS INTEGER), 'false', 'false', 'w' FROM pages)"""
add("tbl2_colspan_x", f"WITH {CELLS} SELECT page_id, col_no, filled, text FROM cells WHERE row_no = 1")
add("tbl3_rowspan_x", f"WITH {CELLS} SELECT page_id, col_no, filled, text FROM cells WHERE row_no = 3")
add("tbl2_wide_colspan", """SELECT page_id, CAST(page_id % 600 + 1001 AS BIGINT) AS n_cells, CAST(page_id % 600 + 999 AS BIGINT) AS n_filled,
  CAST(page_id % 600 + 1001 AS INTEGER) AS v_col FROM pages""")
# A cell put into a row moves what stands at or behind its column; the span of two rows up comes first, if it is three high.
add("tbl3_tall_spans", """WITH RECURSIVE g AS (
  SELECT page_id, 1 AS row_no, 1 AS t, 2 AS p, 0 AS above, 2 AS n FROM pages
  UNION ALL SELECT page_id, row_no + 1, t1 + CASE WHEN t <= t1 THEN 1 ELSE 0 END, p1 + CASE WHEN t <= p1 THEN 1 ELSE 0 END, t, n1 + 1
  FROM (SELECT page_id, row_no, t, 1 + CASE WHEN two AND above <= 1 THEN 1 ELSE 0 END AS t1, 2 + CASE WHEN two AND above <= 2 THEN 1 ELSE 0 END AS p1,
    2 + CASE WHEN two THEN 1 ELSE 0 END AS n1 FROM (SELECT *, row_no > 1 AND (row_no - 1 + page_id) % 2 = 1 AS two FROM g WHERE row_no < 20)))
  SELECT page_id, CAST(row_no AS INTEGER) AS row_no, CAST(n AS BIGINT) AS n_cells, CAST(t AS INTEGER) AS t_col, CAST(p AS INTEGER) AS p_col FROM g""")
add("tbl4_table_cells_x", f"WITH {CELLS} SELECT page_id, CAST(1 AS INTEGER) AS table_no, row_no, col_no, is_header, filled, text FROM cells")
LANG = "CASE page_id % 4 WHEN 0 THEN 'python' WHEN 1 THEN 'sql' WHEN 2 THEN 'rust' ELSE '' END"
CODE = "'p(' || CAST(page_id AS VARCHAR) || ')'"
FENCE = f"'```' || {LANG} || chr(10) || {CODE} || chr(10) || '```'"
add("cod1_code_lang_x", f"SELECT page_id, {LANG} AS lang FROM pages")
add("cod2_code_fence_x", f"SELECT page_id, {FENCE} AS fence FROM pages")
add("cod3_code_blocks_x", f"SELECT page_id, CAST(1 AS INTEGER) AS n, {LANG} AS lang, {CODE} AS code, CAST(1 AS INTEGER) AS lines FROM pages")
add("cod3_language_counts_x", f"SELECT {LANG} AS lang, count(*) AS blocks, count(*) AS lines FROM pages GROUP BY 1")

# Markdown
TOKENS = "CAST({0} AS BIGINT) * 13 // 10"
add("md1_headings", f"WITH {MD} SELECT page_id, CAST(1 AS BIGINT) AS n, '# ' || h1 AS line FROM md")
MD_ARTICLE = f"art_md AS (WITH {MD} SELECT page_id, h1, body FROM md)"
add("md1_headings_x", f"""WITH {MD_ARTICLE}, {META} SELECT page_id, CAST(n AS BIGINT) AS n, line FROM (
  SELECT page_id, 2 AS n, '##  Figure ' || CAST(page_id AS VARCHAR) AS line FROM pages
  UNION ALL SELECT page_id, 3, '# ' || h1 FROM art_md
  UNION ALL SELECT page_id, 1, '# ' || {TITLE} FROM pages)""")
LINES = "lines AS (SELECT page_id, unnest(string_split(body, chr(10))) AS line, generate_subscripts(string_split(body, chr(10)), 1) AS place FROM md)"
add("md4_line_break", f"""WITH {MD}, {LINES} SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY place) AS BIGINT) AS n, line
  FROM lines WHERE line LIKE '%  '""")
add("md5_links_x", f"""WITH {K} SELECT page_id, CAST(1 AS BIGINT) AS n, '[L](/p/' || CAST(2 * i + 1 AS VARCHAR) || ') [R]( /p/' || CAST(2 * i + 2 AS VARCHAR)
  || '/?utm_medium=q#t) [U](/p/' || CAST(CAST(floor((i - 1) / 2) AS BIGINT) AS VARCHAR) || ')' AS line FROM k""")
add("md6_images_x", "SELECT page_id, CAST(1 AS BIGINT) AS n, '![Alt ' || CAST(page_id AS VARCHAR) || '](../images/img/' || CAST(page_id AS VARCHAR) || '.png)' AS line FROM pages")
add("md7_lists_x", """SELECT page_id, CAST(n AS BIGINT) AS n, line FROM (SELECT page_id, 1 AS n, '  1. one ' || CAST(page_id AS VARCHAR) AS line FROM pages
  UNION ALL SELECT page_id, 2, '  2. two' FROM pages UNION ALL SELECT page_id, 3, '    * sub' FROM pages)""")
TABLE = ["'h| ' || repeat('| ', page_id % 3) || 'i  '", "'---|---' || repeat('|---', page_id % 3) || '  '",
         "'r' || CAST(page_id AS VARCHAR) || '| v  '", "CASE WHEN page_id % 2 = 1 THEN '| w  ' ELSE 'w  ' END"]
add("md8_tables_x", "SELECT page_id, CAST(n AS BIGINT) AS n, line FROM (" + " UNION ALL ".join(
    f"SELECT page_id, {n + 1} AS n, {line} AS line FROM pages" for n, line in enumerate(TABLE)) + ") WHERE line LIKE '%|%'")
add("md9_code_x", f"""SELECT page_id, CAST(n AS BIGINT) AS n, line FROM (SELECT page_id, 1 AS n, '```' || {LANG} AS line FROM pages
  UNION ALL SELECT page_id, 2, {CODE} FROM pages UNION ALL SELECT page_id, 3, '```' FROM pages
  UNION ALL SELECT page_id, 4, '_em_ `c' || CAST(page_id AS VARCHAR) || '`' FROM pages)""")
add("md10_blockquote_hr_x", """SELECT page_id, CAST(n AS BIGINT) AS n, line FROM (SELECT page_id, 1 AS n, '> quote ' || CAST(page_id AS VARCHAR) AS line FROM pages
  UNION ALL SELECT page_id, 2, '* * *' FROM pages)""")
add("md11_escape_x", r"""SELECT page_id, CAST(n AS BIGINT) AS n, line FROM (SELECT page_id, 1 AS n, '1' || chr(92) || '. start' AS line FROM pages
  UNION ALL SELECT page_id, 2, chr(92) || '- dash' FROM pages)""")
add("md12_abbr_x", "SELECT page_id, CAST(1 AS BIGINT) AS n, '  *[AB' || CAST(page_id AS VARCHAR) || ']: Long ' || CAST(page_id AS VARCHAR) AS line FROM pages")
add("md2_paragraphs", f"""WITH {MD}, parts AS (SELECT page_id, string_split(body, chr(10) || chr(10)) AS p FROM md)
  SELECT page_id, CAST(generate_subscripts(p, 1) AS BIGINT) AS n, unnest(p) AS paragraph FROM parts""")
add("md3_emphasis", f"""WITH {MD}, marked AS (SELECT page_id, regexp_extract_all(body, '[*][*](.*?)[*][*]', 1, 's') AS found FROM md)
  SELECT page_id, CAST(generate_subscripts(found, 1) AS BIGINT) AS n, unnest(found) AS strong FROM marked""")


def document(body: str, url: str, file_path: str) -> str:
    words = WORDS.format(body)
    text = (
        f"'---' || chr(10) || 'title: ' || {yaml(TITLE)} || chr(10) || 'language: ' || regexp_extract(html, '<html lang=\"([a-z]+)\"', 1) || chr(10)"
        f" || 'url: \"' || {url} || '\"' || chr(10) || 'word_count: ' || CAST({words} AS VARCHAR) || chr(10)"
        f" || 'estimated_tokens: ' || CAST({TOKENS.format(words)} AS VARCHAR) || chr(10) || '---' || repeat(chr(10), 2)"
        f" || '> Source: <' || {url} || '>' || repeat(chr(10), 4) || {body} || chr(10)")
    return f"{file_path} AS file_path, {text} AS content"


def yaml(value: str) -> str:
    return (f"""CASE WHEN regexp_matches({value}, '[:"''#\\[\\]{{}}]') THEN '"' || replace(replace({value}, chr(92), chr(92) || chr(92)), '"', chr(92) || '"') || '"' """
            f"ELSE {value} END")


SINGLE_FILE = f"regexp_replace(split_part({PATH.format(NORM)}, '/', 2), '\\.html$', '') || '.md'"
SITE_FILE = (f"{HOST} || '/' || regexp_replace({PATH.format(NORM)}, '\\.html$', '')"
             " || CASE WHEN url LIKE '%?page=2%' THEN '_page=2' ELSE '' END || '.md'")
add("md13_assemble", f"WITH {MD} SELECT page_id, {document('body', 'url', SINGLE_FILE)} FROM md")
add("md14_convert", f"""WITH {MD} SELECT page_id, {NORM} AS url, {document('body', NORM, SITE_FILE)},
  CAST({WORDS.format('body')} AS BIGINT) AS word_count, CAST({TOKENS.format(WORDS.format('body'))} AS BIGINT) AS estimated_tokens FROM md""")

# Whole pages: navigation list, advertisement, article, footer.
NAV_MD = "'* ' || array_to_string(list_transform(regexp_extract_all(html, '<li><a href=\"([^\"]*)\">', 1), lambda r: '[' || " \
    + decoded("substr(r, 2)") + " || '](' || " + decoded("r") + " || ')'), chr(10) || '  * ') || repeat(chr(10), 4)"
AD_MD = decoded(squeezed("regexp_extract(html, '<div class=\"ad\">(.*?)</div>', 1, 's')")) + " || repeat(chr(10), 2)"
FOOT_MD = decoded(squeezed(FOOTER))
MD_RAW = ARTICLE.format(strip="ltrim")
WHOLE = f"{NAV_MD} || {AD_MD} || body || CASE WHEN right(body, 2) = repeat(chr(10), 2) THEN '' ELSE '' END || {FOOT_MD}"
add("md5_links_full", f"WITH {MD_RAW} SELECT page_id, {WHOLE} AS body FROM md")

ENRICHED = """'[L](/p/' || CAST(2 * i + 1 AS VARCHAR) || ') [R]( /p/' || CAST(2 * i + 2 AS VARCHAR) || '/?utm_medium=q#t) [U](/p/'
  || CAST(CAST(floor((i - 1) / 2) AS BIGINT) AS VARCHAR) || ')' || nl || '[m](mailto:x@y.z) [f](/f/' || CAST(i AS VARCHAR)
  || '.PDF) [o](https://other.example.org/) **d**' || nl || '##  Figure ' || k || nl || '![Alt ' || k || '](../images/img/' || k || '.png)' || nl || 'bg' || nl
  || CASE page_id % 5 WHEN 0 THEN 'F ' || nl || '$$x^2$$' || nl || 'G' WHEN 1 THEN 'F ' || nl || '$$a+b$$' || nl || 'G'
     WHEN 2 THEN 'F $' || chr(92) || 'frac{a}{2}$ G' WHEN 3 THEN 'F $y$ G' ELSE 'F ' || nl || '$$z_1$$' || nl || 'G' END || nl
  || """ + " || chr(10) || ".join(TABLE) + f""" || chr(10) || '  ' || chr(10) || {FENCE} || nl
  || '  1. one ' || k || chr(10) || '  2. two' || chr(10) || '    * sub' || repeat(chr(10), 4) || '> quote ' || k || nl || '* * *' || nl
  || '1' || chr(92) || '. start' || nl || chr(92) || '- dash' || nl || '_em_ `c' || k || '`' || nl || 'AB' || k || nl"""
PLACED = f"""placed AS (SELECT page_id, string_agg(chr(10) || chr(10) || {MD_IMG}, '' ORDER BY ord) AS pics FROM images WHERE ord BETWEEN 2 AND 5 GROUP BY page_id)"""
BODY_X = f"""body_x AS (SELECT md.page_id, site, k, i, html, h1,
  trim(CASE WHEN md.page_id % 6 = 5 THEN {NAV_MD} || {AD_MD} ELSE '' END || {ENRICHED} || body
  || CASE WHEN md.page_id % 6 = 5 THEN {FOOT_MD} ELSE '' END, chr(10) || ' ') || chr(10) || '  *[AB' || k || ']: Long ' || k AS bare, bare || pics AS body
  FROM (SELECT *, repeat(chr(10), 2) AS nl FROM md) AS md JOIN k USING (page_id) JOIN placed USING (page_id))"""
FULL_X = f"""WITH {MD_RAW}, {K}, {IMAGES}, {PLACED}, {BODY_X}, {META},
sized AS (SELECT *, {WORDS.format('body')} AS w FROM body_x JOIN m USING (page_id)),
documents AS (SELECT page_id, {URL} AS url, {FILE} AS file_path, {front(URL, 'w', TOKENS.format('w'))} || repeat(chr(10), 2)
  || '# ' || title || repeat(chr(10), 2) || '> Source: <' || {URL} || '>' || repeat(chr(10), 4) || body || chr(10) AS content,
  CAST(w AS BIGINT) AS word_count, CAST({TOKENS.format('w')} AS BIGINT) AS estimated_tokens, replace(site, 'https://', '') AS site FROM sized)"""
add("md14_convert_x", f"{FULL_X} SELECT page_id, url, file_path, content, word_count, estimated_tokens FROM documents")
add("snk1_write_markdown_x", f"{FULL_X} SELECT page_id, site, file_path, content FROM documents")

# Measures and reports
DOC_WORDS = "CAST(len(list_filter(regexp_split_to_array(text, '[\\s\\x1c-\\x1f\\x85\\xa0\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+'), lambda w: w <> '')) AS BIGINT)"
add("txt1_word_count", f"SELECT doc_id, {DOC_WORDS} AS words FROM documents")
add("txt2_token_estimate", f"SELECT doc_id, CAST({DOC_WORDS} * 13 // 10 AS BIGINT) AS tokens FROM documents")
add("txt3_sizes", "SELECT doc_id, CAST(length(text) AS BIGINT) AS chars, CAST(octet_length(encode(text)) AS BIGINT) AS bytes FROM documents")

MEASURED = f"""{MD}, reps AS (
  SELECT page_id, url, 'html' AS representation, html AS t FROM pages
  UNION ALL SELECT page_id, url, 'plaintext', {PLAIN} FROM pages
  UNION ALL SELECT page_id, url, 'markdown', body FROM md),
measured AS (SELECT page_id, {HOST} AS host, representation, CAST(length(t) AS BIGINT) AS chars, CAST(octet_length(encode(t)) AS BIGINT) AS bytes,
  CAST({WORDS.format('t')} AS BIGINT) AS words, CAST({TOKENS.format(WORDS.format('t'))} AS BIGINT) AS tokens FROM reps)"""
add("rpt1_representation_report", f"WITH {MEASURED} SELECT page_id, representation, chars, bytes, words, tokens FROM measured")


def ratio(metric: str) -> str:
    tenths = f"((20 * h.{metric} + m.{metric}) // (2 * m.{metric}))"
    return (f"CASE WHEN m.{metric} = 0 THEN 'N/A' ELSE CAST({tenths} // 10 AS VARCHAR) || '.' || CAST({tenths} % 10 AS VARCHAR) || 'x' END AS {metric}")


add("rpt2_compression", f"""WITH {MEASURED} SELECT h.page_id, {', '.join(ratio(m) for m in ('chars', 'bytes', 'words', 'tokens'))}
  FROM measured h JOIN measured m USING (page_id) WHERE h.representation = 'html' AND m.representation = 'markdown'""")
add("rpt3_token_savings", f"""WITH {MEASURED}, summed AS (
  SELECT CASE WHEN grouping(page_id) = 0 THEN 'page' WHEN grouping(host) = 0 THEN 'host' ELSE 'corpus' END AS level,
    coalesce(host, '') AS host, coalesce(page_id, -1) AS page_id,
    CAST(sum(tokens) FILTER (WHERE representation = 'html') AS BIGINT) AS html_tokens,
    CAST(sum(tokens) FILTER (WHERE representation = 'markdown') AS BIGINT) AS markdown_tokens
  FROM measured GROUP BY ROLLUP (host, page_id))
  SELECT level, host, page_id, html_tokens, markdown_tokens, html_tokens - markdown_tokens AS saved_tokens,
    CAST(floor((2000.0 * (html_tokens - markdown_tokens) + html_tokens) / (2 * html_tokens)) AS DOUBLE) / 10 AS saved_percent FROM summed""")
add("rpt4_job_result", f"""WITH {MD} SELECT 'true' AS success, CAST(count(*) AS VARCHAR) AS pages_saved,
  CAST(sum({WORDS.format('body')}) AS VARCHAR) AS total_words, '' AS error FROM (
  SELECT *, row_number() OVER (PARTITION BY {SITE_FILE} ORDER BY page_id) AS nth FROM md) WHERE nth = 1""")

# The walk over the enriched pages without images and metadata
SMALL_X = f"""{walk('%.org/p/%')}, {MD_RAW}, {IMAGES}, {PLACED}, {BODY_X}"""
add("crl7_crawl_summary_x", f"""{SMALL_X}, sized AS (SELECT page_id, {WORDS.format('bare')} AS w FROM body_x)
  SELECT count(*) FILTER (WHERE status = 'saved') AS saved, count(*) FILTER (WHERE status = 'skipped') AS skipped,
  count(*) FILTER (WHERE status = 'exists') AS already_exists, CAST(sum(w) AS BIGINT) AS total_words,
  CAST(sum({TOKENS.format('w')}) AS BIGINT) AS total_tokens FROM walk LEFT JOIN sized USING (page_id)""")

add("crl7_crawl_images_x", f"""{walk('%.org/p/%')}, {IMAGES}, pictures AS (
    SELECT page_id, url, {STORE_PATH} AS path FROM images WHERE page_id IN (SELECT page_id FROM walk WHERE status = 'saved')),
  single AS (SELECT DISTINCT url, path FROM pictures), at_hand AS (SELECT DISTINCT path FROM pictures WHERE page_id % 2 = 0),
  marked AS (SELECT path IN (SELECT path FROM at_hand) AS stored, count(*) OVER (PARTITION BY path) > 1 AS collides FROM single)
  SELECT (SELECT count(*) FROM walk WHERE status = 'saved') AS saved, (SELECT count(*) FROM walk WHERE status = 'skipped') AS skipped, count(*) AS images,
  count(*) FILTER (WHERE NOT stored) AS images_to_fetch, count(*) FILTER (WHERE stored) AS images_existing, count(*) FILTER (WHERE collides) AS image_collisions FROM marked""")

# User-facing jobs
add("api1_convert_pages_x", f"WITH {K} SELECT page_id, {URL} AS url, {FILE} AS file_path FROM k WHERE page_id % 3 <> 1")
add("api2_crawl_site_x", f"{walk('%.org/p/%')} SELECT k.page_id, {URL} AS url, {FILE} AS file_path FROM walk JOIN k USING (page_id) WHERE status = 'saved'")
add("api3_build_corpus_x", f"""{walk('%.org/p/%')} SELECT k.page_id, replace(site, 'https://', '') AS site, {FILE} AS file_path
  FROM walk JOIN k USING (page_id) WHERE status = 'saved'""")
