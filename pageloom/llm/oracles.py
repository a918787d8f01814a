"""SQL counterparts of the queries that SQL can express; the others are tested against plain versions."""

from __future__ import annotations

from pageloom.llm import quality, redirects
from pageloom.llm.redirects import RULES

BREAK = r"[\x20\x09-\x0D]+"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def hits(pattern: str, of: str = "line") -> str:
    return f"len(regexp_extract_all({of}, {quoted(pattern)}))"


# Whole words without look-around: what is no letter or digit is doubled, in the text and in the phrases, so that two
# phrases in a row each have a boundary of their own.
DOUBLED = f"regexp_replace(line, {quoted(r'([^\p{L}\p{N}])')}, {quoted(r'\1\1')}, 'g')"
WHOLE = r"(?i)(?:^|[^\p{L}\p{N}])(?:" + quality.PHRASES.removeprefix("(?i)").replace(" ", "  ") + r")(?:$|[^\p{L}\p{N}])"

QUALITY = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT doc_id, t, list_filter(regexp_split_to_array(t, {quoted(BREAK)}), lambda x: x <> '') AS ws,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, {quoted(r'[^\x20\x09-\x0D]')})) AS ls
  FROM d),
spots AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) > 2),
windows AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i], ws[i + 1], ws[i + 2]) AS n FROM spots),
covered AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM windows WHERE n > 1) GROUP BY doc_id),
lines AS (
  SELECT doc_id, line, list_filter(regexp_split_to_array(line, {quoted(BREAK)}), lambda x: x <> '') AS lw
  FROM (SELECT doc_id, unnest(ls) AS line FROM w)),
clean AS (
  SELECT doc_id, sum(length(array_to_string(lw, ''))) AS chars FROM lines
  WHERE NOT ((len(lw) < 5 AND NOT regexp_matches(line, {quoted(quality.CLOSING)}))
    OR {hits(quality.SEPARATORS)} * 4 >= len(lw) OR {hits(quality.NOISE)} * 2 >= len(lw) OR {hits(quality.SHOUTED)} * 2 >= len(lw)
    OR (len(lw) >= 8 AND len(list_distinct(lw)) * 5 < len(lw) * 2) OR {hits(WHOLE, DOUBLED)} * {quality.FEWEST_WORDS_A_PHRASE} > len(lw))
  GROUP BY doc_id),
counted AS (
  SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
    CAST({hits(quality.SYMBOLS, 't')} AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words, coalesce(clean.chars, 0) AS clean_chars
  FROM w LEFT JOIN covered ON covered.doc_id = w.doc_id LEFT JOIN clean ON clean.doc_id = w.doc_id),
judged AS (
  SELECT *, n_words < {quality.FEWEST_WORDS} OR 100 * n_repeat_words > {quality.MOST_REPEATED_PERCENT} * n_words AS base_failed FROM counted)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND 100 * clean_chars >= {quality.LEAST_LEFT_PERCENT} * word_chars AS kept
FROM judged
"""

UPPER, LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'", "'abcdefghijklmnopqrstuvwxyz'"
BY_LENGTH = sorted(RULES, key=lambda r: -len(r[1] + r[2]))


def fits(rule: tuple[str, str, str]) -> str:
    _, host, start = rule
    return f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{start}')"


def cases(of: int | None) -> str:
    values = [r[1] + r[2] if of is None else r[of] for r in BY_LENGTH]
    return "CASE " + " ".join(f"WHEN {fits(r)} THEN '{v}'" for r, v in zip(BY_LENGTH, values, strict=True)) + " END"


def host(url: str) -> str:
    return f"translate(coalesce(regexp_extract({url}, '://([^/?#]*)', 1), ''), {UPPER}, {LOWER})"


def node(url: str) -> str:
    rest = f"regexp_extract({url}, '://[^/?#]*([^#]*)', 1)"
    pieces = f"regexp_extract_all({rest}, '{redirects.ESCAPE}|%|[^%]+')"
    plain = f"""array_to_string(list_transform({pieces}, lambda p: CASE WHEN regexp_matches(p, '^{redirects.NEEDLESS}$') THEN decode(unhex(p[2:3]))
      WHEN regexp_matches(p, '^{redirects.ESCAPE}$') THEN upper(p) ELSE p END), '')"""
    named = f"regexp_replace({host(url)}, ':(80|443)?$', '')"
    return f"CASE WHEN contains({url}, '://') AND {named} <> '' THEN {named} || CASE WHEN starts_with({rest}, '/') THEN '' ELSE '/' END || {plain} END"


def path(url: str) -> str:
    return f"coalesce(regexp_extract({url}, '://[^/?#]*([^?#]*)', 1), '')"


def attribute(name: str) -> str:
    found = f"""regexp_extract(tag, '(?is)[\\s"'']{name}\\s*=\\s*("[^"]*|''[^'']*|[^\\s"''>]+)', 1)"""
    return f"""trim(ltrim({found}, '"'''))"""


# Dot segments of a path, one after the other; the last one leaves its slash.
NO_DOTS = """CASE WHEN whole = '' THEN '' ELSE list_reduce(list_prepend('', string_split(whole, '/')[2:]), lambda done, part:
  CASE WHEN part = '..' THEN regexp_replace(done, '/[^/]*$', '') WHEN part = '.' THEN done ELSE done || '/' || part END)
  || CASE WHEN regexp_matches(whole, '(^|/)[.][.]?$') THEN '/' ELSE '' END END"""

# What a comment, a script or other raw text holds is no tag; one alternative an element, as there are no back references.
_ATTRS = """\\b(?:[^>"'']|"[^"]*"|''[^'']*'')*>"""
HIDDEN = "(?is)<!--.*?(?:-->|$)|" + "|".join(f"<{x}{_ATTRS}.*?(?:</{x}\\s*>|$)" for x in ("script", "style", "textarea", "title", "template"))

REDIRECTS = f"""
WITH RECURSIVE tags AS (
  SELECT url, unnest(regexp_extract_all(regexp_replace(html, '{HIDDEN}', ' ', 'g'), '(?is)<(?:link|meta)\\b(?:[^>"'']|"[^"]*"|''[^'']*'')*>')) AS tag FROM pages),
named AS (
  SELECT url, trim(regexp_replace(CASE WHEN regexp_matches({attribute('rel')}, '(?i)(^|\\s)canonical(\\s|$)') THEN {attribute('href')}
    WHEN regexp_matches({attribute('http-equiv')}, '(?i)^refresh$')
    THEN regexp_extract({attribute('content')}, '(?is)^\\s*[\\d.]*\\s*[;,]?\\s*url\\s*=\\s*[''"]?([^''"]*)', 1) END, '(?i)&(amp|#38|#x26);', '&', 'g')) AS target
  FROM tags WHERE regexp_matches(tag, '(?i)canonical|refresh')),
placed AS (
  SELECT url, target, regexp_extract(url, '(?s)^.*?://[^/?#]*') AS site, regexp_extract({path('url')}, '(?s)^.*/') AS folder FROM named WHERE target <> ''),
parts AS (
  SELECT *, regexp_extract(target, '(?s)^[^?#]*') AS named_path, regexp_extract(target, '(?s)^[^?#]*(.*)$', 1) AS rest,
    regexp_extract(target, '(?s)^//[^/?#]*') AS named_site FROM placed),
merged AS (
  SELECT *, CASE WHEN named_site <> '' THEN substr(named_path, len(named_site) + 1) WHEN starts_with(target, '/') THEN named_path WHEN named_path = '' THEN {path('url')}
    ELSE regexp_replace(CASE WHEN folder = '' THEN '/' ELSE folder END || named_path, '/+', '/', 'g') END AS whole FROM parts),
full_urls AS (
  SELECT url, CASE WHEN regexp_matches(target, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN target
    ELSE CASE WHEN named_site <> '' THEN 'x:' || named_site ELSE site END || {NO_DOTS} || rest END AS full_url FROM merged),
edges AS (SELECT {node('url')} AS a, {node('full_url')} AS b FROM full_urls),
sides AS (SELECT a, b FROM edges WHERE a <> b UNION SELECT b, a FROM edges WHERE a <> b),
reach AS (SELECT a AS node, a AS other FROM sides UNION SELECT reach.node, sides.b FROM reach JOIN sides ON reach.other = sides.a),
urls AS (SELECT node, 'x://' || other AS url FROM reach),
ruled AS (SELECT node, {host('url')} AS host, {path('url')} AS path FROM urls),
shared AS (SELECT node, min({cases(0)}) AS verdict FROM ruled GROUP BY node),
own AS (SELECT page_id, {host('url')} AS host, {path('url')} AS path, {node('url')} AS node FROM pages),
twin_urls AS (SELECT DISTINCT node, 'x://' || node AS url FROM own WHERE node IS NOT NULL),
twin_parts AS (SELECT node, {host('url')} AS host, {path('url')} AS path FROM twin_urls),
twins AS (SELECT node, {cases(0)} AS verdict FROM twin_parts)
SELECT page_id, host, path, {cases(None)} AS rule, coalesce({cases(0)}, shared.verdict, twins.verdict, 'allow') AS verdict
FROM own LEFT JOIN shared ON shared.node = own.node LEFT JOIN twins ON twins.node = own.node
"""

# crc32 of a number's digits, bit by bit; the constants are the polynomial and the mask of CRC-32.
CRC = """xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
  lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, i: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)), 4294967295)"""

PREFIXES = f"""
WITH turns AS (SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT c, list({{'role': role, 'text': text}} ORDER BY turn NULLS FIRST) AS turns FROM turns GROUP BY c),
asked AS (SELECT c, turns, {CRC} % 4 AS h, c - c % 20 AS base FROM own),
rebuilt AS (
  SELECT asked.c, list_concat(CASE WHEN own.turns IS NULL OR h = 0 THEN [] ELSE own.turns[1:h] END, asked.turns[h + 1:]) AS s
  FROM asked LEFT JOIN own ON own.c = asked.base),
prefixes AS (SELECT c, len(s) AS length, s, unnest(range(0, len(s) + 1)) AS depth FROM rebuilt),
members AS (SELECT c, length, depth, min(c) OVER (PARTITION BY depth, s[1:depth]) AS conv_id, s[depth].text AS last_text FROM prefixes),
nodes AS (
  SELECT conv_id, depth, count(*) AS n_convs, coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (length = depth), '') AS ends,
    CASE WHEN depth = 0 THEN 0 ELSE len(list_filter(regexp_split_to_array(any_value(last_text), {quoted(BREAK)}), lambda x: x <> '')) END AS words
  FROM members GROUP BY conv_id, depth),
placed AS (SELECT nodes.*, members.conv_id AS parent_conv_id FROM nodes LEFT JOIN members ON members.c = nodes.conv_id AND members.depth = nodes.depth - 1),
children AS (SELECT parent_conv_id AS conv_id, depth - 1 AS depth, count(*) AS n FROM placed WHERE depth > 0 GROUP BY ALL),
below AS (
  SELECT members.conv_id, members.depth, count(*) FILTER (children.n IS NULL) AS n_leaves, sum((nodes.n_convs - 1) * nodes.words) AS saved
  FROM nodes JOIN members ON members.c = nodes.conv_id AND members.depth <= nodes.depth
  LEFT JOIN children ON children.conv_id = nodes.conv_id AND children.depth = nodes.depth GROUP BY members.conv_id, members.depth)
SELECT conv_id, depth, parent_conv_id, n_convs, coalesce(children.n, 0) AS n_children, n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(ends) AS ends_sha256
FROM placed LEFT JOIN children USING (conv_id, depth) JOIN below USING (conv_id, depth)
"""

ORACLES: dict[str, str] = {"op5_quality_rules": QUALITY, "op7_url_filters": REDIRECTS, "op13_conversation_prefixes": PREFIXES}
