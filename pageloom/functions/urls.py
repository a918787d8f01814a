"""URL handling as column expressions.

URLs are split with the generic pattern of RFC 3986 appendix B, not with a strict URI parser: captured
links are often not valid URIs and must still be kept. Identical sub-expressions (the five parts) are
evaluated once per row by Spark's common-subexpression elimination; longer functions bind intermediate values
(``_bind``), which keeps plans small and works inside lambdas too, where nothing is shared.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# RFC 3986 appendix B: scheme, authority, path, query, fragment.
SPLIT = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"

# Query keys that only track where a visitor came from.
TRACKING_KEYS = [
    "utm_source", "utm_medium", "utm_campaign", "utm_content", "utm_term",
    "ref", "source", "open", "s", "r",
]

# File extensions that are never pages.
NON_PAGE_EXTENSIONS = [
    ".jpg", ".jpeg", ".png", ".gif", ".bmp", ".svg", ".ico", ".webp", ".avif",
    ".woff", ".woff2", ".ttf", ".eot", ".otf",
    ".css", ".js", ".mjs", ".map",
    ".xml", ".json", ".yaml", ".yml", ".toml", ".csv", ".rss", ".atom",
    ".zip", ".tar", ".gz", ".bz2", ".7z", ".rar",
    ".pdf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx",
    ".mp3", ".mp4", ".avi", ".mov", ".wmv", ".flv", ".ogg", ".webm", ".wav",
    ".exe", ".dmg", ".apk", ".deb", ".rpm", ".iso",
]

# Path parts of action and listing endpoints.
NON_PAGE_PATHS = [
    "/i/", "/comments", "/subscribe", "/embed", "/api/", "/action/", "/account/", "/publish/",
]

# Page extensions dropped from output names, link schemes that lead to no page.
PAGE_EXTENSIONS = [".html", ".htm", ".php", ".asp", ".aspx", ".jsp", ".shtml"]
NON_LINK = r"^(?:javascript:|mailto:|tel:|#|data:)"

FORBIDDEN = r'[<>:"/\\|?*]'
FORBIDDEN_OR_CONTROL = r'[<>:"/\\|?*\x00-\x1f]'


def _bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), 0)


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, SPLIT, group)


def scheme(url: Column) -> Column:
    return F.lower(_part(url, 1))


def netloc(url: Column) -> Column:
    return _part(url, 2)


def _full_path(url: Column) -> Column:
    return _part(url, 3)


def query(url: Column) -> Column:
    return _part(url, 4)


def fragment(url: Column) -> Column:
    return _part(url, 5)


def _has_params(url: Column) -> Column:
    return scheme(url).isin("http", "https", "")


def path(url: Column) -> Column:
    """Path without the ``;params`` of its last segment (web schemes only)."""
    full = _full_path(url)
    return F.when(_has_params(url), F.regexp_replace(full, r"(?s);[^/]*$", "")).otherwise(full)


def params(url: Column) -> Column:
    return F.when(_has_params(url), F.regexp_extract(_full_path(url), r"(?s);([^/]*)$", 1)).otherwise("")


def url_parts(url: Column) -> Column:
    """Struct of scheme, netloc, path, params, query, fragment."""
    return F.struct(
        scheme(url).alias("scheme"), netloc(url).alias("netloc"), path(url).alias("path"),
        params(url).alias("params"), query(url).alias("query"), fragment(url).alias("fragment"),
    )


def _unsplit(scheme_: Column, netloc_: Column, path_: Column, params_: Column, query_: Column, fragment_: Column) -> Column:
    def led(mark: str, part: Column) -> Column:
        return F.when(part == "", "").otherwise(F.concat(F.lit(mark), part))

    rooted = F.when((path_ != "") & ~path_.startswith("/"), F.concat(F.lit("/"), path_)).otherwise(path_)
    # Without a host, web schemes and paths that would read as a host still get their two slashes.
    bare = scheme_.isin("http", "https", "ftp", "file", "ws", "wss") & ((path_ == "") | path_.startswith("/"))
    return F.concat(
        F.when(scheme_ == "", "").otherwise(F.concat(scheme_, F.lit(":"))),
        F.when(netloc_ != "", F.concat(F.lit("//"), netloc_, rooted))
        .when(path_.startswith("//") | bare, F.concat(F.lit("//"), path_)).otherwise(path_),
        led(";", params_), led("?", query_), led("#", fragment_),
    )


def ensure_scheme(url: Column) -> Column:
    return F.when(url.rlike("^https?://"), url).otherwise(F.concat(F.lit("https://"), url))


def percent_decode(text: Column) -> Column:
    """Decode valid %XX escapes as UTF-8, leave malformed ones and ``+`` alone."""
    safe = F.regexp_replace(F.replace(text, F.lit("+"), F.lit("%2B")), r"%(?![0-9A-Fa-f]{2})", "%25")
    return F.when(text.contains("%"), F.url_decode(safe)).otherwise(text)


def _form_decode(text: Column) -> Column:
    return percent_decode(F.replace(text, F.lit("+"), F.lit("%20")))


def _form_encode(text: Column) -> Column:
    encoded = F.url_encode(text)
    return F.replace(F.replace(encoded, F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def query_pairs(url: Column) -> Column:
    """Decoded query as array<struct<k,v>>; blanks kept, empty pieces dropped."""
    pieces = F.filter(F.split(query(url), "&"), lambda p: p != "")
    return F.transform(
        pieces,
        lambda p: F.struct(
            _form_decode(F.substring_index(p, "=", 1)).alias("k"),
            _form_decode(F.when(F.instr(p, "=") > 0, F.regexp_replace(p, r"(?s)^[^=]*=", "")).otherwise("")).alias("v"),
        ),
    )


def _clean_query(url: Column) -> Column:
    def text(kept: Column) -> Column:
        keys = F.transform(kept, lambda p: p["k"])
        # A repeated key is written where it first occurs; positions are only looked up when one repeats.
        grouped = F.transform(
            F.array_sort(F.transform(
                kept, lambda p, i: F.struct(F.array_position(keys, p["k"]).alias("first"), i.alias("i"), p.alias("p")))),
            lambda s: s["p"])
        ordered = F.when(F.size(F.array_distinct(keys)) < F.size(keys), grouped).otherwise(kept)
        return F.array_join(
            F.transform(ordered, lambda p: F.concat(_form_encode(p["k"]), F.lit("="), _form_encode(p["v"]))), "&")

    kept = F.filter(query_pairs(url), lambda p: ~F.lower(p["k"]).isin(TRACKING_KEYS))
    return F.when(query(url) == "", "").otherwise(_bind(kept, text))


def normalize_url(url: Column) -> Column:
    """One spelling per page: no trailing slash, tracking keys or fragment; query re-encoded."""
    def join(p: Column) -> Column:
        return _unsplit(p["scheme"], p["netloc"], F.when(p["bare"] == "", "/").otherwise(p["bare"]), p["params"], p["query"], F.lit(""))

    return _bind(F.struct(
        scheme(url).alias("scheme"), netloc(url).alias("netloc"), F.regexp_replace(path(url), r"/+$", "").alias("bare"),
        params(url).alias("params"), _clean_query(url).alias("query")), join)


def _merge_dots(segments: Column) -> Column:
    return F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        .when(s == ".", acc).otherwise(F.concat(acc, F.array(s))),
    )


def _resolved_path(base_path: Column, ref_path: Column) -> Column:
    def merged(segments: Column) -> Column:
        directory = F.when(F.element_at(segments, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
        return F.array_join(F.concat(_merge_dots(segments), directory), "/")

    def squeezed(joined: Column) -> Column:
        return F.filter(joined, lambda s, i: (s != "") | (i == 0) | (i == F.size(joined) - 1))

    # The base directory ends with its last slash; everything behind it is replaced.
    directory = F.split(F.regexp_replace(base_path, r"/[^/]*$|^[^/]*$", ""), "/")
    directory = F.when(base_path.contains("/"), directory).otherwise(F.array().cast("array<string>"))
    ending = F.when(base_path.endswith("/"), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    refs = F.split(ref_path, "/")
    segments = F.when(ref_path.startswith("/"), refs).otherwise(_bind(F.concat(directory, ending, refs), squeezed))
    return _bind(_bind(segments, merged), lambda p: F.when(p == "", "/").otherwise(p))


def url_join(base: Column, ref: Column) -> Column:
    """Resolve a reference against the URL of its page (RFC 3986 section 5)."""
    def resolve(u: Column) -> Column:
        b, r = u["b"], u["r"]
        foreign = (r["scheme"] != "") & (r["scheme"] != b["scheme"])
        same_document = (r["path"] == "") & (r["params"] == "")
        # What the reference does not say comes from the base.
        target = F.struct(
            F.when(r["netloc"] != "", r["netloc"]).otherwise(b["netloc"]).alias("netloc"),
            F.when(r["netloc"] != "", r["path"]).when(same_document, b["path"])
            .otherwise(_resolved_path(b["path"], r["path"])).alias("path"),
            F.when((r["netloc"] == "") & same_document, b["params"]).otherwise(r["params"]).alias("params"),
            F.when((r["netloc"] == "") & same_document & (r["query"] == ""), b["query"]).otherwise(r["query"]).alias("query"))
        joined = _bind(target, lambda t: _unsplit(b["scheme"], t["netloc"], t["path"], t["params"], t["query"], r["fragment"]))
        return F.when(foreign, u["ref"]).otherwise(joined)

    parts = F.struct(url_parts(base).alias("b"), url_parts(ref).alias("r"), ref.alias("ref"))
    return F.when(ref == "", base).otherwise(_bind(parts, resolve))


def is_internal(url: Column, site: Column, prefix: str | None = None) -> Column:
    """Same host and port as the site, below the path prefix if one is set."""
    same = netloc(url) == site
    return same & path(url).startswith(prefix) if prefix else same


def _extension(path_: Column) -> Column:
    return F.regexp_extract(path_, r"[^/.][^/]*(\.[^./]*)$", 1)


def _without(path_: Column, ext: Column) -> Column:
    return F.left(path_, F.char_length(path_) - F.char_length(ext))


def should_skip(url: Column) -> Column:
    """Links to files and action endpoints that are never pages."""
    lowered = F.lower(path(url))
    hits = F.lit(False)
    for part in NON_PAGE_PATHS:
        hits = hits | lowered.contains(part)
    return _extension(lowered).isin(NON_PAGE_EXTENSIONS) | hits


def _clean_segments(path_: Column, default: str, limit: int | None = None) -> Column:
    def clean(segment: Column) -> Column:
        return F.btrim(F.regexp_replace(segment, FORBIDDEN_OR_CONTROL, "_"), F.lit(". "))

    def shorten(segment: Column) -> Column:
        ext = _extension(segment)
        return F.when(F.char_length(segment) > limit, F.concat(F.left(_without(segment, ext), F.lit(limit)), ext)).otherwise(segment)

    segments = F.filter(F.transform(F.split(path_, "/"), clean), lambda s: s != "")
    if limit:
        segments = F.transform(segments, shorten)
    return _bind(F.array_join(segments, "/"), lambda joined: F.when(joined == "", default).otherwise(joined))


def site_dir(site: Column) -> Column:
    return F.regexp_replace(site, FORBIDDEN, "_")


def site_file_path(url: Column, root: Column | None = None) -> Column:
    """Where a page of a site is stored: its URL path below the site folder, ``.md``."""
    def stem(relative: Column) -> Column:
        ext = _extension(relative)
        return F.when(F.lower(ext).isin(PAGE_EXTENSIONS), _without(relative, ext)).otherwise(relative)

    def named(decoded: Column) -> Column:
        return F.ltrim(
            F.when((decoded == "") | (decoded == "/"), "/index")
            .when(decoded.endswith("/"), F.concat(decoded, F.lit("index"))).otherwise(decoded), F.lit("/"))

    suffix = F.when(query(url) == "", "").otherwise(
        F.concat(F.lit("_"), F.left(F.regexp_replace(query(url), FORBIDDEN, "_"), F.lit(80))))
    folder = site_dir(netloc(url)) if root is None else root
    relative = F.concat(_bind(_bind(percent_decode(path(url)), named), stem), suffix)
    return F.concat(folder, F.lit("/"), _clean_segments(relative, "index"), F.lit(".md"))


def sanitize_filename(name: Column) -> Column:
    def shorten(bare: Column) -> Column:
        ext = _extension(bare)
        cut = F.concat(F.left(_without(bare, ext), F.greatest(F.lit(0), 200 - F.char_length(ext))), ext)
        return F.when(bare == "", "untitled").when(F.char_length(bare) > 200, cut).otherwise(bare)

    dashed = F.regexp_replace(F.regexp_replace(name, FORBIDDEN_OR_CONTROL, "_"), r"(?U)[\s\x1c-\x1f]+", "-")
    return _bind(F.btrim(F.regexp_replace(dashed, "-+", "-"), F.lit(".-")), shorten)


def page_file_name(url: Column) -> Column:
    """File name of a single page: last path segment, else a query value, else the host."""
    last = F.try_element_at(F.filter(F.split(path(url), "/"), lambda s: s != ""), F.lit(-1))
    stem = F.when(F.instr(last, ".") > 0, F.regexp_replace(last, r"(?s)\.[^.]*$", "")).otherwise(last)
    values = F.transform(
        F.filter(F.split(query(url), "&"), lambda p: F.instr(p, "=") > 0), lambda p: F.regexp_replace(p, r"(?s)^[^=]*=", ""))
    value = F.try_element_at(F.filter(values, lambda v: F.char_length(v) > 3), F.lit(1))
    host = F.replace(netloc(url), F.lit("."), F.lit("-"))
    return sanitize_filename(F.coalesce(F.nullif(stem, F.lit("")), value, host))


def page_file_path(url: Column) -> Column:
    return F.concat(page_file_name(url), F.lit(".md"))


def image_path(url: Column) -> Column:
    """Where an image is stored below the corpus root; the host is not part of it."""
    tag = F.left(F.regexp_replace(query(url), r'[<>:"/\\|?*&=]', "-"), F.lit(40))

    def named(relative: Column) -> Column:
        ext = _extension(relative)
        return F.when(query(url) == "", relative).otherwise(F.concat(_without(relative, ext), F.lit("_"), tag, ext))

    relative = _bind(F.ltrim(percent_decode(path(url)), F.lit("/")), named)
    return F.concat(F.lit("images/"), _clean_segments(relative, "image", 200))


def relative_path(target: Column, source_file: Column) -> Column:
    """``target`` as seen from the folder of ``source_file``."""
    def walk(p: Column) -> Column:
        there, here = p["there"], p["here"]
        depth = F.size(here) - 1
        steps = F.sequence(F.lit(1), F.greatest(F.least(depth, F.size(there) - 1), F.lit(1)))
        shared = F.aggregate(steps, F.lit(0), lambda n, i: F.when(
            (n == i - 1) & (i <= depth) & (F.get(there, i - 1) == F.get(here, i - 1)), i).otherwise(n))
        return _bind(shared, lambda n: F.concat(
            F.repeat(F.lit("../"), depth - n), F.array_join(F.slice(there, n + 1, F.size(there)), "/")))

    return _bind(F.struct(F.split(target, "/").alias("there"), F.split(source_file, "/").alias("here")), walk)


def base_name_words(path_: Column) -> Column:
    """File name without extension, ``-`` and ``_`` as spaces."""
    name = F.substring_index(path_, "/", -1)
    return F.translate(_without(name, _extension(name)), "-_", "  ")
