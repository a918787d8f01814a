import random
from urllib.parse import parse_qs, urlencode, urljoin, urlparse, urlunparse

import pytest
from pyspark.sql import functions as F

from pageloom.functions import urls as U

RFC_REFERENCES = (
    "g:h g ./g g/ /g //g ?y g?y #s g#s g?y#s ;x g;x g;x?y#s . ./ .. ../ ../g ../.. ../../ ../../g ../../../g ../../../../g"
    " /./g /../g g. .g g.. ..g ./../g ./g/. g/./h g/../h g;x=1/./y g;x=1/../y g?y/./x g?y/../x g#s/./x g#s/../x http:g").split()


def column(spark, values, build):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, u string")
    return [r["r"] for r in rows.select("i", build(F.col("u")).alias("r")).orderBy("i").collect()]


def normal(url):
    p = urlparse(url)
    kept = {k: v for k, v in parse_qs(p.query, keep_blank_values=True).items() if k.lower() not in U.TRACKING_KEYS}
    return urlunparse((p.scheme, p.netloc, p.path.rstrip("/") or "/", p.params, urlencode(kept, doseq=True), ""))


def random_urls(n):
    rng = random.Random(7)
    parts = ["a", "b", "/", "/", "..", ".", "?", "#", ";", "=", "&", "x%20y", "%zz", "+", "é", "//", "http:", "~*", "utm_source=1"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(1, 8))) for _ in range(n)]


@pytest.mark.parametrize("base", ["http://a/b/c/d;p?q", "https://h", "https://h/a//b/../c#f"])
def test_url_join(spark, base):
    refs = RFC_REFERENCES + random_urls(400)
    assert column(spark, refs, lambda u: U.url_join(F.lit(base), u)) == [urljoin(base, r) for r in refs]


def test_normalize_url(spark):
    urls = [
        "https://x.org/a/?utm_source=f&b=1&a=2&b=3&c&=5&~*=%zz+é#top", "http://h/ouier###", "HTTP://H:80/A//B///", "//h/p",
        "https://h?x=1", "http://h/p;v=1?REF=a&q=%20b", "mailto:q@r", *random_urls(400)]
    assert column(spark, urls, U.normalize_url) == [normal(u) for u in urls]


def test_url_parts(spark):
    urls = ["http://a/b;p/c;d;e?q=1#f", "x:y", "//h", "/p?q", "http://h/a b|c%%%"]
    assert [tuple(r) for r in column(spark, urls, U.url_parts)] == [tuple(urlparse(u)) for u in urls]


@pytest.mark.parametrize("url, site_path, name, image", [
    ("https://h:8080", "h_8080/index.md", "h:8080", "images/image"),
    ("https://h/a/", "h/a/index.md", "a", "images/a"),
    ("https://h/x/page.PHP?q=1/2", "h/x/page_q=1_2.md", "page", "images/x/page_q-1-2.PHP"),
    ("https://h/a%20b/..c./%3Fd.tar.gz", "h/a b/c/_d.tar.gz.md", "%3Fd.tar", "images/a b/c/_d.tar.gz"),
    ("https://h/?id=12&name=value", "h/index_id=12&name=value.md", "value", "images/_id-12-name-value"),
])
def test_paths(spark, url, site_path, name, image):
    row = spark.range(1).select(
        U.site_file_path(F.lit(url)).alias("s"), U.page_file_name(F.lit(url)).alias("n"), U.image_path(F.lit(url)).alias("i")).first()
    expected = name.replace(":", "_") if name.startswith("h:") else name
    assert (row["s"], row["n"], row["i"]) == (site_path, expected, image)


def test_sanitize_filename(spark):
    values = ['a<b>:"c', " x  y\tz ", "--a--b--", "...", "", "n" * 300 + ".html"]
    assert column(spark, values, U.sanitize_filename) == ["a_b___c", "x-y_z", "a-b", "untitled", "untitled", "n" * 195 + ".html"]


def test_relative_path(spark):
    cases = [("s/images/a.png", "s/p/q/x.md", "../../images/a.png"), ("images/a.png", "x.md", "images/a.png"),
             ("s/images/a.png", "s/images/x.md", "a.png"), ("s/images/a.png", "s/x.md", "images/a.png")]
    rows = spark.createDataFrame(cases, "t string, f string, e string")
    assert rows.filter(U.relative_path(F.col("t"), F.col("f")) != F.col("e")).count() == 0


def test_skip_and_internal(spark):
    urls = ["https://h/a.PDF", "https://h/a/i/b", "https://h/API/x", "https://h/api/x", "https://h/page", "https://h/.css", "https://h/x/comments"]
    assert column(spark, urls, U.should_skip) == [True, True, True, True, False, False, True]
    assert column(spark, ["https://h/p/1", "https://h/q", "https://www.h/p/1", "https://H/p/1"],
                  lambda u: U.is_internal(u, F.lit("h"), "/p/")) == [True, False, False, False]
