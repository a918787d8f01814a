"""Tokens of HTML markup: splitting, kinds, attributes, character references."""

from __future__ import annotations

import html.entities

from pyspark.sql import Column
from pyspark.sql import functions as F

from pageloom.functions import text as T

# A tag ends at the first '>' outside a quoted attribute value. All loops are possessive, so a long tag or
# text neither backtracks nor recurses. Every character of the page lands in exactly one token.
_TAG_REST = r"""(?:=\s*+"[^"]*+"|=\s*+'[^']*+'|[^>=]++|=)*+"""
_TEXT_END = r"<(?=[a-zA-Z/!?])"
TOKEN = (
    "(?is)("
    r"<!--.*?(?:-->|\z)"
    + rf"|<script(?=[\s/>]){_TAG_REST}(?<!/)>.*?(?:</script(?=[\s/>])[^>]*+>|\z)"
    + rf"|<style(?=[\s/>]){_TAG_REST}(?<!/)>.*?(?:</style(?=[\s/>])[^>]*+>|\z)"
    + rf"|<title(?=[\s/>]){_TAG_REST}(?<!/)>.*?</title\s*+>"
    + rf"|<textarea(?=[\s/>]){_TAG_REST}(?<!/)>.*?</textarea\s*+>"
    + rf"|</?[a-z][^\s/>]*+{_TAG_REST}>"
    + r"|</?[a-z][^>]*+\z"
    + r"|<[!?/][^>]*+>"
    + rf"|(?:[^<]++|<(?![a-z/!?]))++"
    + "|<)"
)
TAG_NAME = r"^</?([a-zA-Z][^\s/>]*)"
START_TAG = rf"(?s)^<[a-zA-Z]{_TAG_REST}>"
CODE_TAG = rf"(?is)<code(?=[\s/>]){_TAG_REST}>"
RAW_CONTENT = r"(?s)^<[a-zA-Z]+(?:=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|[^>=]++|=)*+>(.*?)(?:</[a-zA-Z]+[^>]*>)?$"
_REFERENCE = r"(&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[a-zA-Z][a-zA-Z0-9]*);?|[^&]+|&)"
_ATTRIBUTE = r"""(?s)[^\s/>="'][^\s/>=]*(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s>"'][^\s>]*))?"""

# Character references looked up first because pages use them most; the rest of the public HTML5 table follows.
_FREQUENT = ["amp;", "nbsp;", "lt;", "gt;", "quot;", "copy;", "middot;", "mdash;", "ndash;", "rsquo;", "raquo;", "amp"]


def split_tokens(html: Column) -> Column:
    """Page source to array<string>; joining the array gives the source back."""
    return F.regexp_extract_all(html, F.lit(TOKEN), F.lit(1))


def is_text(token: Column) -> Column:
    """Text tokens: anything that is not a complete tag, comment, declaration, or script or style left open."""
    return ~token.startswith("<") | ~token.rlike(r"(?s)^<(?:[a-zA-Z/?].*>$|!|(?i:script|style)(?:\s[^>]*)?>)")


def tag_name(token: Column) -> Column:
    return F.lower(F.regexp_extract(token, TAG_NAME, 1))


def kind(token: Column) -> Column:
    """text, comment, raw (script/style), rcdata (title/textarea), open, empty, close, declaration."""
    name = tag_name(token)
    return (
        F.when(is_text(token), "text")
        .when(token.startswith("<!--"), "comment")
        .when(name == "", "declaration")
        .when(token.startswith("</"), "close")
        .when(token.endswith("/>") & ~token.rlike(r"(?is)</(?:script|style)\b[^>]*>$"), "empty")
        .when(name.isin("script", "style"), "raw")
        .when(name.isin("title", "textarea") & token.rlike(r"(?is)</(?:title|textarea)\s*>$"), "rcdata")
        .otherwise("open")
    )


def raw_content(token: Column) -> Column:
    """What stands between the tags of a script, style, title or textarea token."""
    return F.regexp_extract(token, RAW_CONTENT, 1)


def _reference_table() -> str:
    """The public HTML5 reference names and their characters as one text, frequent names first."""
    table = html.entities.html5
    names = _FREQUENT + sorted(set(table) - set(_FREQUENT))
    return "".join(f"\ufdd0{name}\ufdd1{table[name]}" for name in names) + "\ufdd0"


_REFERENCES = _reference_table()


def _named(name: Column) -> Column:
    """Characters of a named reference, null for unknown names.

    Looked up in one text constant: a map constant would put thousands of objects into every task.
    """
    key = F.concat(F.lit("\ufdd0"), name, F.lit("\ufdd1"))
    at = F.instr(F.lit(_REFERENCES), key)
    # No reference stands for more than two characters.
    found = F.substring_index(F.substring(F.lit(_REFERENCES), at + F.char_length(key), F.lit(3)), "\ufdd0", 1)
    return F.when(at > 0, found)


def _code_point(number: Column) -> Column:
    # Numeric references 128..159 mean the Windows-1252 characters.
    legacy = "".join(bytes([i]).decode("cp1252", "replace") for i in range(128, 160))
    bad = number.isNull() | (number < 1) | (number > 0x10FFFF) | number.between(0xD800, 0xDFFF)
    return (
        F.when(bad, F.lit("\ufffd"))
        .when(number.between(128, 159), F.substring(F.lit(legacy), (number - 127).cast("int"), F.lit(1)))
        .otherwise(F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32"))
    )


def _one_reference(part: Column) -> Column:
    digits = F.rtrim(F.substring(part, F.lit(3), F.char_length(part)), F.lit(";"))
    # Over eight digits, leading zeros aside, there is no such character; null says so.
    hexadecimal = F.regexp_replace(digits, "^[xX]0*(?=.)", "")
    number = F.when(
        part.rlike("^&#[xX]"), F.when(F.char_length(hexadecimal) <= 8, F.conv(hexadecimal, 16, 10).try_cast("long"))
    ).otherwise(digits.try_cast("long"))
    return (
        F.when(~part.startswith("&") | (part == "&"), part)
        .when(part.startswith("&#"), _code_point(number))
        .otherwise(F.coalesce(_named(F.substring(part, F.lit(2), F.char_length(part))), part))
    )


def decode_references(text: Column) -> Column:
    """Replace character references once; unknown ones stay as written."""
    parts = F.regexp_extract_all(text, F.lit(_REFERENCE), F.lit(1))
    return F.when(text.contains("&"), F.array_join(F.transform(parts, _one_reference), "")).otherwise(text)


def attributes(token: Column) -> Column:
    """Attributes of a tag token as array<struct<name,value>> in written order."""
    inner = F.regexp_replace(token, r"(?s)^<[a-zA-Z][^\s/>]*|/?>$", "")
    # One transform per step: each binds its result for the next.
    written = F.transform(F.regexp_extract_all(inner, F.lit(_ATTRIBUTE), F.lit(0)), lambda a: F.struct(
        F.lower(F.regexp_extract(a, r"^([^\s=]+)", 1)).alias("name"), F.regexp_extract(a, r"(?s)=\s*(.*)$", 1).alias("value")))
    bare = F.transform(written, lambda a: F.struct(a["name"].alias("name"), F.when(
        a["value"].rlike("""(?s)^(?:"|').*["']$""") & (F.char_length(a["value"]) > 1),
        F.substring(a["value"], F.lit(2), F.char_length(a["value"]) - 2)).otherwise(a["value"]).alias("value")))
    return F.transform(bare, lambda a: F.struct(a["name"].alias("name"), decode_references(a["value"]).alias("value")))


def attribute(attrs: Column, name: str) -> Column:
    """Value of an attribute, the last one when repeated, null when absent."""
    return F.try_element_at(F.filter(attrs, lambda a: a["name"] == name), F.lit(-1))["value"]


def tag_attribute(token: Column, name: str) -> Column:
    return attribute(attributes(token), name)


def classes(value: Column) -> Column:
    return F.filter(F.split(F.coalesce(value, F.lit("")), f"[{T.WS}]+"), lambda c: c != "")


def text_source(kind_: Column, token: Column) -> Column:
    """The written text of a text or rcdata token, null for the others."""
    return F.when(kind_ == "text", token).when(kind_ == "rcdata", raw_content(token))


def token_text(kind_: Column, token: Column) -> Column:
    """Decoded text of a text or rcdata token, null for the others."""
    return decode_references(text_source(kind_, token))


def texts(tokens: Column) -> Column:
    """Decoded text per token of an array, null for tokens without."""
    written = F.transform(tokens, lambda t: F.when(
        is_text(t), t).when(t.rlike(r"(?is)^<(?:title|textarea)[\s>].*</(?:title|textarea)\s*>$"), raw_content(t)))
    return F.transform(written, decode_references)


def inner_text(markup: Column, separator: str = "") -> Column:
    """Text nodes of a markup fragment, each stripped, empty ones dropped."""
    nodes = F.transform(texts(split_tokens(markup)), T.strip)
    return F.array_join(F.filter(nodes, lambda s: s != ""), separator)
