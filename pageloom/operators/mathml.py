"""Formulas in pages as LaTeX.

A MathML tree is folded bottom-up by pattern replacement on its source: an element whose children are all done
is rewritten to one done piece, wrapped in two marker characters. ``aggregate`` repeats the round as often as the
source has elements at most; a finished formula passes the remaining rounds untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageloom.functions import markup as M
from pageloom.functions import text as T
from pageloom.operators.tokens import doc_order, nodes, with_attrs

# Markers are Unicode noncharacters: they never occur in text meant for interchange.
L, R = "\ufdd2", "\ufdd3"
LT, GT = "\ufdd4", "\ufdd5"
SEP, END = "\ufdd6", "\ufdd7"
MARKERS = f"[{L}{R}{LT}{GT}{SEP}{END}]"

# LaTeX for MathML operators; operators not listed stay as they are.
OPERATORS = {
    "×": r"\times", "·": r"\cdot", "−": "-",
    "≤": r"\leq", "≥": r"\geq", "≠": r"\neq",
    "∞": r"\infty", "∑": r"\sum", "∏": r"\prod",
    "∫": r"\int", "∂": r"\partial", "∇": r"\nabla",
    "±": r"\pm", "∓": r"\mp", "∩": r"\cap",
    "∪": r"\cup", "∈": r"\in", "∉": r"\notin",
    "⊂": r"\subset", "⊃": r"\supset", "→": r"\to",
    "⇒": r"\Rightarrow", "⇔": r"\Leftrightarrow",
    "…": r"\ldots", "⋯": r"\cdots",
    "{": r"\{", "}": r"\}", "*": r"\ast",
}

DONE = f"{L}([^{L}{R}]*){R}"
MORE = f"(?:{L}[^{L}{R}]*{R})*+"


def _literal(latex: str) -> str:
    """A replacement text in which only $1, $2, $3 are special."""
    return latex.replace("\\", "\\\\")


# Two or three arguments: element -> (number of arguments, LaTeX).
ARGUMENTS = {
    "msup": (2, "{$1}^{$2}"),
    "msub": (2, "{$1}_{$2}"),
    "msubsup": (3, "{$1}_{$2}^{$3}"),
    "mfrac": (2, r"\frac{$1}{$2}"),
    "mroot": (2, r"\sqrt[$2]{$1}"),
    "mover": (2, r"\overset{$2}{$1}"),
    "munder": (2, r"\underset{$2}{$1}"),
    "munderover": (3, "{$1}_{$2}^{$3}"),
}
SPECIAL = "|".join([*ARGUMENTS, "msqrt", "mtable", "mtr", "mfenced", "semantics"])


def _replace(value: Column, pattern: str, replacement: str) -> Column:
    return F.regexp_replace(value, F.lit(pattern), F.lit(replacement))


def _leaves(source: Column) -> Column:
    """Rewrite identifiers, numbers, operators, texts, spaces, annotations and bare text to done pieces."""
    s = _replace(source, r"(?s)<!--.*?-->", "")
    s = _replace(s, r"(?i)(</?)(?:[a-z]+:)?([a-z][a-z0-9\-]*)", "$1$2")
    s = _replace(s, r"(?i)</semantics\b[^>]*>", END)
    for encoding in ("TeX", "application/x-tex"):
        annotation = rf"<annotation\b[^>]*encoding=[\"']?{encoding}[\"'\s>][^>]*>?\s*([^<{END}]*?[^<{END}\s])\s*</annotation[^>]*>"
        s = _replace(s, rf"<semantics\b[^>]*>[^{END}]*?{annotation}[^{END}]*{END}", f"{L}$1{R}")
    s = _replace(s, END, "</semantics>")
    s = _replace(s, r"(?s)<annotation(?:-xml)?\b[^>]*>.*?</annotation(?:-xml)?\b[^>]*>", "")
    s = _replace(s, r"<mspace\b[^>]*>(?:[^<]*</mspace[^>]*>)?", L + _literal(r"\;") + R)
    s = _replace(s, r"<mi\b[^>]*>\s*(\p{L}{2,})\s*</mi[^>]*>", L + _literal(r"\mathrm{$1}") + R)
    s = _replace(s, r"<(mi|mn)\b[^>]*>\s*([^<]*?)\s*</\1[^>]*>", f"{L}$2{R}")
    for sign, latex in OPERATORS.items():
        s = _replace(s, rf"<mo\b[^>]*>\s*\Q{sign}\E\s*</mo[^>]*>", L + _literal(latex) + R)
    s = _replace(s, r"<mo\b[^>]*>\s*([^<]*?)\s*</mo[^>]*>", f"{L}$1{R}")
    s = _replace(s, r"<mtext\b[^>]*>\s*</mtext[^>]*>", L + R)
    s = _replace(s, r"<mtext\b[^>]*>\s*([^<]*?)\s*</mtext[^>]*>", L + _literal(r"\text{$1}") + R)
    s = _replace(s, r"<[a-z][^>]*/>", L + R)
    # Text directly between tags is a child of its own; blank text is none.
    s = _replace(s, rf"([>{R}])\s+(?=[<{L}])", "$1")
    s = _replace(s, rf"(?<=[>{R}])\s*([^<>{L}{R}\s](?:[^<>{L}{R}]*[^<>{L}{R}\s])?)\s*(?=[<{L}])", f"{L}$1{R}")
    # Brackets and separators of mfenced are written out on every tag.
    for name, default in (("open", "("), ("close", ")"), ("separators", ",")):
        s = _replace(s, rf"(</?mfenced\b(?![^>]*\b{name}=)[^>]*)>", rf'$1 {name}="{default}">')
    return s


def _round(s: Column) -> Column:
    """Fold every element whose children are done."""
    for name, (count, latex) in ARGUMENTS.items():
        s = _replace(s, f"<{name}\\b[^>]*>{DONE * count}{MORE}</{name}\\b[^>]*>", L + _literal(latex) + R)
        s = _replace(s, f"<{name}\\b[^>]*></{name}\\b[^>]*>", L + R)
        s = _replace(s, f"<{name}\\b[^>]*>{DONE}</{name}\\b[^>]*>", f"{L}$1{R}")
        if count == 3:
            s = _replace(s, f"<{name}\\b[^>]*>{DONE}{DONE}</{name}\\b[^>]*>", f"{L}$1 $2{R}")
    s = _replace(s, f"<semantics\\b[^>]*>{DONE}{MORE}</semantics[^>]*>", f"{L}$1{R}")
    s = _replace(s, r"<semantics\b[^>]*></semantics[^>]*>", L + R)
    # Neighbours inside these elements join, whatever else is still open around them.
    s = _replace(s, f"{R}{L}(?=[^<]*</msqrt\\b)", "")
    s = _replace(s, f"{R}{L}(?=[^<]*</mtr\\b)", " & ")
    s = _replace(s, f"{R}{L}(?=[^<]*</mtable\\b)", _literal(r" \\ "))
    s = _replace(s, f"{R}{L}(?=[^<]*</mfenced\\b[^>]*\\bseparators=[\"']([^\"']*)[\"'])", " $1 ")
    s = _replace(s, f"{R}{L}(?=[^<]*</(?!(?:{SPECIAL})\\b))", " ")
    s = _replace(s, f"<msqrt\\b[^>]*>(?:{DONE})?</msqrt[^>]*>", L + _literal(r"\sqrt{$1}") + R)
    s = _replace(s, f"<mtr\\b[^>]*>(?:{DONE})?</mtr[^>]*>", f"{L}$1{R}")
    s = _replace(s, f"<mtable\\b[^>]*>(?:{DONE})?</mtable[^>]*>", L + _literal(r"\begin{matrix} $1 \end{matrix}") + R)
    s = _replace(
        s, f"<mfenced\\b[^>]*>(?:{DONE})?</mfenced(?=[^>]*\\bopen=[\"']([^\"']*)[\"'])(?=[^>]*\\bclose=[\"']([^\"']*)[\"'])[^>]*>",
        L + _literal(r"\left$2 $1 \right$3") + R)
    return _replace(s, f"<((?!(?:{SPECIAL})\\b)[a-z][^\\s>]*)[^>]*>(?:{DONE})?</\\1\\b[^>]*>", f"{L}$2{R}")


def mathml_to_latex(markup: Column) -> Column:
    """LaTeX of a balanced <math> source."""
    shielded = F.translate(M.decode_references(_shield(markup)), "<>", LT + GT)
    source = F.translate(shielded, "\ufdd8\ufdd9", "<>")
    rounds = F.sequence(F.lit(1), F.regexp_count(markup, F.lit("</")) + 1)
    folded = F.aggregate(rounds, _leaves(source), lambda s, _: F.when(s.contains("<"), _round(s)).otherwise(s))
    return F.translate(_replace(folded, f"[{L}{R}]|<[^>]*>", ""), LT + GT, "<>")


def _shield(markup: Column) -> Column:
    """Keep tag brackets apart from decoded ones."""
    return F.translate(F.regexp_replace(markup, MARKERS, ""), "<>", "\ufdd8\ufdd9")


# Elements that hold a formula of their own: these, and those with a class of this name.
FORMULA_TAGS = ["math", "mjx-container"]
FORMULA_CLASS = "katex"
_EQUATION_IMAGE = r"(?i)equation|formula|math|latex|tex"


def with_formulas(rows: DataFrame) -> DataFrame:
    """Add ``latex``, ``is_block`` and ``formula_source`` on rows that start a formula, row by row.

    ``rows`` are nodes with ``attrs``, markup (``FORMULA_TAGS``) and parents.
    """
    tag, kind, tok = F.col("tag"), F.col("kind"), F.col("tok")
    candidate = F.col("markup").isNotNull() | ((tag == "img") & (kind == "empty")) | ((tag == "script") & (kind == "raw"))

    def attr(name: str) -> Column:
        return T.strip(F.coalesce(M.attribute(F.col("attrs"), name), F.lit("")))

    classes = M.classes(M.attribute(F.col("attrs"), "class"))
    is_katex = F.exists(classes, lambda c: c.contains("katex"))
    annotation = F.regexp_extract(
        F.col("markup"), r"""(?is)<annotation\b[^>]*encoding=["']?application/x-tex["']?[^>]*>([^<]*)</annotation""", 1)
    is_equation = attr("src").rlike(_EQUATION_IMAGE) | attr("alt").rlike(r"[\\^_{}]")
    alt, alternative = attr("alt"), attr("title")
    sources = {
        "katex": F.when(F.col("markup").isNotNull() & is_katex, T.strip(M.decode_references(annotation))),
        "mathml": F.when(tag == "math", F.when(attr("alttext") != "", attr("alttext")).otherwise(mathml_to_latex(F.col("markup")))),
        "mathjax": F.when(tag == "mjx-container", attr("aria-label")),
        "script": F.when((tag == "script") & attr("type").contains("math/tex"), T.strip(M.raw_content(tok))),
        "image": F.when((tag == "img") & is_equation, F.when(alt != "", alt).otherwise(alternative)),
    }
    # The first source with a formula counts; computed once, then named.
    found = F.filter(
        F.array(*[F.struct(F.lit(n).alias("source"), latex.alias("latex")) for n, latex in sources.items()]),
        lambda f: f["latex"] != "")
    rows = rows.withColumn("_formula", F.when(candidate, F.get(found, 0)))
    source, latex = F.col("_formula.source"), F.col("_formula.latex")
    short = M.tag_name(F.col("parent_tok")).isin("p", "div", "td") & (
        F.char_length(F.coalesce("parent_text", F.lit(""))) < F.char_length(latex) + 5)
    block = (
        F.when(source == "katex", F.array_contains(classes, "katex-display"))
        .when(source == "mathml", attr("display") == "block")
        .when(source == "mathjax", attr("display") == "true")
        .when(source == "script", attr("type").contains("display"))
        .when(source == "image", F.coalesce(short, F.lit(False))))
    return rows.withColumns({"latex": latex, "formula_source": source, "is_block": block}).drop("_formula")


def in_formula() -> Column:
    """Whether a row lies in a formula that started before it; such a row is no formula of its own."""
    earlier_end = F.max(F.when(F.col("latex").isNotNull(), F.greatest("mate", "pos"))).over(
        doc_order().rowsBetween(Window.unboundedPreceding, -1))
    return F.coalesce(earlier_end >= F.col("pos"), F.lit(False))


def formulas(pages: DataFrame) -> DataFrame:
    """(page_id, pos, source, is_block, latex): every formula of every page."""
    rows = with_formulas(with_attrs(nodes(pages, markup_of=FORMULA_TAGS, markup_class=FORMULA_CLASS, parents=True)))
    rows = rows.withColumn("in_formula", in_formula())
    return rows.filter(F.col("latex").isNotNull() & ~F.col("in_formula")).select(
        "page_id", "pos", F.col("formula_source").alias("source"), "is_block", "latex")
