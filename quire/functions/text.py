"""Text rules: region types and routes, segment labels, anchors, terms, value parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that open a header region, marks of table and equation regions, labels that may follow a value.
HEADER_STARTS = ("chapter", "section", "appendix")
TABLE_MARKS = ("|", " total ", " amount ", " qty ", "table ")
EQUATION_MARKS = ("=", "∑", "\\frac", " equation ")
NEXT_LABEL = r"(?iu)\s+(?:invoice\s*(?:no|number)|total|date|vendor|amount\s*due|due\s*date)\s*[:#-]\s*"

#: Unicode white space, for trims like Python's.
SPACE = "".join(map(chr, (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
TOKEN = r"[\p{L}\p{N}_]{2,}"

# Detector labels and the block types they mean.
LABEL_TYPES = {
    "text": "paragraph", "paragraph": "paragraph", "section_header": "header", "title": "header", "table": "table",
    "figure": "figure", "formula": "equation", "equation": "equation", "list_item": "paragraph",
    "page_footer": "footer", "page_header": "header", "picture": "figure", "caption": "paragraph",
}
# Segment labels in order, and the words that tell them.
SEGMENT_LABELS = [
    ("invoice", ["invoice", "bill to", "amount due", "payment", "line items"]),
    ("contract", ["agreement", "hereby agrees", "terms and conditions", "whereas", "party"]),
    ("appendix", ["appendix", "exhibit", "schedule", "attachment", "supporting"]),
    ("table_of_contents", ["table of contents", "contents"]),
    ("financial", ["balance sheet", "income statement", "cash flow", "profit", "revenue"]),
    ("legal", ["court", "plaintiff", "defendant", "pursuant", "statute"]),
    ("report", ["executive summary", "findings", "methodology", "conclusion"]),
]
# Words that speak for a category, by its label.
CATEGORY_WORDS = {
    "invoice": ["invoice", "amount due", "total", "bill to", "vendor", "payment"],
    "contract": ["agreement", "confidentiality", "termination", "governing law", "whereas", "party"],
    "appendix": ["appendix", "exhibit", "schedule", "attachment"],
    "financial": ["balance sheet", "income statement", "cash flow", "revenue"],
    "legal": ["plaintiff", "defendant", "court", "statute", "pursuant"],
}
#: Default stop words of the term functions; a parameter wherever it is used.
STOP_WORDS = (
    "a about after all also an and any are as at be been but by can could did do for from had has have he her his "
    "how if in into is it its more most my no not of on one only or other our out over she so some such than that "
    "the their them then there these they this to up us was we were what when which who will with would you your"
).split()


def stripped(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACE))


def is_blank(text: Column) -> Column:
    return F.coalesce(stripped(text), F.lit("")) == ""


def escaped_html(text: Column) -> Column:
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(sign), F.lit(name))
    return text


def anchor(text: Column, b: Column) -> Column:
    """``Native text at bbox [x,y,w,h]: '...'`` with six decimals and quotes escaped."""
    quoted = F.replace(text, F.lit("'"), F.lit("\\'"))
    return F.format_string("Native text at bbox [%.6f,%.6f,%.6f,%.6f]: '%s'", b.x, b.y, b.w, b.h, quoted)


def block_type_of_label(label: Column) -> Column:
    """Block type of a detector's label; paragraph for others."""
    table = F.create_map(*[F.lit(x) for pair in LABEL_TYPES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.lower(label)), F.lit("paragraph"))


def region_type(text: Column, average_size: Column, y: Column) -> Column:
    """Type of a region by the first rule that holds."""
    has = lambda low, *marks: F.greatest(*[F.contains(low, F.lit(m)) for m in marks])
    starts = lambda low: F.greatest(*[F.startswith(low, F.lit(w)) for w in HEADER_STARTS])

    def rules(low: Column) -> Column:
        return (
            F.when(y > 0.92, "footer")
            .when((average_size >= 16) | starts(low), "header")
            .when(has(low, *TABLE_MARKS), "table")
            .when(has(low, *EQUATION_MARKS), "equation")
            .otherwise("paragraph")
        )

    return F.get(F.transform(F.array(F.lower(text)), rules), F.lit(0))  # in lower case once a text


def route(kind: Column, width: Column, has_spans: Column, source_type: Column) -> Column:
    """Parser of a region: ocr for scans and handwriting, structure for tables and wide regions, else text."""
    return (
        F.when((source_type == "scan") | (kind == "handwriting"), "olmocr")
        .when(kind.isin("table", "equation", "figure") | (width > 0.75), "mineru")
        .when(has_spans & kind.isin("paragraph", "header", "footer"), "paddleocr")
        .otherwise("olmocr")
    )


def segment_label(text: Column) -> Column:
    """Label that the first 500 signs of a text tell."""
    return segment_label_name(segment_label_number(F.substring(F.lower(text), 1, 500)))


def segment_label_number(text: Column) -> Column:
    """Number in SEGMENT_LABELS of the first label with a word in the text; how many there are if none has."""

    def number(low: Column) -> Column:
        result = F
        for i, (_, marks) in enumerate(SEGMENT_LABELS):
            result = result.when(F.greatest(*[F.contains(low, F.lit(m)) for m in marks]), i)
        return result.otherwise(len(SEGMENT_LABELS))

    return F.get(F.transform(F.array(F.lower(text)), number), F.lit(0))  # in lower case once a text


def segment_label_name(number: Column) -> Column:
    return F.get(F.array(*[F.lit(label) for label, _ in SEGMENT_LABELS], F.lit("document")), number)


def confidence_band(score: Column) -> Column:
    return F.when(score >= 0.85, "high").when(score >= 0.7, "good").when(score >= 0.5, "fair").otherwise("low")


def semantic_gap(left: Column, right: Column) -> Column:
    """0 where ``left`` ends open (``-``, ``,``, ``;``) and ``right`` starts in lower case, else .2."""
    open_end = stripped(left).rlike(r"[-,;]$")
    lower_start = stripped(right).rlike(r"^\p{Ll}")
    return F.when(F.coalesce(open_end & lower_start, F.lit(False)), 0.0).otherwise(0.2)


def terms(text: Column, stop: list[str], most_chars: int | None = None) -> Column:
    """Words of two letters or more and pairs of neighbours, lower case, without stop words; of the first ``most_chars`` only if given."""
    part = text if most_chars is None else F.substring(text, 1, most_chars)
    words = F.regexp_extract_all(F.lower(part), F.lit(TOKEN), F.lit(0))
    kept = F.filter(words, lambda w: ~w.isin(stop))
    n = F.greatest(F.size(kept) - 1, F.lit(0))
    pairs = F.zip_with(F.slice(kept, 1, n), F.slice(kept, 2, n), lambda a, b: F.concat_ws(" ", a, b))
    return F.concat(kept, pairs)


def token_set(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), r"(?U)\W+"), lambda w: w != ""))


def token_overlap(alias: Column, text_tokens: Column) -> Column:
    """Share of the alias' tokens that are among ``text_tokens``."""
    own = token_set(alias)
    return F.when(F.size(own) > 0, F.size(F.array_intersect(own, text_tokens)) / F.size(own)).otherwise(0.0)


def trimmed_label(value: Column) -> Column:
    """A value cut before a following label such as ``Date:`` or ``Total #``."""
    at = F.regexp_instr(value, F.lit(NEXT_LABEL))
    return F.when(at > 0, stripped(F.substring(value, F.lit(1), at - 1))).otherwise(value)


def number_in(text: Column) -> Column:
    """First number in a text, commas dropped; null if there is none."""
    found = F.regexp_extract(F.replace(text, F.lit(","), F.lit("")), r"-?\d+(?:\.\d+)?", 0)
    return F.nullif(found, F.lit("")).try_cast("double")


def character_error_rate(reference: Column, other: Column) -> Column:
    """Edit distance by the reference's length, at most 1; 0 if both are empty, 1 if one is."""
    a, b = F.coalesce(reference, F.lit("")), F.coalesce(other, F.lit(""))
    rate = F.least(F.lit(1.0), F.levenshtein(a, b) / F.length(a))
    return F.when((a == "") & (b == ""), 0.0).when((a == "") | (b == ""), 1.0).otherwise(rate)
