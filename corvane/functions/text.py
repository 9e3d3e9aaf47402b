"""Text as Column expressions: tokens, chunks, query expansion, highlighting, redaction.

Everything here stays inside the JVM. Null texts behave as empty ones.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

CHUNK, OVERLAP = 800, 120
MAX_TEXT = 500_000
#: White space as the index collapses it: ASCII, no-break and Unicode spaces, BOM.
JS_SPACE = "[\\t\\n\\x0b\\f\\r \\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff]"
_SPACE = re.compile(JS_SPACE + "+")
_KEEP = re.compile(r"[^\w-]", re.UNICODE)

# Word pairs that stand for each other in queries, and whole-query variants.
SYNONYMS = [
    ("bhang", "भांग"), ("bhaang", "भांग"), ("cannabis", "कैनबिस"), ("hemp", "हेम्प"), ("video", "वीडियो"),
    ("report", "रिपोर्ट"), ("folder", "फ़ोल्डर"), ("photo", "फोटो"), ("document", "दस्तावेज़"),
]
VARIANTS = {
    "cannabis": ["cannabis", "hemp", "भांग", "bhang", "कैनबिस"],
    "hemp": ["hemp", "cannabis", "भांग", "bhang", "कैनबिस"],
    "bhang": ["bhang", "cannabis", "भांग", "hemp", "कैनबिस"],
    "भांग": ["भांग", "bhang", "cannabis", "hemp", "कैनबिस"],
    "कैनबिस": ["कैनबिस", "cannabis", "hemp", "bhang", "भांग"],
}
# Fixed value: words that carry no weight of their own.
STOPWORDS = [
    "a", "an", "the", "and", "or", "of", "to", "in", "on", "for", "is", "are", "was", "were",
    "be", "been", "it", "this", "that", "with", "from", "by", "as", "at", "into", "about",
    "report", "file", "document", "pdf", "doc", "sheet",
]


def _text(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def tokenize(c: Column | str) -> Column:
    """Lower-cased runs of letters, digits, ``_`` and ``-`` of two or more characters."""
    return F.filter(F.split(F.lower(_text(c)), r"[^\p{L}\p{N}_-]+"), lambda x: F.length(x) >= 2)


def collapse(c: Column | str) -> Column:
    """White space runs to single blanks, trimmed."""
    return F.trim(F.regexp_replace(_text(c), JS_SPACE + "+", " "))


def chunk(c: Column | str) -> Column:
    """Windows of 800 characters that overlap by 120, over the collapsed text; empty array for blank texts."""
    step = CHUNK - OVERLAP

    def cut(t: Column) -> Column:
        last = F.greatest(F.lit(0), F.ceil((F.length(t) - CHUNK) / F.lit(step)).cast("int"))
        return F.when(F.length(t) == 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(t, i * step + 1, F.lit(CHUNK))))

    # Through a lambda variable the text is collapsed once, not once per chunk.
    return F.get(F.transform(F.array(collapse(c)), cut), F.lit(0))


def cap_text(c: Column | str) -> Column:
    """struct(text, truncated): the first 500 000 characters and whether more were cut off."""
    return F.struct(F.substring(_text(c), 1, MAX_TEXT).alias("text"), (F.length(_text(c)) > MAX_TEXT).alias("truncated"))


def query_terms(query: str) -> list[str]:
    """Index terms of a query string, duplicates kept (same rule as ``tokenize``)."""
    return [t for t in re.split(r"[^\w-]+", _strip_marks(query.lower())) if len(t) >= 2]


def _strip_marks(s: str) -> str:
    import unicodedata

    return "".join(ch if unicodedata.category(ch)[0] in "LN" or ch in "_-" else " " for ch in s)


def _raw_terms(query: str) -> list[str]:
    import unicodedata

    keep = lambda w: "".join(ch for ch in w if unicodedata.category(ch)[0] in "LMN" or ch in "_-")
    return [keep(w) for w in _SPACE.split(query.lower())]


def expand_terms(query: str) -> list[str]:
    """Distinct query terms followed by their synonyms."""
    raw = [t for t in _raw_terms(query) if len(t) >= 2]
    other: dict[str, list[str]] = {}
    for a, b in SYNONYMS:
        other.setdefault(a, []).append(b)
        other.setdefault(b, []).append(a)
    return list(dict.fromkeys(raw + [x for t in raw for x in other.get(t, [])]))


def expand_terms_column(c: Column | str) -> Column:
    """``expand_terms`` for a column of queries."""
    pairs: dict[str, list[str]] = {}
    for a, b in SYNONYMS:
        pairs.setdefault(a, []).append(b)
        pairs.setdefault(b, []).append(a)
    table = F.create_map(*[x for k, v in pairs.items() for x in (F.lit(k), F.array(*[F.lit(i) for i in v]))])
    raw = F.filter(F.transform(F.split(F.lower(_text(c)), JS_SPACE + "+"), lambda w: F.regexp_replace(w, r"[^\p{L}\p{M}\p{N}_-]", "")), lambda w: F.length(w) >= 2)
    more = F.flatten(F.transform(raw, lambda w: F.coalesce(F.try_element_at(table, w), F.array().cast("array<string>"))))
    return F.array_distinct(F.concat(raw, more))


def semantic_variants(query: str, limit: int = 3) -> list[str]:
    """The trimmed query and its alias substitutions, at most ``limit``."""
    trimmed = query.strip()
    terms = [t for t in _raw_terms(trimmed) if t]
    out = [trimmed] if trimmed else []
    for t in terms:
        for alias in VARIANTS.get(t, []):
            out.append(" ".join(alias if w == t else w for w in terms))
    return list(dict.fromkeys(out))[:limit]


def highlight(c: Column | str, query: str) -> Column:
    """array<struct<text, match>>: the text cut around case-insensitive occurrences of query terms."""
    import unicodedata

    terms = ["".join(ch for ch in w if unicodedata.category(ch)[0] in "LN" or ch in "_-") for w in _SPACE.split(query.lower())]
    terms = [t for t in terms if len(t) >= 2]
    kind = "array<struct<text:string,match:boolean>>"
    if not terms:
        return F.when(_text(c) == "", F.array().cast(kind)).otherwise(F.array(F.struct(_text(c).alias("text"), F.lit(False).alias("match")))).cast(kind)
    alt = "|".join("\\Q" + t + "\\E" for t in terms)
    cut = F.regexp_replace(_text(c), f"(?iu)({alt})", "\u0001$1\u0001")
    parts = F.filter(F.split(cut, "\u0001"), lambda x: x != "")
    return F.transform(parts, lambda x: F.struct(x.alias("text"), F.lower(x).isin(terms).alias("match"))).cast(kind)


# What never reaches a log, with its replacement, applied in this order.
SECRETS = [
    (r"ya29\.[A-Za-z0-9._~\-]+", "[token]"), (r"AIza[A-Za-z0-9_\-]+", "[key]"),
    (r"(?i)Bearer\s+\S+", "Bearer [redacted]"), (r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}", "[email]"),
]


def redact(c: Column | str) -> Column:
    """Secrets replaced, then cut to 500 characters."""
    return F.substring(reduce(lambda x, p: F.regexp_replace(x, *p), SECRETS, _text(c)), 1, 500)


def format_bytes(c: Column | str, decimals: int = 1) -> Column:
    """``1.5 KB`` style sizes to the base 1024; ``Size unknown`` for null and non-positive ones."""
    b = F.col(c) if isinstance(c, str) else c
    unit = lambda k, name: F.concat(_plain(F.round(b / F.lit(float(1024**k)), max(0, decimals))), F.lit(" " + name))
    out = F.when(b.isNull() | (b <= 0), "Size unknown")
    for k, name in enumerate(["B", "KB", "MB", "GB"]):
        out = out.when(b < 1024 ** (k + 1), unit(k, name))
    return out.otherwise(unit(4, "TB"))


def _plain(x: Column) -> Column:
    """A rounded double without trailing zeros."""
    s = F.format_string("%.6f", x.cast("double"))
    return F.regexp_replace(F.regexp_replace(s, r"(\.\d*?)0+$", "$1"), r"\.$", "")


def stem(c: Column) -> Column:
    """File name without an ending of up to eight letters and digits."""
    return F.regexp_replace(c, r"(?i)\.[a-z0-9]{1,8}\z", "")


def split_tags(c: Column | str) -> Column:
    """Comma-separated tags, trimmed, blanks dropped."""
    return F.filter(F.transform(F.split(_text(c), ","), lambda x: F.trim(x)), lambda x: x != "")


def half_up(c: Column) -> Column:
    """Rounding to integers towards plus infinity at .5."""
    return F.floor(c + 0.5)


def decode_entities(c: Column | str) -> Column:
    """XML entities (five names, decimal, hexadecimal) in one pass.

    The text is cut at its ampersands, so every piece holds at most one entity, at
    its start, and no replacement is looked at again.
    """
    parts = F.split(_text(c), "&", -1)
    named = F.create_map(*[F.lit(x) for p in (("amp", "&"), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'")) for x in p])

    def one(p: Column) -> Column:
        name = F.regexp_extract(p, r"(?i)^(#x[0-9a-f]+|#[0-9]+|amp|lt|gt|quot|apos);", 1)
        low = F.lower(name)
        code = F.when(low.startswith("#x"), F.conv(F.substring(low, 3, 12), 16, 10).try_cast("int")).when(low.startswith("#"), F.substring(low, 2, 12).try_cast("int"))
        bits = F.hex(code)
        char = F.when(code.between(1, 0x10FFFF), F.decode(F.unhex(F.lpad(bits, 8, "0")), "UTF-32"))
        return F.when(name == "", F.concat(F.lit("&"), p)).otherwise(F.concat(F.coalesce(F.try_element_at(named, low), char, F.lit("")), F.substring(p, F.length(name) + 2, F.lit(1 << 30))))

    return F.concat(F.get(parts, F.lit(0)), F.array_join(F.transform(F.slice(parts, 2, 1 << 30), one), ""))


def xml_text(c: Column | str) -> Column:
    """Visible text of WordprocessingML: entities first, tabs and breaks kept, tags to blanks, gaps closed."""
    # The elements of the format and the order of the steps.
    steps = [(r"(?i)<w:tab\s*/?>", "\t"), (r"(?i)<w:br\s*/?>", "\n"), (r"(?i)</w:p\s*>", "\n"), (r"<[^>]+>", " "), (r"[ \t]+\n", "\n"), (r"\n{3,}", "\n\n"), (r"^\s+|\s+$", "")]
    return reduce(lambda x, s: F.regexp_replace(x, *s), steps, decode_entities(c))


def is_sparse(c: Column | str) -> Column:
    """True if a page's text layer is too thin to stand alone: under 45 characters or 6 words."""
    t = collapse(c)
    return (F.length(t) < 45) | (F.size(F.filter(F.split(t, " "), lambda w: w.rlike(r"[\p{L}\p{N}]"))) < 6)


def merge_layers(native: Column, ocr: Column) -> Column:
    """Sparse native text with its recognised twin: the longer one if one contains the other, else both."""
    n, o = _text(native), _text(ocr)
    key = lambda x: F.regexp_replace(F.lower(x), r"[^\p{L}\p{N}]+", "")
    inside = (key(n) != "") & (key(o).contains(key(n)) | key(n).contains(key(o)))
    return F.when(n == "", o).when(o == "", n).when(inside, F.when(F.length(o) >= F.length(n), o).otherwise(n)).otherwise(F.concat(n, F.lit("\n"), o))


def sample_pages(total: Column, expanded: bool = False) -> Column:
    """Pages to read: all up to ten, else the first and last five, plus up to five spread inner ones if expanded."""
    n = F.greatest(F.lit(0), F.floor(F.coalesce(total, F.lit(0)))).cast("int")
    none = F.array().cast("array<int>")
    edge = F.concat(F.sequence(F.lit(1), F.lit(5)), F.sequence(n - 4, n))
    if expanded:
        inner = n - 10
        k = F.least(F.lit(5), inner)
        spread = F.transform(F.sequence(F.lit(1), k), lambda i: (F.floor(i * (inner + 1) / (k + 1) + 0.5) - 1 + 6).cast("int"))
        edge = F.concat(edge, spread)
    return F.when(n <= 0, none).when(n <= 10, F.sequence(F.lit(1), F.greatest(n, F.lit(1)))).otherwise(F.array_sort(F.array_distinct(edge)))
