"""Scalar text, hash and vector functions as column expressions (no UDF)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: File suffixes by kind.
SUFFIXES = {"image": [".png", ".jpg", ".jpeg", ".webp", ".gif", ".bmp"], "pdf": [".pdf"], "docx": [".docx", ".doc"], "pptx": [".pptx", ".ppt"], "xlsx": [".xlsx", ".xls"]}
#: Fixed value: words that mark a question about a community.
COMMUNITY_PATTERN = r"(?iu)(moo\s*\d|หมู่\s*\d|village|community|หมู่บ้าน|ชุมชน)"


def file_type(path: Column) -> Column:
    """Kind of a file by its suffix, or ``unknown``."""
    suffix = F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))
    out = None
    for kind, names in SUFFIXES.items():
        out = F.when(suffix.isin(names), kind) if out is None else out.when(suffix.isin(names), kind)
    return out.otherwise("unknown")


def body(text: Column) -> Column:
    """What stands between ``<start>`` and ``</end>``; the whole text without them or with nothing between."""
    inner = F.regexp_extract(text, r"(?s)<start>(.*?)</end>", 1)
    return F.when(F.trim(inner) == "", text).otherwise(inner)


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def sanitize(text: Column) -> Column:
    """Line breaks and tabs become blanks; blanks at the ends go."""
    return F.trim(F.translate(text, "\n\r\t", "   "))


def numbered(text: Column) -> Column:
    """Lines with ``[0001] `` and so on before them."""
    return F.array_join(F.transform(F.split(text, "\n"), lambda x, i: F.concat(F.format_string("[%04d] ", i + 1), x)), "\n")


def token_estimate(text: Column) -> Column:
    return F.floor(F.length(text) / 4)


def sparse_tokens(text: Column) -> Column:
    """Unicode word tokens, lower-cased, in order. Of the characters, the plain letters and digits are tried first: the Unicode class is slow."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(?U)([a-z0-9\w฀-๿]+)"), 1)


def first_tokens(text: Column, n: int) -> Column:
    """The first ``n`` of ``sparse_tokens``, or null where there are fewer; what stands behind them is not read."""
    word = r"a-z0-9\w฀-๿"
    return F.regexp_extract_all(F.regexp_substr(F.lower(text), F.lit(f"(?U)^(?:[^{word}]*+[{word}]++){{{n}}}")), F.lit(f"(?U)([{word}]+)"), 1)


def token_id(token: Column) -> Column:
    """A stable 31-bit id: the first eight hex digits of SHA-256."""
    return F.conv(F.substring(F.sha2(token, 256), 1, 8), 16, 10).cast("long").bitwiseAND(2147483647)


def overlap_tokens(text: Column) -> Column:
    """Distinct Latin, digit and Thai tokens, lower-cased."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"([a-zA-Z0-9ก-๙]+)"), 1), F.lower))


def uuid5_zero(name: Column) -> Column:
    """UUID version 5 of a name in the all-zero namespace."""
    h = F.sha1(F.concat(F.unhex(F.lit("0" * 32)), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab89ab89ab89ab"), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def script_language(text: Column) -> Column:
    return F.when(text.rlike(r"[฀-๿]"), "Thai").otherwise("English")


def has_digit(text: Column) -> Column:
    return text.rlike(r"\p{Nd}")


def names_community(text: Column) -> Column:
    return text.rlike(COMMUNITY_PATTERN)


def safe_name(text: Column) -> Column:
    """A file name: everything but letters and digits becomes an underscore."""
    return F.regexp_replace(text, r"[^\p{L}\p{N}]", "_")


def metadata_text(title: Column, file: Column, content: Column, village: Column, moo: Column, country: Column) -> Column:
    part = lambda name, c: F.when(F.trim(c) != "", F.concat(F.lit(f"{name}: "), c))
    joined = F.concat_ws(" | ", part("Title", title), part("File", file), part("Content", content), part("Village", village), part("Moo", moo), part("Country", country))
    return F.when(joined == "", "unknown document").otherwise(joined)


def granularity_band(granularity: Column) -> Column:
    return F.when(granularity < 0.3, "very fine").when(granularity < 0.5, "fine").when(granularity < 0.7, "medium").otherwise("coarse")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where a vector has no length."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size == 0, F.lit(0.0)).otherwise(dot(a, b) / size)


def truncated(text: Column, most: int, mark: str = "\n\n[truncated]") -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit(mark))).otherwise(text)


def relevance_band(percent: Column) -> Column:
    return F.when(percent > 70, "high").when(percent > 40, "medium").otherwise("low")
