"""Column expressions on text. All run inside the JVM."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase, digits

from pyspark.sql import Column
from pyspark.sql import functions as F

# One token is an ASCII word or a single other code point.
TOKEN_PATTERN = r"([^\x00-\x7F]|[A-Za-z0-9]+)"

# Stop words of the query normaliser.
STOP_WORDS = [
    "的", "了", "在", "是", "我", "有", "和", "就", "不", "人", "都", "一", "一个", "上", "也", "很", "到", "说", "要",
    "去", "你", "会", "着", "没有", "看", "好", "自己", "这", "the", "is", "at", "of", "on", "and", "a", "an",
    "it", "to", "that", "this", "with", "for", "as", "was", "but", "be", "are",
]

_WIDE = "".join(chr(ord(c) + 0xFEE0) for c in ascii_uppercase + ascii_lowercase + digits)
WIDE_FROM = _WIDE + "＀　"
WIDE_TO = ascii_uppercase + ascii_lowercase + digits + "  "


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ascii_lower(c: Column | str) -> Column:
    """Lower-case A-Z only; every other code point is kept."""
    return F.translate(col(c), ascii_uppercase, ascii_lowercase)


def tokens(c: Column | str) -> Column:
    return F.regexp_extract_all(ascii_lower(c), F.lit(TOKEN_PATTERN), F.lit(1))


def byte_view(c: Column | str) -> Column:
    """One character per UTF-8 byte, so string functions count and compare bytes."""
    return F.decode(F.encode(col(c), "UTF-8"), "ISO-8859-1")


def snippet(c: Column | str, max_bytes: int = 200) -> Column:
    """Longest prefix of whole characters that fits in ``max_bytes`` UTF-8 bytes."""
    head = F.substring(col(c), 1, max_bytes)
    sizes = F.sequence(F.lit(0), F.lit(max_bytes))
    fits = F.array_max(
        F.filter(sizes, lambda n: F.octet_length(F.substring(head, F.lit(1), n)) <= max_bytes)
    )
    return F.when(F.octet_length(head) <= max_bytes, head).otherwise(
        F.substring(head, F.lit(1), fits)
    )


def half_width(c: Column | str) -> Column:
    return F.translate(col(c), WIDE_FROM, WIDE_TO)


def split_alnum(c: Column | str) -> Column:
    """A blank between an ASCII letter and a digit that touch, in either order."""
    out = F.regexp_replace(col(c), r"([A-Za-z])([0-9])", "$1 $2")
    return F.regexp_replace(out, r"([0-9])([A-Za-z])", "$1 $2")


def normalize(c: Column | str, stop_words: list[str] | None = None) -> Column:
    """The query normaliser as one expression."""
    words = STOP_WORDS if stop_words is None else stop_words
    out = ascii_lower(split_alnum(half_width(c)))
    out = F.regexp_replace(out, r"[ \t]+", " ")
    out = F.regexp_replace(out, r"^[ \t\r\n\f\x0B]+|[ \t\r\n\f\x0B]+$", "")
    out = F.regexp_replace(out, r"[^a-z0-9 '\-_\x{80}-\x{10FFFF}]", "")
    out = F.regexp_replace(out, r"([a-z])\1{2,}", "$1$1")
    stop = F.array(*[F.lit(w) for w in words]) if words else F.array().cast("array<string>")
    kept = F.filter(F.split(out, " "), lambda w: (w != "") & ~F.array_contains(stop, w))
    return F.array_join(kept, " ")


def title_chars(c: Column | str) -> Column:
    """Distinct characters of a title: ASCII lower-cased, blanks and ASCII punctuation left out."""
    return F.array_distinct(F.regexp_extract_all(ascii_lower(c), F.lit(r"([^\x00-\x7F]|[A-Za-z0-9])"), F.lit(1)))


def title_words(c: Column | str) -> Column:
    """Distinct lower-case ASCII words and single other characters of a title."""
    return F.array_distinct(tokens(c))


def jaccard(a: Column, b: Column) -> Column:
    """Set similarity of two arrays of distinct values; 0 when either is empty."""
    common = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(
        common / (F.size(a) + F.size(b) - common)
    )


def words_prefix(c: Column | str, n: int) -> Column:
    """The first ``n`` blank-separated words of a text, as written."""
    return F.regexp_extract(col(c), r"^\s*(\S+(?:\s+\S+){0,%d})" % (n - 1), 1)


def nonempty(c: Column | str) -> Column:
    return F.coalesce(F.length(col(c)) > 0, F.lit(False))
