"""Text expressions, all JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NOT_WORD = r"[^\p{L}\p{N}]+"
#: All white space of Unicode and the separators 1C to 1F, in a notation that Java and other engines share.
WHITE = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def sanitized(text: Column) -> Column:
    """Drops bytes that are no UTF-8; a valid text stays as it is, genuine replacement marks included."""
    return F.when(F.is_valid_utf8(text), text).otherwise(F.replace(F.make_valid_utf8(text), F.lit("�"), F.lit("")))


#: The characters of WHITE.
SPACES = "".join(map(chr, [*range(0x9, 0xE), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def stripped(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def tokens(text: Column, limit: int | None = None) -> Column:
    """Lower-cased words in order; the first ``limit`` of them."""
    found = F.filter(F.split(F.lower(text), NOT_WORD), lambda w: w != "")
    return F.slice(found, 1, limit) if limit else found


def word_count(text: Column) -> Column:
    """Words between white space; 0 for an empty text."""
    return F.size(F.filter(F.split(text, f"{WHITE}+"), lambda w: w != "")).cast("long")


def bucket(token: Column, dim: int) -> Column:
    """Hash bucket of a token: the first 8 hex digits of its MD5, modulo dim."""
    return F.pmod(F.conv(F.substring(F.md5(token), 1, 8), 16, 10).cast("long"), F.lit(dim)).cast("int")


def buckets(text: Column, dim: int, limit: int) -> Column:
    return F.transform(tokens(text, limit), lambda w: bucket(w, dim))


def first_sentence(text: Column) -> Column:
    """Up to the first full stop, question or exclamation mark; the whole text without one."""
    found = F.regexp_extract(text, r"(?s)^.*?[.!?]", 0)
    return F.when(found == "", text).otherwise(found)
