"""Text normalisation as Spark column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


# every character that counts as white space
SPACES = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
          "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")


_CLASS = SPACES.replace(" ", r"\x20")


def is_blank(value: Column) -> Column:
    """No character other than white space; a text that starts with printable ASCII, by its first byte, is decided early."""
    return F.when((value >= "!") & (value < "\x7f"), False).otherwise(~value.rlike(f"[^{_CLASS}]"))


def blank_to_null(value: Column) -> Column:
    """Null for blank strings, the untouched value otherwise."""
    return F.when(~is_blank(value), value)


def strip(value: Column) -> Column:
    """Trim every kind of white space, tabs and line ends included.

    A text that starts and ends with printable ASCII has nothing to trim.
    """
    return F.when(value.rlike("^[^!-~]|[^!-~]$"), F.btrim(value, F.lit(SPACES))).otherwise(value)


def squeeze(value: Column) -> Column:
    """Trim and fold runs of white space to one blank."""
    blanks = F.translate(value, SPACES, " " * len(SPACES))
    return F.trim(F.regexp_replace(blanks, " {2,}", " "))


def remove_spaces(value: Column) -> Column:
    return F.translate(value, SPACES, "")


def party_key(value: Column) -> Column:
    """Comparison key of a company name: no spaces, upper case, 1/0/| folded to letters."""
    return F.translate(F.upper(remove_spaces(value)), "10|", "IOI")


def container_key(value: Column) -> Column:
    return F.upper(remove_spaces(value))


def waybill_key(value: Column) -> Column:
    return F.upper(squeeze(value))


def index_key(value: Column) -> Column:
    return F.upper(remove_spaces(value))


def header_key(value: Column) -> Column:
    """Header caption reduced to lower-case letters, digits and Chinese characters."""
    return F.regexp_replace(F.lower(value), "[^a-z0-9一-鿿]+", "")


def clean_station(value: Column, noise: list[str]) -> Column:
    """Drop bracketed remarks and noise words, then edge punctuation."""
    bare = F.regexp_replace(value, r"[（(【][^）)】]*[）)】]", "")
    bare = F.regexp_replace(bare, "|".join(noise), "")
    edge = r"[ 　—–\-/，,;；、.。\t\r\n]+"
    return F.regexp_replace(bare, f"^{edge}|{edge}$", "")


def route_parts(value: Column) -> Column:
    """Station, port and destination of a route such as ``A-B-C``; blanks dropped."""
    return F.filter(F.transform(F.split(value, "[-—–_]"), strip), lambda p: p != "")


def country_list(value: Column) -> Column:
    """Countries separated by commas or arrows; null when nothing remains."""
    parts = F.filter(F.transform(F.split(value, "[、，,]|->|→"), strip), lambda p: p != "")
    return F.when(F.size(parts) > 0, parts)


def alias_list(value: Column) -> Column:
    return F.filter(F.transform(F.split(value, ","), strip), lambda p: p != "")


def digits(value: Column) -> Column:
    return F.regexp_replace(F.coalesce(value, F.lit("")), r"\D", "")


def cell_text(value: Column) -> Column:
    """Spreadsheet cell as text: whole floats lose their ``.0`` tail, blanks become null."""
    return blank_to_null(F.regexp_replace(strip(value), r"^([+-]?\d+)\.0+$", "$1"))


def waybill_kind(value: Column) -> Column:
    """``composite``, ``smgs``, ``cim`` or null for an unsupported waybill type."""
    text = F.upper(value)
    smgs, cim = F.contains(text, F.lit("SMGS")), F.contains(text, F.lit("CIM"))
    return (F.when(smgs & cim, "composite").when(smgs, "smgs").when(cim, "cim"))


def money_text(value: Column) -> Column:
    """Amount with thousands separators, or the word for an empty amount."""
    return F.coalesce(F.format_number(value, 2), F.lit("未填写"))


def one_line(value: Column, limit: int = 60) -> Column:
    """One line of text, cut with an ellipsis after ``limit`` characters."""
    text = squeeze(value)
    return F.when(F.length(text) > limit, F.concat(F.left(text, F.lit(limit)), F.lit("…"))).otherwise(text)


def is_code(value: Column) -> Column:
    """One to eight upper-case letters or digits."""
    return F.coalesce(F.upper(strip(value)), F.lit("")).rlike("^[A-Z0-9]{1,8}$")


def is_batch_id(value: Column) -> Column:
    return F.coalesce(value, F.lit("")).rlike("^[A-Za-z0-9_-]{4,64}$")
