"""Text functions as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from cellflow.functions.core import col, dbl, fn, num, only, text, whole
from cellflow.functions.math import round_half_away


@fn("CONCAT", "CONCATENATE")
def concat(*parts) -> Column:
    return F.concat(*[text(p) for p in parts])


@fn("TEXTJOIN")
def textjoin(delimiter: str, ignore_empty: bool, *parts) -> Column:
    values = F.array(*[text(p) for p in parts])
    return F.array_join(F.filter(values, lambda v: v != "") if ignore_empty else values, delimiter)


@fn("LEN", "LENB")
def length(x) -> Column:
    return F.char_length(text(x))


@fn("LEFT", "LEFTB")
def left(x, n=1) -> Column:
    return only(whole(n) >= 0, F.substring(text(x), F.lit(1), whole(n).cast("int")))


@fn("RIGHT", "RIGHTB")
def right(x, n=1) -> Column:
    size, n = F.char_length(text(x)), whole(n).cast("int")
    return only(n >= 0, F.substring(text(x), F.greatest(size - n, F.lit(0)) + 1, n))


@fn("MID", "MIDB")
def mid(x, start, n) -> Column:
    start, n = whole(start).cast("int"), whole(n).cast("int")
    return only((start >= 1) & (n >= 0), F.substring(text(x), start, n))


@fn("TRIM")
def trim(x) -> Column:
    return F.trim(F.regexp_replace(text(x), " +", " "))


@fn("UPPER")
def upper(x) -> Column:
    return F.upper(text(x))


@fn("LOWER")
def lower(x) -> Column:
    return F.lower(text(x))


@fn("PROPER")
def proper(x) -> Column:
    """A capital after anything that is not a letter."""
    words = F.regexp_extract_all(F.lower(text(x)), F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w)))), "")


@fn("FIND", "FINDB")
def find(needle, hay, start=1) -> Column:
    start = whole(start).cast("int")
    at = F.call_function("locate", text(needle), text(hay), start)
    return F.when((start >= 1) & (at > 0), at)


def wildcard(pattern: str) -> str:
    """A regular expression for ``*``, ``?`` and ``~`` as an escape."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "~" and i + 1 < len(pattern):
            i += 1
            out += re.escape(pattern[i])
        else:
            out += {"*": ".*", "?": "."}.get(c) or re.escape(c)
        i += 1
    return out


@fn("SEARCH", "SEARCHB")
def search(needle: str, hay, start=1) -> Column:
    """Case-insensitive, with wildcards; the needle is a constant."""
    tail = F.substring(text(hay), whole(start).cast("int"), F.char_length(text(hay)))
    before = F.regexp_extract(tail, f"(?is)^(.*?){wildcard(needle)}", 1)
    return F.when((whole(start) >= 1) & tail.rlike(f"(?is){wildcard(needle)}"), F.char_length(before) + whole(start))


@fn("SUBSTITUTE")
def substitute(x, old: str, new, nth: int | None = None) -> Column:
    x = text(x)
    if not old:
        return x
    if nth is None:
        return F.replace(x, F.lit(old), text(new))
    head = F.substring_index(x, old, nth)
    return F.when(head == x, x).otherwise(F.concat(head, text(new), F.substring(x, F.char_length(head) + len(old) + 1, F.char_length(x))))


@fn("REPLACE", "REPLACEB")
def replace(x, start, n, new) -> Column:
    start, n = whole(start).cast("int"), whole(n).cast("int")
    x = text(x)
    return only((start >= 1) & (n >= 0), F.concat(F.substring(x, F.lit(1), start - 1), text(new), F.substring(x, start + n, F.char_length(x))))


@fn("REPT")
def rept(x, n) -> Column:
    return only(whole(n) >= 0, F.repeat(text(x), whole(n).cast("int")))


@fn("VALUE")
def value(x) -> Column:
    return num(x)


@fn("NUMBERVALUE")
def numbervalue(x, point: str = ".", group: str = ",") -> Column:
    bare = F.regexp_replace(text(x), r"\s", "")
    bare = F.replace(F.replace(bare, F.lit(group), F.lit("")), F.lit(point), F.lit("."))
    percents = F.char_length(bare) - F.char_length(F.regexp_replace(bare, "%+$", ""))
    return F.regexp_replace(bare, "%+$", "").try_cast("double") / F.pow(F.lit(100.0), percents.cast("double"))


@fn("FIXED")
def fixed(x, digits: int = 2, no_commas: bool = False) -> Column:
    shown = F.format_number(round_half_away(x, digits), max(digits, 0))
    return F.replace(shown, F.lit(","), F.lit("")) if no_commas else shown


@fn("DOLLAR")
def dollar(x, digits: int = 2) -> Column:
    shown = fixed(F.abs(dbl(x)), digits)
    return F.concat(F.when(dbl(x) < 0, "-$").otherwise("$"), shown)


@fn("TEXT")
def text_format(x, pattern: str) -> Column:
    """Number formats of digits, point, commas and percent, and date patterns of y, m, d, h and s."""
    if re.fullmatch(r"(?i)[ymdhs:/\- .,]+", pattern) and re.search("[ymdhs]", pattern, re.I):
        java = re.sub(r"(?i)(h+[:.])(m+)", lambda m: m[1] + m[2].replace("m", "\0").replace("M", "\0"), pattern)
        java = java.lower().replace("mmmm", "LLLL").replace("mmm", "LLL").replace("mm", "MM").replace("m", "M").replace("\0\0", "mm").replace("\0", "m").replace("LLLL", "MMMM").replace("LLL", "MMM")
        return F.date_format(col(x), java.replace("h", "H"))
    percent = pattern.count("%")
    digits = len(m[1]) if (m := re.search(r"\.([0#]+)", pattern)) else 0
    shown = fixed(dbl(x) * 100**percent, digits, "," not in pattern)
    width = len(re.sub(r"[^0]", "", pattern.split(".")[0]))
    if width > 1 and "," not in pattern:
        sign, body = F.when(dbl(x) < 0, "-").otherwise(""), F.regexp_replace(shown, "^-", "")
        total = width + (digits + 1 if digits else 0)
        shown = F.concat(sign, F.when(F.length(body) < total, F.lpad(body, total, "0")).otherwise(body))
    return F.concat(shown, F.lit("%" * percent))


@fn("EXACT")
def exact(a, b) -> Column:
    return text(a) == text(b)


@fn("CHAR")
def char(n) -> Column:
    return only((whole(n) >= 1) & (whole(n) <= 255), F.decode(F.unhex(F.lpad(F.hex(whole(n)), 8, "0")), "UTF-32"))


@fn("UNICHAR")
def unichar(n) -> Column:
    return only((whole(n) >= 1) & (whole(n) <= 0x10FFFF), F.decode(F.unhex(F.lpad(F.hex(whole(n)), 8, "0")), "UTF-32"))


@fn("CODE", "UNICODE")
def code(x) -> Column:
    first = F.substring(text(x), 1, 1)
    return F.when(first != "", F.conv(F.right(F.hex(F.encode(first, "UTF-32")), F.lit(8)), 16, 10).cast("long"))


@fn("CLEAN")
def clean(x) -> Column:
    return F.regexp_replace(text(x), r"[\x00-\x1F]", "")


@fn("T")
def t(x) -> Column:
    return x if isinstance(x, str) else F.when(F.typeof(col(x)) == "string", text(x)).otherwise("")


@fn("TEXTBEFORE")
def textbefore(x, delimiter: str, nth: int = 1, if_not_found=None) -> Column:
    return _cut(x, delimiter, nth, if_not_found, True)


@fn("TEXTAFTER")
def textafter(x, delimiter: str, nth: int = 1, if_not_found=None) -> Column:
    return _cut(x, delimiter, nth, if_not_found, False)


def _cut(x, delimiter: str, nth: int, if_not_found, before: bool) -> Column:
    parts = F.split(text(x), re.escape(delimiter))
    times = F.size(parts) - 1
    at = F.lit(nth) if nth > 0 else times + nth + 1
    kept = F.slice(parts, F.lit(1), F.greatest(at, F.lit(0))) if before else F.slice(parts, F.greatest(at, F.lit(0)) + 1, F.size(parts))
    return F.when((at >= 1) & (at <= times), F.array_join(kept, delimiter)).otherwise(F.lit(if_not_found))


@fn("TEXTSPLIT")
def textsplit(x, columns: str, rows: str | None = None, ignore_empty: bool = False) -> Column:
    """An array, or with a row delimiter an array of rows."""

    def cut(c: Column) -> Column:
        parts = F.split(c, re.escape(columns))
        return F.filter(parts, lambda p: p != "") if ignore_empty else parts

    return cut(text(x)) if rows is None else F.transform(F.split(text(x), re.escape(rows)), cut)


@fn("VALUETOTEXT")
def valuetotext(x, strict: int = 0) -> Column:
    quoted = F.concat(F.lit('"'), F.replace(text(x), F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when((F.typeof(col(x)) == "string") & F.lit(strict == 1), quoted).otherwise(text(x))


@fn("ARRAYTOTEXT")
def arraytotext(values: Column, strict: int = 0) -> Column:
    if strict:
        return F.concat(F.lit("{"), F.array_join(F.transform(values, lambda v: valuetotext(v, 1)), ","), F.lit("}"))
    return F.array_join(F.transform(values, text), ", ")


def _flags(insensitive) -> str:
    return "(?i)" if insensitive else ""


@fn("REGEXTEST")
def regextest(x, pattern: str, insensitive: bool = False) -> Column:
    return text(x).rlike(_flags(insensitive) + pattern)


@fn("REGEXEXTRACT")
def regexextract(x, pattern: str, mode: int = 0, insensitive: bool = False) -> Column:
    """Mode 0 the first match, 1 all of them, 2 the groups of the first; no match is an error."""
    full = _flags(insensitive) + pattern
    if mode == 0:
        out = F.regexp_extract(text(x), full, 0)
    elif mode == 1:
        out = F.regexp_extract_all(text(x), F.lit(full), F.lit(0))
    else:
        out = F.array(*[F.regexp_extract(text(x), full, i + 1) for i in range(re.compile(pattern).groups)])
    return F.when(text(x).rlike(full), out)


@fn("REGEXREPLACE")
def regexreplace(x, pattern: str, new: str, nth: int = 0, insensitive: bool = False) -> Column:
    full = _flags(insensitive) + pattern
    if nth == 0:
        return F.regexp_replace(text(x), full, new)
    found, between = F.regexp_extract_all(text(x), F.lit(full), F.lit(0)), F.split(text(x), full)
    at = F.lit(nth) if nth > 0 else F.size(found) + nth + 1
    parts = F.transform(found, lambda m, i: F.when(i + 1 == at, F.regexp_replace(m, full, new)).otherwise(m))
    return F.array_join(F.flatten(F.transform(between, lambda b, i: F.array(b, F.coalesce(F.get(parts, i), F.lit(""))))), "")
