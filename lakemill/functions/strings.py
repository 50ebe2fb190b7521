"""String functions with the SQL dialect's semantics, as native columns."""

from __future__ import annotations

import re
import string

from pyspark.sql import Column
from pyspark.sql import functions as F

_UPPER, _LOWER = string.ascii_uppercase, string.ascii_lowercase


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def concat(*cols) -> Column:
    """All values as text; nulls count as nothing."""
    return F.concat_ws("", *[_col(c).cast("string") for c in cols])


def lower(x) -> Column:
    """A-Z in lower case; other letters stay."""
    return F.translate(_col(x), _UPPER, _LOWER)


def upper(x) -> Column:
    """a-z in upper case; other letters stay."""
    return F.translate(_col(x), _LOWER, _UPPER)


_SPACE = r"[\s\u0085   -     　\u000b]+"


def ltrim(x) -> Column:
    return F.regexp_replace(_col(x), f"^{_SPACE}", "")


def rtrim(x) -> Column:
    return F.regexp_replace(_col(x), rf"{_SPACE}\z", "")


def trim(x) -> Column:
    """Without white space of any kind at both ends."""
    return rtrim(ltrim(x))


def initcap(x) -> Column:
    """Each run of letters and digits with its first character in upper case."""
    pieces = F.regexp_extract_all(_col(x), F.lit(r"([\p{L}\p{N}]+|[^\p{L}\p{N}]+)"), 1)
    return F.array_join(F.transform(pieces, lambda w: F.concat(upper(F.substring(w, 1, 1)), lower(F.substr(w, F.lit(2))))), "")


def substring(x, start, count=None) -> Column:
    """From the start, at least 1; a count of 0 or less gives ''."""
    begin = F.greatest(F.lit(start) if isinstance(start, int) else start, F.lit(1))
    if count is None:
        return F.substr(_col(x), begin)
    n = F.lit(count) if isinstance(count, int) else count
    return F.substr(_col(x), begin, F.greatest(n, F.lit(0)))


def regexp_replace(x, pattern: str, replacement: str, flags: str = "") -> Column:
    """The first match only, unless flags hold g; i ignores case; $1 names a group."""
    pattern = f"(?i){pattern}" if "i" in flags else pattern
    if "g" in flags:
        return F.regexp_replace(_col(x), pattern, replacement)
    groups = re.compile(pattern).groups
    # What stands before and behind the first match is kept as the outer groups.
    shifted = re.sub(r"\$(\d+)", lambda m: f"${int(m[1]) + 1}", replacement)
    inner = pattern.removeprefix("(?i)")
    lead = "(?is)" if pattern.startswith("(?i)") else "(?s)"
    return F.regexp_replace(_col(x), rf"{lead}\A(.*?){inner if groups else f'(?:{inner})'}(.*)\z", f"$1{shifted}${groups + 2}")


def split_part(x, delimiter: str, index: int) -> Column:
    """The index-th part from 1; '' if there is none; an empty delimiter leaves the text whole."""
    if index < 1:
        raise ValueError("split_part: the index starts at 1")
    if not delimiter:
        return F.when(_col(x).isNull(), None).otherwise(_col(x) if index == 1 else F.lit(""))
    return F.split_part(_col(x), F.lit(delimiter), F.lit(index))


def string_to_array(x, delimiter: str) -> Column:
    """The parts as JSON text."""
    return F.to_json(F.split(_col(x), re.escape(delimiter).replace("\\ ", " "), -1))


def quote_ident(x) -> Column:
    return F.concat(F.lit('"'), F.replace(_col(x), F.lit('"'), F.lit('""')), F.lit('"'))


def quote_literal(x) -> Column:
    return F.concat(F.lit("'"), F.replace(_col(x), F.lit("'"), F.lit("''")), F.lit("'"))


def chr_(code) -> Column:
    """The character of a code point."""
    return F.decode(F.unhex(F.lpad(F.hex(_col(code)), 8, "0")), "UTF-32")


def left(x, n: int) -> Column:
    if n < 0:
        raise ValueError("left: the length can't be negative")
    return F.substring(_col(x), 1, n)


def right(x, n: int) -> Column:
    if n < 0:
        raise ValueError("right: the length can't be negative")
    return F.right(_col(x), F.lit(n))


def like(x, pattern: str, escape: str | None = None, ignore_case: bool = False) -> Column:
    """LIKE without a default escape character; ILIKE folds A-Z only."""
    out, k = [], 0
    while k < len(pattern):
        c = pattern[k]
        if escape and c == escape and k + 1 < len(pattern):
            k += 1
            out.append(re.escape(pattern[k]))
        else:
            out.append(".*" if c == "%" else "." if c == "_" else re.escape(c))
        k += 1
    body = "".join(out)
    return (lower(x) if ignore_case else _col(x)).rlike(rf"(?s)\A{body.lower() if ignore_case and body.isascii() else body}\z")


def nocase(x) -> Column:
    """The sort and comparison key of COLLATE NOCASE."""
    return lower(x)


def rtrim_key(x) -> Column:
    """The comparison key of COLLATE RTRIM."""
    return F.rtrim(_col(x))
