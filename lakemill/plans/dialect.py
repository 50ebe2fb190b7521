"""Functions and operators of the dialect, as Spark SQL text.

Each entry takes the texts of a call's arguments and gives the text that
replaces the call; Catalyst sees built-in functions only.
"""

from __future__ import annotations

import re
from collections.abc import Callable

_WHOLE = "('tinyint', 'smallint', 'int', 'bigint')"
_MICROS = {"microsecond": 1, "millisecond": 1_000, "second": 1_000_000, "minute": 60_000_000, "hour": 3_600_000_000, "day": 86_400_000_000, "week": 604_800_000_000}
#: strftime codes as date_format patterns (fixed values).
_FORMATS = {"Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "j": "DDD"}
#: Collations of the dialect and Spark's names of them (fixed values).
COLLATIONS = {"NOCASE": "UTF8_LCASE", "RTRIM": "UTF8_BINARY_RTRIM", "BINARY": "UTF8_BINARY"}


def divide(a: str, b: str) -> str:
    """a / b: whole numbers divide to whole ones, and by zero to NULL."""
    whole = f"typeof({a}) IN {_WHOLE} AND typeof({b}) IN {_WHOLE}"
    return f"IF({whole}, CAST({a} AS BIGINT) div nullif(CAST({b} AS BIGINT), 0), try_divide({a}, {b}))"


def modulo(a: str, b: str) -> str:
    return f"try_mod({a}, {b})"


def _literal(text: str) -> str:
    if not re.fullmatch(r"'(?:[^']|'')*'", text):
        raise ValueError(f"a literal is needed here: {text}")
    return text[1:-1].replace("''", "'")


def _all_or_null(name: str) -> Callable[..., str]:
    return lambda *args: f"CASE WHEN {' OR '.join(f'({a}) IS NULL' for a in args)} THEN NULL ELSE {name}({', '.join(args)}) END"


def _substring(x: str, start: str, count: str | None = None) -> str:
    return f"substring({x}, greatest({start}, 1)" + (f", {count})" if count else ")")


def _micros(x: str) -> str:
    return f"unix_micros(CAST({x} AS TIMESTAMP_LTZ))"


def _date_diff(part: str, a: str, b: str) -> str:
    unit = _literal(part).lower().rstrip("s")
    if unit in _MICROS:
        return f"CAST(floor(({_micros(b)} - {_micros(a)}) / {_MICROS[unit]}.0D) AS BIGINT)"
    return f"timestampdiff({unit.upper()}, {a}, {b})"


def _strftime(fmt: str, x: str) -> str:
    parts = []
    for code, text in re.findall(r"%(.)|([^%]+)", _literal(fmt)):
        if code in _FORMATS:
            parts.append(f"date_format({x}, '{_FORMATS[code]}')")
        elif code == "f":
            parts.append(f"date_format({x}, 'ss.SSS')")
        elif code == "s":
            parts.append(f"CAST(unix_seconds(CAST({x} AS TIMESTAMP_LTZ)) AS STRING)")
        elif code == "w":
            parts.append(f"CAST(dayofweek({x}) - 1 AS STRING)")
        elif code == "%" or text:
            parts.append("'" + (text or "%").replace("'", "''") + "'")
        else:
            raise ValueError(f"strftime knows no %{code}")
    return f"concat({', '.join(parts)})" if parts else "''"


def _json_type(value: str) -> str:
    """The dialect's name of a variant's type."""
    kind = f"schema_of_variant({value})"
    return (
        f"CASE WHEN {kind} = 'VOID' THEN 'null' WHEN {kind} = 'BOOLEAN' THEN CAST({value} AS STRING) WHEN {kind} = 'BIGINT' THEN 'integer' WHEN {kind} = 'STRING' THEN 'text' "
        f"WHEN startswith({kind}, 'ARRAY') THEN 'array' WHEN startswith({kind}, 'OBJECT') THEN 'object' ELSE 'real' END"
    )


def _variant(j: str, path: str | None = None) -> str:
    return f"try_parse_json({j})" if path is None else f"try_variant_get(try_parse_json({j}), {path}, 'variant')"


def _array_agg(body: str) -> str:
    """JSON text of the values, NULL among them, in order."""
    m = re.fullmatch(r"\s*(DISTINCT\s+)?(.*?)(?:\s+ORDER BY\s+(.*?)(\s+ASC|\s+DESC)?)?\s*", body, re.I | re.S)
    distinct, x, order, direction = m[1], m[2], m[3], (m[4] or "").strip().upper()
    rows = f"collect_{'set' if distinct else 'list'}(named_struct('k', {order or x if distinct or order else '0'}, 'v', {x}))"
    if order or distinct:
        rows = f"array_sort({rows})"
    if direction == "DESC":
        rows = f"reverse({rows})"
    return f"CASE WHEN count(*) > 0 THEN to_json(transform({rows}, s -> s.v)) END"


def _series(start: str, stop: str, step: str = "1") -> str:
    if step.lstrip().upper().startswith("INTERVAL"):
        fits = f"{start} >= {stop}" if "-" in step else f"{start} <= {stop}"
    else:
        fits = f"(({step}) > 0 AND {start} <= {stop}) OR (({step}) < 0 AND {start} >= {stop})"
    return f"explode(CASE WHEN {fits} THEN sequence({start}, {stop}, {step}) END)"


def _json_rows(j: str, path: str | None = None) -> str:
    return f"(SELECT coalesce(key, CAST(pos AS STRING)) AS key, CAST(value AS STRING) AS value, {_json_type('value')} AS type FROM variant_explode({_variant(j, path)}))"


CALLS: dict[str, Callable[..., str]] = {
    "concat": lambda *args: f"concat_ws('', {', '.join(args)})",
    "substr": _substring,
    "substring": _substring,
    "total": lambda x: f"coalesce(sum(CAST({x} AS DOUBLE)), 0.0D)",
    "greatest": _all_or_null("greatest"),
    "least": _all_or_null("least"),
    "iif": lambda c, a, b: f"if({c}, {a}, {b})",
    "date_diff": _date_diff,
    "strftime": _strftime,
    "json_extract": lambda j, path: f"try_variant_get(try_parse_json({j}), {path}, 'string')",
    "json_valid": lambda j: f"(({j}) IS NULL OR try_parse_json({j}) IS NOT NULL)",
    "json_type": lambda j, path="'$'": _json_type(_variant(j, path)),
    "gen_random_uuid": lambda: "uuid()",
    "uuid_parse": lambda x: f"unhex(replace({x}, '-', ''))",
    "uuid_to_string": lambda x: rf"regexp_replace(lower(hex({x})), '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '$1-$2-$3-$4-$5')",
    "make_timestamp": lambda *args: f"make_timestamp_ntz({', '.join(args)})",
}

#: Calls that make rows; a place in FROM may need LATERAL before them.
TABLES: dict[str, Callable[..., str]] = {"generate_series": _series, "json_each": _json_rows}
WHOLE_BODY: dict[str, Callable[[str], str]] = {"array_agg": _array_agg}


def quantified(value: str, op: str, which: str, sub: str) -> str:
    """value op ANY/ALL (sub), by one row of sub's extremes and counts, with SQL's three values."""
    op = "<>" if op == "!=" else op
    if which == "ALL":
        negated = {"=": "<>", "<>": "=", "<": ">=", "<=": ">", ">": "<=", ">=": "<"}[op]
        return f"(NOT {quantified(value, negated, 'ANY', sub)})"
    if op == "=":
        return f"({value} IN ({sub}))"
    of = lambda f: f"(SELECT {f} FROM ({sub}) AS __q(v))"
    test = f"{value} <> {of('min(v)')} OR {value} <> {of('max(v)')}" if op == "<>" else f"{value} {op} {of('max(v)' if op[0] == '<' else 'min(v)')}"
    return f"(CASE WHEN {of('count(*)')} = 0 THEN false WHEN {test} THEN true WHEN {value} IS NULL OR {of('count(*) - count(v)')} > 0 THEN NULL ELSE false END)"
