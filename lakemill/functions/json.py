"""JSON text functions; paths are $, .key and [i]."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def json_extract(j, path: str, kind: str = "string") -> Column:
    """The value at a path as the named type; containers as JSON text."""
    return F.get_json_object(_col(j), path).cast(kind)


def arrow(j, key: str | int) -> Column:
    """j -> key: JSON text, strings quoted."""
    found = F.try_variant_get(F.try_parse_json(_col(j)), _path(key), "variant")
    return F.to_json(found)


def arrow_text(j, key: str | int) -> Column:
    """j ->> key: text; JSON null is null."""
    return F.get_json_object(_col(j), _path(key))


def _path(key: str | int) -> str:
    return f"$[{key}]" if isinstance(key, int) else key if key.startswith("$") else f"$.{key}"


def json_array_length(j, path: str = "$") -> Column:
    """The number of elements; 0 for what isn't an array."""
    text = _col(j) if path == "$" else F.get_json_object(_col(j), path)
    return F.when(text.isNotNull(), F.coalesce(F.json_array_length(text), F.lit(0))).cast("long")


def json_valid(j) -> Column:
    return F.when(_col(j).isNotNull(), F.try_parse_json(_col(j)).isNotNull())


def json_type(j, path: str = "$") -> Column:
    """null, true, false, text, integer, real, array or object."""
    v = F.try_variant_get(F.try_parse_json(_col(j)), path, "variant")
    kind = F.schema_of_variant(v)
    return (
        F.when(v.isNull(), None)
        .when(kind == "VOID", "null")
        .when(kind == "BOOLEAN", F.to_json(v))
        .when(kind == "STRING", "text")
        .when(kind.startswith("ARRAY"), "array")
        .when(kind.startswith("OBJECT"), "object")
        .when(kind == "BIGINT", "integer")
        .otherwise("real")
    )


def json_array(*cols) -> Column:
    """JSON text of values of one type, nulls kept."""
    return F.to_json(F.array(*[_col(c) for c in cols]), {"ignoreNullFields": "false"})


def json_object(**fields) -> Column:
    """JSON text with sorted keys, nulls kept."""
    return F.to_json(F.struct(*[_col(fields[k]).alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})
