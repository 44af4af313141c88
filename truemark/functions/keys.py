"""Portable keys: a record's logical partition and key bucket come from md5, the same in any engine.

A key is an injective text of its columns: for each a null tag, or a number and a semicolon, or a
text's length, a colon and the text, so that no separator inside a string can make two keys one. Doubles enter by exact
arithmetic instead of their text, which engines print differently: whole part, the next 53 binary
digits and 30 more, which is every finite double from 2**-31 to 2**63 in size, and 0. NaN and the infinities have
names. Other doubles, larger or smaller, enter by a hash that no two doubles share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PARTITIONS, BUCKETS = 64, 256

#: Text of doubles beyond exact arithmetic: xxhash64 of one double is one to one, in Spark alone.
SPARK_REST, OTHER_REST = "concat('x', hex(xxhash64({c})))", "concat('x', cast({c} AS varchar))"


def double_text(c: str, rest: str = SPARK_REST) -> str:
    """SQL for the text of a double that is not NULL; -0 is 0."""
    whole = f"floor(abs({c}))"
    part = f"((abs({c}) - {whole}) * 9007199254740992e0)"
    left = f"(({part} - floor({part})) * 1073741824e0)"
    whole_text = lambda x: f"cast(cast({x} AS bigint) AS {'string' if rest == SPARK_REST else 'varchar'})"
    sign = f"CASE WHEN {c} < 0 THEN '-' ELSE '' END"
    return (
        f"CASE WHEN isnan({c}) THEN 'NaN' WHEN abs({c}) > 1.7976931348623157e308 THEN concat({sign}, 'inf') WHEN abs({c}) >= 9223372036854775808e0 THEN {rest.format(c=c)}"
        f" WHEN {part} = 0 THEN concat({sign}, {whole_text(whole)})"
        f" WHEN {left} = floor({left}) THEN concat({sign}, {whole_text(whole)}, '.', {whole_text(f'floor({part})')}, '.', {whole_text(left)}) ELSE {rest.format(c=c)} END"
    )


def canonical(columns: list[tuple[str, str]], rest: str = SPARK_REST) -> str:
    """SQL for the canonical text of (name, kind) columns; kind is double, number (whole), or text for all else."""
    parts = []
    for name, kind in columns:
        text = f"cast({name} AS {'string' if rest == SPARK_REST else 'varchar'})"
        marked = f"concat({double_text(name, rest)}, ';')" if kind == "double" else f"concat({text}, ';')" if kind == "number" else f"concat(length({text}), ':', {text})"
        parts.append(f"CASE WHEN {name} IS NULL THEN '~' ELSE {marked} END")
    return f"concat({', '.join(parts)})"


def kinds(df: DataFrame) -> list[tuple[str, str]]:
    """(quoted name, kind) of all columns, for ``canonical``. Columns of nested types are refused."""
    found = []
    for f in df.schema.fields:
        kind = f.dataType.typeName()
        if kind in ("array", "map", "struct", "binary", "variant"):
            raise ValueError(f"{f.name}: a {kind} has no canonical text")
        name = "`" + f.name.replace("`", "``") + "`"
        found.append((name if kind != "float" else f"cast({name} AS double)", "double" if kind in ("double", "float") else "number" if kind in ("byte", "short", "integer", "long") else "text"))
    return found


def _marked(c: str, kind: str) -> str:
    """A column's part of ``canonical``, for rows of many columns.

    The JVM never compiles a method of more than 8000 bytes, which the texts of four doubles come to when
    Spark writes all of a stage into one. So a double has its conditions first, where Spark works out what they
    and the text have in common once, and the rare ones are left to a lambda, which also makes Spark
    write the projection apart from its stage and split it into short methods, however many columns there are.
    """
    if kind != "double":
        text = f"cast({c} AS string)"
        return f"coalesce({f"concat({text}, ';')" if kind == "number" else f"concat(length({text}), ':', {text})"}, '~')"
    size, whole = f"abs({c})", f"floor(abs({c}))"
    part = f"(({size} - {whole}) * 9007199254740992e0)"
    left = f"(({part} - floor({part})) * 1073741824e0)"
    digits = f"CASE WHEN {part} = 0 THEN ';' ELSE concat('.', cast(floor({part}) AS string), '.', cast(cast({left} AS bigint) AS string), ';') END"
    return (
        f"CASE WHEN {left} = floor({left}) AND {size} < 9223372036854775808e0 THEN concat(CASE WHEN {c} < 0 THEN '-' ELSE '' END, cast({whole} AS string), {digits})"
        f" WHEN {c} IS NULL THEN '~' ELSE concat(transform(array({c}), x -> {double_text('x')})[0], ';') END"
    )


def row_key(df: DataFrame, columns: list[str] | None = None) -> Column:
    """32 bytes for a whole row, or for some columns: equal rows, NULL equal to NULL, have equal keys.

    They are the sha256 of the ``canonical`` text.
    """
    chosen = df if columns is None else df.select(*("`" + c.replace("`", "``") + "`" for c in columns))
    return F.unhex(F.sha2(F.expr(f"concat({', '.join(_marked(*c) for c in kinds(chosen))})"), 256))


#: Columns of the events key, and its text in Spark and in engines that say varchar.
EVENT_COLUMNS = [("user_id", "number"), ("event_type", "text"), ("value", "double")]
EVENT_KEY, EVENT_KEY_SQL = canonical(EVENT_COLUMNS), canonical(EVENT_COLUMNS, OTHER_REST)


def portable_hash(text: Column, n: int) -> Column:
    """The first 32 bits of md5 modulo ``n``."""
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long"), F.lit(n)).cast("int")


def partition_id(key: str = EVENT_KEY) -> Column:
    return portable_hash(F.expr(key), PARTITIONS)


def bucket_id(key: str = EVENT_KEY) -> Column:
    return portable_hash(F.expr(key), BUCKETS)
