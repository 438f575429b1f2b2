"""Record views that the queries share, for Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidara.session import records, table


def rec(spark: SparkSession, d: str, name: str, *cols: str) -> DataFrame:
    """One row a record with the named columns and its key as ``id``."""
    df = table(spark, d, name)
    key = "temp_id" if name == "map_contexts" else "id"
    return records(df.select(F.col(key).alias("id"), *cols), "id")


def asked(c: Column | None = None) -> Column:
    """The stated query set: records whose number, their paper's plus their own, is divisible by 50."""
    c = F.col("id") if c is None else c
    return (F.substring(c, 2, 7).cast("int") + F.regexp_extract(c, "([0-9]+)$", 1).cast("int")) % 50 == 0


ASKED = "(cast(substr({0}, 2, 7) as int) + cast(regexp_extract({0}, '([0-9]+)$', 1) as int)) % 50 = 0"


def sql_rec(name: str, *cols: str) -> str:
    key = "temp_id" if name == "map_contexts" else "id"
    return f"(select {key} as id{''.join(f', any_value({c}) as {c}' for c in cols)} from {name} where {key} is not null group by {key})"


#: Compatibility forms that occur in typed values, for SQL: full-width letters, ligatures, signs.
_WIDE = "".join(chr(0xFF01 + i) for i in range(94))
_PLAIN = "".join(chr(0x21 + i) for i in range(94))


def sql_key(x: str, fold: bool = True) -> str:
    base = f"coalesce({x}, '')"
    if fold:
        plain = _PLAIN.replace("'", "''")
        base = f"replace(replace(translate({base}, '{_WIDE}', '{plain}'), 'ﬁ', 'fi'), 'ﬂ', 'fl')"
    return f"trim(regexp_replace(regexp_replace(lower({base}), '[‐-―]', '-', 'g'), '[^\\p{{L}}\\p{{N}}_%+./-]+', ' ', 'g'))"


def sql_slug(x: str) -> str:
    return f"regexp_replace(regexp_replace(lower({x}), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')"


def sql_case(x: str, groups: dict[str, tuple[str, ...]]) -> str:
    """The canonical name of a key by an alias list."""
    import re

    flat = {}
    for name, many in groups.items():
        for a in (name, *many):
            flat[re.sub(r"\s+", " ", re.sub(r"[^\w%+./-]+", " ", a.lower())).strip()] = name
    return f"(case {x} {' '.join(f"when '{a}' then '{n}'" for a, n in flat.items())} else {x} end)"


def sql_dot(a: str, b: str) -> str:
    return f"list_dot_product({a}, {b})"
