"""Column expressions.  All of them stay inside whole-stage code generation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from stratawave import lookups


def clean_double(c: Column) -> Column:
    """NaN and infinities become NULL, so ``isNull`` is the one missing test."""
    bad = F.isnan(c) | c.isin(float("inf"), float("-inf"))
    return F.when(~bad, c)


def coerce_number(c: Column) -> Column:
    """First number inside a text; missing tokens and texts without one are NULL."""
    text = F.regexp_replace(c.cast("string"), ",", "")
    number = F.regexp_extract(text, r"-?(\d+\.?\d*|\.\d+)", 0)
    return F.when(~c.cast("string").rlike(lookups.MISSING_NUMBER_PATTERN), number.try_cast("double"))


def parse_month(c: Column) -> Column:
    """Date, ``YYYY-MM-DD``, ``YYYY-MM`` or ``1960M01`` to the first of its month."""
    text = F.trim(c.cast("string"))
    dated = F.coalesce(
        text.try_cast("date"),
        F.concat(text, F.lit("-01")).try_cast("date"),
        F.concat(F.regexp_replace(text, "^(\\d{4})M(\\d{2})$", "$1-$2"), F.lit("-01")).try_cast("date"),
    )
    return F.trunc(dated, "month").cast("date")


def month_anchor(c: Column, anchor: str = "start") -> Column:
    if anchor == "end":
        return F.last_day(c)
    return F.trunc(c, "month").cast("date")


def slug(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_")


def snake_case(c: Column) -> Column:
    """Lower snake case: camel humps and other characters become single underscores."""
    humps = F.regexp_replace(c, "([a-z0-9])([A-Z])", "$1_$2")
    return F.regexp_replace(F.regexp_replace(F.lower(humps), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def lookup(c: Column, table: Mapping[str, str], default: Column | None = None) -> Column:
    """Value of a small fixed dictionary, ``default`` where the key is unknown."""
    if not table:
        return default if default is not None else F.lit(None).cast("string")
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    found = F.try_element_at(pairs, c)
    return found if default is None else F.coalesce(found, default)


def index_name(c: Column, to_upper: bool = True) -> Column:
    """Canonical index name; an unknown name is returned as it came."""
    key = F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    out = lookup(key, lookups.INDEX_NAMES, default=c)
    return out if to_upper else F.lower(out)


def first_match(c: Column, patterns: Sequence[tuple[str, str]], otherwise: str) -> Column:
    """Label of the first pattern found in ``c``."""
    branches = [F.when(c.rlike(pattern), F.lit(label)) for pattern, label in patterns]
    return F.coalesce(*branches, F.lit(otherwise))


def group_label(c: Column, patterns: Sequence[tuple[str, str]] = lookups.GROUP_PATTERNS) -> Column:
    return first_match(F.lower(c), patterns, "Other")


def study_group(c: Column, groups: Mapping[str, Sequence[str]] = lookups.STUDY_GROUPS) -> Column:
    """Group by exact membership."""
    key = F.lower(c)
    return F.coalesce(*[F.when(key.isin(*ids), F.lit(g)) for g, ids in groups.items()], F.lit("Other"))


def display_name(c: Column, names: Mapping[str, str] = lookups.DISPLAY_NAMES) -> Column:
    return lookup(c, names, default=F.initcap(F.regexp_replace(c, "_", " ")))


def fold_proxy(c: Column, synonyms: Mapping[str, str] = lookups.PROXY_SYNONYMS) -> Column:
    return lookup(F.lower(c), synonyms, default=c)


def n_missing(columns: Sequence[str]) -> Column:
    """Number of NULLs among ``columns`` in a row."""
    return reduce(lambda a, b: a + b, [F.col(c).isNull().cast("int") for c in columns])


def first_missing(columns: Sequence[str]) -> Column:
    """Name of the first NULL column, NULL if the row is complete."""
    return F.coalesce(*[F.when(F.col(c).isNull(), F.lit(c)) for c in columns])


def unit_scale(max_abs: Column) -> Column:
    """Unit that fits a magnitude: ``struct(scale, suffix)``."""
    def unit(scale: float, suffix: str) -> Column:
        return F.struct(F.lit(scale).alias("scale"), F.lit(suffix).alias("suffix"))

    return (
        F.when(max_abs < 1e-4, unit(1e6, "ppm"))
        .when(max_abs < 1e-2, unit(1e4, "bps"))
        .when(max_abs < 1.0, unit(100.0, "%"))
        .otherwise(unit(1.0, ""))
    )


def profile_value(kind: str, step: Column, length: Column, decay: float = 0.5,
                  values: Sequence[float] | None = None) -> Column:
    """Height of a shock profile at 0-based ``step`` of ``length`` steps."""
    share = F.when(length > 1, step / (length - 1)).otherwise(F.lit(0.0))
    if kind == "constant":
        return F.lit(1.0)
    if kind == "ramp":
        return share
    if kind == "expdecay":
        return F.pow(F.lit(float(decay)), step)
    if kind == "sinus":
        return F.sin(share * F.pi())
    if kind == "custom":
        return F.get(F.array(*[F.lit(float(v)) for v in values or ()]), step)
    raise ValueError(f"unknown profile {kind!r}")
