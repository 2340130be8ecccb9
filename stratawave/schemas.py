"""Declared schemas.  Sources never infer; drift is a comparison of StructTypes."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _D, _DT, _I, _B = T.StringType(), T.DoubleType(), T.DateType(), T.IntegerType(), T.BooleanType()


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields.items()])


LONG_PRICES = struct(date=_DT, series=_S, price=_D)

PANEL = struct(
    date=_DT, series_id=_S, series_name=_S, unit=_S,
    price=_D, ln_price=_D, ret=_D, vol_proxy=_D,
)
PANEL_KEY = ("series_id", "date")

INDEX_LONG = struct(index=_S, date=_DT, value=_D)

SCHEDULE_ITEM = struct(impulse=_S, t_start=_I, t_end=_I, size=_D)
SUB_SCENARIO = struct(name=_S, impulse=_S, size=_D, units=_S)
SCENARIO_SPEC = struct(
    name=_S, type=_S, regime=_S, horizon=_I,
    shocks=T.MapType(_S, _D), schedule=T.ArrayType(SCHEDULE_ITEM),
    impulse=_S, size=_D, units=_S, scenarios=T.ArrayType(SUB_SCENARIO),
)

SCENARIO_PATHS = struct(
    t=_I, variable=_S, value=_D, scenario=_S, is_baseline=_B, regime=_S,
    value_lo=_D, value_hi=_D, uncertainty=_S,
)

COEF = struct(model=_S, regime=_S, equation=_S, regressor=_S, lag=_I, value=_D)
RESID_COV = struct(model=_S, regime=_S, i=_S, j=_S, value=_D)
RESPONSES = struct(model=_S, regime=_S, impulse=_S, response=_S, h=_I, value=_D)


def drift(actual: T.StructType, expected: T.StructType) -> list[tuple[str, str]]:
    """Differences between two schemas as ``(column, problem)`` pairs."""
    have = {f.name: f.dataType for f in actual.fields}
    want = {f.name: f.dataType for f in expected.fields}
    out = [(c, "missing") for c in want if c not in have]
    out += [(c, "unexpected") for c in have if c not in want]
    out += [
        (c, f"type {have[c].simpleString()} instead of {want[c].simpleString()}")
        for c in want
        if c in have and have[c] != want[c]
    ]
    return out
