"""Fixed schemas of tables, and what happens on entry: missing columns get declared defaults, wrong types are errors."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Field:
    """A column: its type, whether a table must have it, and what stands for it in a table that lacks it."""

    name: str
    type: T.DataType
    required: bool = False
    default: object = None


def doubles(*names: str, required: bool = False) -> list[Field]:
    return [Field(n, T.DoubleType(), required) for n in names]


#: Snapshots as features are made of them. A table without the magnetic index has that of a kp_index of 1.1.
SNAPSHOTS = [
    Field("satellite_number", T.LongType(), True), Field("epoch_dt", T.TimestampNTZType(), True), Field("common_name", T.StringType()), Field("epoch_rev", T.LongType()),
    *doubles(*(f"j2k_{kind}_{n}" for kind in ("pos", "vel") for n in "xyz"), required=True), *doubles(*(f"vector_{a}_sigma_km" for a in "uvw"), required=True),
    *doubles("ballistic_coef_m2kg", required=True), *doubles("solar_rad_press_coeff_m2kg", "solar_flux_f10", "average_f10"), Field("average_ap", T.DoubleType(), False, 10.0),
]
#: Event files of the catalogue.
CATALOG = [Field("OBJECT_NAME", T.StringType()), Field("OBJECT_ID", T.StringType()), Field("NORAD_CAT_ID", T.LongType(), True), *doubles("MEAN_MOTION", "ECCENTRICITY", required=True), Field("event_source", T.StringType(), False, "none")]
#: Labelled windows.
TARGETS = [
    Field("satellite_number", T.LongType(), True), Field("window_id", T.LongType(), True), Field("window_start_idx", T.LongType(), True), Field("window_end_idx", T.LongType(), True),
    Field("split", T.StringType(), True), Field("size_range", T.StringType()), Field("altitude_band", T.StringType()),
    Field("collision_risk", T.BooleanType(), True, False), Field("unc_vol_above_p90", T.BooleanType(), False, False), Field("has_future", T.BooleanType(), False, False),
]
#: Types that widen to a declared one without loss.
WIDENS = {"bigint": {"tinyint", "smallint", "int"}, "double": {"float", "tinyint", "smallint", "int"}}


def struct_of(fields: list[Field]) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.type, not f.required) for f in fields])


def conform(df: DataFrame, fields: list[Field], keep: tuple[str, ...] = ()) -> DataFrame:
    """df with exactly the columns of a schema, in its order, then those named in keep that it has.

    An optional column that df lacks is filled with its default. A required one that it lacks, and a type that neither is
    the declared one nor widens to it, are errors that name the column; all of them are found before a row is read.
    """
    has, wrong = {f.name: f.dataType for f in df.schema.fields}, []
    for f in fields:
        want = f.type.simpleString()
        if f.name not in has:
            if f.required:
                wrong.append(f"{f.name} is missing")
        elif (got := has[f.name].simpleString()) != want and got not in WIDENS.get(want, ()):
            wrong.append(f"{f.name} is {got}, not {want}")
    if wrong:
        raise ValueError("the table doesn't have its schema: " + "; ".join(wrong))
    own = [(F.col(f.name) if f.name in has else F.lit(f.default)).cast(f.type).alias(f.name) for f in fields]
    names = {f.name for f in fields}
    return df.select(*own, *(c for c in keep if c in has and c not in names))
