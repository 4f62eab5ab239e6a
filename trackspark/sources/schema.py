"""Column names and schemas shared by the readers and operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

FPS = 40

# Body parts of a pose track, in file order.
PARTS = [
    "A_head", "B_rightoperculum", "C_tailbase", "D_tailtip", "E_leftoperculum",
    "F_spine1", "G_spine2", "H_spine3", "I_spine4", "J_spine5", "K_spine6", "L_spine7",
    "left_eye", "right_eye",
]
# Parts along the spine, head first.
SPINE8 = ["A_head", "F_spine1", "G_spine2", "H_spine3", "I_spine4", "J_spine5", "K_spine6", "L_spine7"]
# The same with the two derived midpoints.
SPINE10 = ["A_head", "F_spine1", "mid_spine1_spine2", "G_spine2", "mid_spine2_spine3",
           "H_spine3", "I_spine4", "J_spine5", "K_spine6", "L_spine7"]

POSE_LONG = T.StructType([
    T.StructField("track_id", T.LongType()), T.StructField("frame", T.LongType()),
    T.StructField("part", T.StringType()), T.StructField("x", T.DoubleType()),
    T.StructField("y", T.DoubleType()), T.StructField("likelihood", T.DoubleType()),
])
BOUTS = T.StructType([
    T.StructField("track_id", T.LongType()), T.StructField("behaviour", T.StringType()),
    T.StructField("start", T.LongType()), T.StructField("stop", T.LongType()),
])
SIGNAL = T.StructType([
    T.StructField("track_id", T.LongType()), T.StructField("frame", T.LongType()),
    T.StructField("signal", T.DoubleType()),
])


def check_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Fail early when a table lacks a declared column or types differ."""
    have = {f.name: f.dataType for f in df.schema}
    wrong = [f"{f.name}: want {f.dataType.simpleString()}, have {have[f.name].simpleString() if f.name in have else 'none'}"
             for f in schema if have.get(f.name) != f.dataType]
    if wrong:
        raise ValueError("; ".join(wrong))
    return df.select(*schema.names)
