"""Roles of the tables the operators work on, and the checks made at entry."""
from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import types as T

UNITS_BASE = T.StructType([
    T.StructField("unit_id", T.StringType(), False),
    T.StructField("entity_id", T.LongType(), False),
    T.StructField("study_id", T.LongType(), False),
    T.StructField("img_path", T.StringType()),
    T.StructField("gender", T.StringType()),
    T.StructField("age", T.DoubleType()),
    T.StructField("bmi", T.DoubleType()),
    T.StructField("view", T.StringType()),
    T.StructField("split", T.StringType()),
])

ADMISSIONS = T.StructType([
    T.StructField("subject_id", T.IntegerType(), False),
    T.StructField("hadm_id", T.IntegerType(), False),
    T.StructField("admittime", T.TimestampType()),
    T.StructField("race", T.StringType()),
])

PATIENTS = T.StructType([
    T.StructField("subject_id", T.IntegerType(), False),
    T.StructField("gender", T.StringType()),
    T.StructField("anchor_age", T.IntegerType()),
])

DIAGNOSES = T.StructType([
    T.StructField("subject_id", T.IntegerType(), False),
    T.StructField("hadm_id", T.IntegerType(), False),
    T.StructField("seq_num", T.IntegerType()),
    T.StructField("icd_code", T.StringType()),
    T.StructField("icd_version", T.ShortType()),
])

BODY_MEASURES = T.StructType([
    T.StructField("subject_id", T.IntegerType(), False),
    T.StructField("chartdate", T.DateType()),
    T.StructField("seq_num", T.IntegerType()),
    T.StructField("result_name", T.StringType()),
    T.StructField("result_value", T.StringType()),
])

EMBEDDINGS = T.StructType([
    T.StructField("model", T.StringType(), False),
    T.StructField("unit_id", T.StringType(), False),
    T.StructField("embedding", T.ArrayType(T.FloatType(), False), False),
])


def units_schema(flags: Iterable[str] = (), findings: Iterable[str] = ()) -> T.StructType:
    """The unit table: fixed columns, then 0/1 flags, then ternary findings."""
    extra = [T.StructField(f, T.IntegerType()) for f in flags]
    extra += [T.StructField(f, T.DoubleType()) for f in findings]
    return T.StructType(UNITS_BASE.fields + extra)


def labels_schema(findings: Iterable[str]) -> T.StructType:
    return T.StructType(
        [T.StructField("entity_id", T.LongType(), False), T.StructField("study_id", T.LongType(), False)]
        + [T.StructField(f, T.DoubleType()) for f in findings]
    )


def report_labels_schema(findings: Iterable[str]) -> T.StructType:
    return T.StructType(
        [T.StructField("unit_id", T.StringType(), False)]
        + [T.StructField(f, T.DoubleType()) for f in findings]
    )


_FAMILIES = {
    "numeric": (T.NumericType,),
    "string": (T.StringType,),
    "array": (T.ArrayType,),
    "any": (T.DataType,),
}


def require(df: DataFrame, **columns: str) -> DataFrame:
    """Fail early when a column is missing or of the wrong family."""
    fields = {f.name: f.dataType for f in df.schema.fields}
    for name, family in columns.items():
        if name not in fields:
            raise ValueError(f"column {name!r} is missing; have {sorted(fields)}")
        if not isinstance(fields[name], _FAMILIES[family]):
            raise TypeError(f"column {name!r} must be {family}, is {fields[name].simpleString()}")
    return df
