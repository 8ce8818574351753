"""Schemas of the six input tables (only the columns the reports read)."""

from pyspark.sql import types as T

COMPUTE_ENTRY = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("cluster_id", T.StringType()),
])

WORKSPACES = T.StructType([
    T.StructField("workspace_id", T.StringType()),
    T.StructField("workspace_name", T.StringType()),
])

RUN_TIMELINE = T.StructType([
    T.StructField("workspace_id", T.StringType()),
    T.StructField("job_id", T.StringType()),
    T.StructField("job_run_id", T.StringType()),
    T.StructField("period_start_time", T.TimestampType()),
    T.StructField("execution_duration_seconds", T.LongType()),
    T.StructField("compute", T.ArrayType(COMPUTE_ENTRY)),
])

CLUSTERS = T.StructType([
    T.StructField("workspace_id", T.StringType()),
    T.StructField("cluster_id", T.StringType()),
    T.StructField("cluster_source", T.StringType()),
])

JOBS = T.StructType([
    T.StructField("workspace_id", T.StringType()),
    T.StructField("job_id", T.StringType()),
    T.StructField("name", T.StringType()),
])

USAGE = T.StructType([
    T.StructField("usage_date", T.DateType()),
    T.StructField("usage_end_time", T.TimestampType()),
    T.StructField("workspace_id", T.StringType()),
    T.StructField("sku_name", T.StringType()),
    T.StructField("usage_unit", T.StringType()),
    T.StructField("usage_quantity", T.DecimalType(18, 3)),
    T.StructField("billing_origin_product", T.StringType()),
    T.StructField("product_features", T.StructType([
        T.StructField("is_serverless", T.BooleanType()),
    ])),
    T.StructField("usage_metadata", T.StructType([
        T.StructField("job_id", T.StringType()),
    ])),
    T.StructField("custom_tags", T.MapType(T.StringType(), T.StringType())),
])

LIST_PRICES = T.StructType([
    T.StructField("sku_name", T.StringType()),
    T.StructField("usage_unit", T.StringType()),
    T.StructField("price_start_time", T.TimestampType()),
    T.StructField("price_end_time", T.TimestampType()),
    T.StructField("pricing", T.StructType([
        T.StructField("default", T.DecimalType(18, 6)),
    ])),
])

ALL_TABLES = {
    "workspaces": WORKSPACES,
    "runs": RUN_TIMELINE,
    "clusters": CLUSTERS,
    "jobs": JOBS,
    "usage": USAGE,
    "prices": LIST_PRICES,
}


def _family(t: T.DataType) -> str:
    """Types that the reports treat alike have one family."""
    if isinstance(t, (T.IntegralType, T.DecimalType)):
        return "number"
    if isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "time"
    return "string" if isinstance(t, (T.StringType, T.VarcharType, T.CharType)) else t.typeName()


def _problems(have: T.DataType, need: T.DataType, path: str) -> list[str]:
    if isinstance(need, T.StructType):
        if not isinstance(have, T.StructType):
            return [f"{path}: {have.simpleString()} is no struct"]
        fields = {f.name: f.dataType for f in have.fields}
        out = []
        for f in need.fields:
            name = f"{path}.{f.name}" if path else f.name
            out += _problems(fields[f.name], f.dataType, name) if f.name in fields else [f"missing {name}"]
        return out
    if isinstance(need, T.ArrayType) and isinstance(have, T.ArrayType):
        return _problems(have.elementType, need.elementType, f"{path}[]")
    if isinstance(need, T.MapType) and isinstance(have, T.MapType):
        return (_problems(have.keyType, need.keyType, f"{path}.key")
                + _problems(have.valueType, need.valueType, f"{path}.value"))
    if _family(have) != _family(need):
        return [f"{path}: {have.simpleString()}, not {need.simpleString()}"]
    return []


def conforms(df_schema: T.StructType, expected: T.StructType) -> list[str]:
    """Fields of ``expected`` missing from ``df_schema``, or of another family of types.

    Only what the reports read is compared: further columns and struct
    fields, another precision, or a date for a timestamp are no problem.
    """
    return _problems(df_schema, expected, "")
