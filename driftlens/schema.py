"""The fact table: one row for each function, table, shape, schema, branch arm or value site."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SETS = ("strings", "writes", "reads", "ret_keys", "calls", "consts", "decl_consts")
_TEXTS = ("file", "qualname", "name", "kind", "value", "sig", "source")

FUNCSIG = T.StructType(
    [T.StructField(x, T.StringType()) for x in ("file", "qualname", "name")]
    + [T.StructField(x, T.IntegerType()) for x in ("line", "n_lines", "node_count")]
    + [T.StructField(x, T.ArrayType(T.StringType())) for x in _SETS]
    + [T.StructField("delegates", T.BooleanType()), T.StructField("call_result_shapes", T.MapType(T.StringType(), T.ArrayType(T.StringType()))), T.StructField("test", T.BooleanType())]
    + [T.StructField(x, T.StringType()) for x in ("kind", "value", "sig", "source")]
)
LABEL = T.StructType([T.StructField(x, T.StringType()) for x in "ts repo detector lang variety a b verdict confidence".split()])
FIRE_TAG = T.StructType([T.StructField(x, T.StringType()) for x in "ts id verdict notes".split()])


def funcsig(df: DataFrame) -> DataFrame:
    """df with every column of FUNCSIG: missing ones and nulls get zero values, others go."""

    def of(f: T.StructField) -> Column:
        zero = {"string": F.lit(""), "int": F.lit(0), "boolean": F.lit(False)}.get(f.dataType.simpleString())
        if zero is None:
            zero = F.create_map() if isinstance(f.dataType, T.MapType) else F.array()
        zero = zero.cast(f.dataType)
        return (F.coalesce(F.col(f.name).cast(f.dataType), zero) if f.name in df.columns else zero).alias(f.name)

    return df.select(*map(of, FUNCSIG))
