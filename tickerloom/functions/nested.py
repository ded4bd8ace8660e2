"""JSON documents, arrays and maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickerloom.functions.scalar import col, finite
from tickerloom.functions.text import bearish_signal, chart_url


def decoded(text: str | Column, schema: str) -> Column:
    """Parsed JSON; blank or broken text gives null, not an error."""
    return F.from_json(col(text), schema)


def snapshot_body(document: str | Column, plan_schema: str) -> Column:
    """A snapshot document, which is a list or ``{"plans": [...]}``, parsed once into ``plans`` and ``broken``."""
    text = F.ltrim(col(document))
    wrapped = F.when(F.startswith(text, F.lit("[")), F.concat(F.lit('{"plans":'), text, F.lit("}"))).otherwise(text)
    schema = f"struct<plans:array<{plan_schema}>,broken:string>"
    return F.from_json(wrapped, schema, {"columnNameOfCorruptRecord": "broken"})


def chart_map(text: str | Column, root: str) -> Column:
    """``code → {kind → url}``; a plain path is filed under the kind ``default``."""
    # Parsed once as a variant; what a code holds tells its own kind.
    outer = F.try_variant_get(F.try_parse_json(col(text)), "$", "map<string,variant>")

    def inner(_, value):
        kinds = F.coalesce(F.try_variant_get(value, "$", "map<string,variant>"), F.create_map(F.lit("default"), value))
        return F.transform_values(kinds, lambda _, path: chart_url(F.try_variant_get(path, "$", "string"), root))

    return F.transform_values(outer, inner)


def without_keys(mapping: str | Column, *keys: str) -> Column:
    return F.map_filter(col(mapping), lambda k, _: ~k.isin(*keys))


def any_contains(items: str | Column, word: str) -> Column:
    return F.coalesce(F.exists(col(items), lambda x: F.contains(x, F.lit(word))), F.lit(False))


def not_empty(items: str | Column) -> Column:
    return F.coalesce(F.size(col(items)), F.lit(0)) > 0


def signal_polarity(signals: str | Column) -> Column:
    return F.transform(
        col(signals), lambda s: F.struct(s.alias("signal"), F.when(bearish_signal(s), "bear").otherwise("bull").alias("side"))
    )


def json_safe(value: Column, kind: T.DataType) -> Column:
    """``value`` with every NaN or infinity inside it replaced by null."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return finite(value)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: json_safe(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(value, lambda _, x: json_safe(x, kind.valueType))
    if isinstance(kind, T.StructType):
        fields = [json_safe(value[f.name], f.dataType).alias(f.name) for f in kind.fields]
        return F.when(value.isNotNull(), F.struct(*fields))
    return value


def safe_json_rows(df: DataFrame, column: str = "json") -> DataFrame:
    """Each row as one JSON object that any strict parser accepts."""
    fields = [json_safe(F.col(f.name), f.dataType).alias(f.name) for f in df.schema.fields]
    return df.select(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias(column))
