"""Schemas of the tables that pass between the stages."""

from __future__ import annotations

import types
import typing

from pyspark.sql import types as T

#: A raster, as Spark's image source has it: rows of BGR bytes.
IMAGE = T.StructType([T.StructField("origin", T.StringType()), *[T.StructField(k, T.IntegerType()) for k in ("height", "width", "nChannels", "mode")], T.StructField("data", T.BinaryType())])
ROTATION = "angle int, confidence double, original_angle double, applied_rotation boolean"
CRITIC = "score int, issues array<string>, needs_revision boolean"
STATE = "accumulated_text string, iteration_count int, generation_history array<string>, critic_score int, critic_issues array<string>, reflect_iteration int"
PAGE_TASK = "path string, page_number int"
METADATA = "file_name string, total_pages int, page_number int, processing_time double, parsing_mode string, reflect_iterations int, final_critic_score int, final_critic_issues array<string>, user_meta string"
RECORD = f"id string, content string, metadata struct<{METADATA.replace(' ', ': ').replace(',:', ',')}>"
DETECTION = "array<struct<box: array<array<double>>, text: string, confidence: double>>"

_SCALARS = {str: T.StringType(), int: T.LongType(), float: T.DoubleType(), bool: T.BooleanType()}


def struct_of(model: type) -> T.StructType:
    """The Spark schema of a model class with annotated fields (a pydantic model or a dataclass)."""
    hints = typing.get_type_hints(model)
    if not hints:
        raise TypeError(f"{model!r} has no annotated fields")
    return T.StructType([T.StructField(name, *_type_of(hint)) for name, hint in hints.items() if typing.get_origin(hint) is not typing.ClassVar and not name.startswith(("_", "model_config"))])


def _type_of(hint) -> tuple[T.DataType, bool]:
    """Data type and whether it may be null."""
    origin, args = typing.get_origin(hint), typing.get_args(hint)
    if origin in (typing.Union, types.UnionType):
        rest = [a for a in args if a is not type(None)]
        if len(rest) != 1:
            raise TypeError(f"{hint} has no Spark type")
        return _type_of(rest[0])[0], len(rest) < len(args)
    if origin in (list, tuple, set):
        kind, null = _type_of(args[0])
        return T.ArrayType(kind, null), False
    if origin is dict:
        kind, null = _type_of(args[1])
        return T.MapType(_type_of(args[0])[0], kind, null), False
    if hint in _SCALARS:
        return _SCALARS[hint], False
    return struct_of(hint), False
