"""Python-style list/dict literal text to JSON text."""

from __future__ import annotations

import ast
import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType, StringType

from souqlytics.functions.text import strip


def _to_json(text: str) -> str:
    try:
        return json.dumps(ast.literal_eval(text), ensure_ascii=False)
    except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
        return json.dumps(text, ensure_ascii=False)


@F.pandas_udf(StringType())
def _literal_udf(texts: pd.Series) -> pd.Series:
    return texts.map(_to_json, na_action="ignore")


def literal_to_json(c: Column) -> Column:
    """JSON text of a literal; null or blank gives null, unreadable text a JSON string.

    Plain lists of single-quoted words and plain Arabic-script text, nearly all of
    real input, stay in the JVM; only the remainder is handed to Python.
    """
    text = strip(c.cast("string"))
    # A list qualifies when cutting out its quoted words leaves only '[]'.
    bare = F.regexp_replace(F.regexp_replace(text, r"'[^'\"\\\p{Cntrl}]*'", "\u0001"), r"\s+", "")
    is_plain_list = F.regexp_replace(bare, "\u0001(?:,|(?=\\]))", "") == "[]"
    items = F.regexp_extract_all(text, F.lit(r"'([^'\"\\\p{Cntrl}]*)'"), 1)
    plain_list = F.when(F.size(items) == 0, "[]").otherwise(
        F.concat(F.lit('["'), F.array_join(items, '", "'), F.lit('"]'))
    )
    is_plain_text = text.rlike(r'^[\p{IsArabic}][^"\\\p{Cntrl}]*$')
    rest = F.when(~is_plain_list & ~is_plain_text & (text != ""), text)
    return (
        F.when(text == "", None)
        .when(is_plain_list, plain_list)
        .when(is_plain_text, F.concat(F.lit('"'), text, F.lit('"')))
        .otherwise(_literal_udf(rest))
    )


def columns_to_json(df: DataFrame, columns: tuple[str, ...] = ("advantages", "disadvantages")) -> DataFrame:
    """The columns as JSON text; arrays, maps and structs are written directly."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    return df.withColumns(
        {
            c: literal_to_json(F.col(c)) if isinstance(kinds[c], AtomicType) else F.to_json(c)
            for c in columns
            if c in kinds
        }
    )
