"""LOAD CSV."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import TypeMismatchError
from ..functions.typed import MISSING, Typed
from ..operators.expressions import Scope, lower
from ..operators.frame import Frame, Value
from ..operators.match import Matcher
from ..plans import syntax as s


def _constant(m: Matcher, e: s.Node, what: str) -> str:
    x: Typed = lower(e, Scope({}, m.params))
    if x.value is MISSING or not isinstance(x.value, str):
        raise TypeMismatchError(f"{what} must be a string")
    return x.value


def load_csv(m: Matcher, frame: Frame, e: s.LoadCsv) -> Frame:
    """A variable per line: a map of strings by header, or a list of strings. Empty fields are null; lines of unequal
    length are errors. The URL is a path or any URI that Spark reads."""
    url = _constant(m, e.url, "the URL of LOAD CSV")
    by = "," if e.terminator is None else _constant(m, e.terminator, "FIELDTERMINATOR")[:1]
    if not by or not by.isascii():
        raise TypeMismatchError("FIELDTERMINATOR must start with an ASCII character")
    reader = m.graph.spark.read.option("sep", by).option("header", str(e.headers).lower()).option("inferSchema", "false").option("nullValue", "").option("emptyValue", "").option("multiLine", "true").option("escape", '"')
    df = reader.csv(url)
    strict = T.StructType([T.StructField(c, T.StringType()) for c in df.columns])
    df = reader.option("mode", "FAILFAST").option("enforceSchema", "false").schema(strict).csv(url)
    fields = [F.nullif(F.col(f"`{c}`"), F.lit("")) for c in df.columns]
    if e.headers:
        made, kind = F.struct(*[f.alias(c) for f, c in zip(fields, df.columns, strict=True)]), strict
    else:
        made, kind = F.array(*fields), T.ArrayType(T.StringType())
    column = f"{e.name}@{m.names.fresh('')}"
    rows = df.select(made.alias(column))
    out = rows if frame.unit else frame.df.crossJoin(rows)
    return frame.bind(out, **{e.name: Value(column, kind)})
