"""Sinks: a graph as one CREATE statement, and result rows as JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import plain_digits
from ..graph import PropertyGraph


def _quoted(x: Column) -> Column:
    for plain, safe in (("\\", "\\\\"), ("'", "\\'"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        x = F.replace(x, F.lit(plain), F.lit(safe))
    return F.concat(F.lit("'"), x, F.lit("'"))


def _value(x: Column, kind: T.DataType) -> Column:
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return plain_digits(x.cast("double"))
    if isinstance(kind, (T.IntegralType, T.BooleanType)):
        return x.cast("string")
    return _quoted(x.cast("string"))


def _properties(df: DataFrame, fixed: tuple[str, ...]) -> Column:
    names = sorted(c for c in df.columns if c not in fixed)
    parts = [F.when(F.col(f"`{n}`").isNotNull(), F.concat(F.lit(f"{n}: "), _value(F.col(f"`{n}`"), df.schema[n].dataType))) for n in names]
    if not parts:
        return F.lit("")
    joined = F.array_join(F.array_compact(F.array(*parts)), ", ")
    return F.when(joined != "", F.concat(F.lit(" {"), joined, F.lit("}"))).otherwise("")


def cypher_parts(graph: PropertyGraph) -> DataFrame:
    """(kind, id, part): what a CREATE statement of the graph lists, a row for each node and relationship."""
    out = None
    for labels, df in graph.nodes.items():
        mark = "".join(f":{x}" for x in labels)
        part = df.select(F.lit(0).alias("kind"), F.col("_id").alias("id"), F.concat(F.lit("(_"), F.col("_id").cast("string"), F.lit(mark), _properties(df, ("_id",)), F.lit(")")).alias("part"))
        out = part if out is None else out.unionAll(part)
    for kind, df in graph.edges.items():
        text = F.concat(F.lit("(_"), F.col("_src").cast("string"), F.lit(f")-[:{kind}"), _properties(df, ("_id", "_src", "_dst")), F.lit("]->(_"), F.col("_dst").cast("string"), F.lit(")"))
        part = df.select(F.lit(1).alias("kind"), F.col("_id").alias("id"), text.alias("part"))
        out = part if out is None else out.unionAll(part)
    return graph.spark.createDataFrame([], "kind int, id long, part string") if out is None else out.orderBy("kind", "id", "part")


def export_cypher(graph: PropertyGraph) -> str:
    """One CREATE statement that makes the graph; rows come to the driver one partition after the other. For graphs
    too large for a statement, write ``cypher_parts``."""
    parts = [r.part for r in cypher_parts(graph).toLocalIterator()]
    return "CREATE " + ",\n  ".join(parts) if parts else ""


def json_rows(df: DataFrame) -> DataFrame:
    """(value): every row as a JSON object; nodes and relationships with their properties apart."""
    cols = []
    for f in df.schema:
        x, kind = F.col(f"`{f.name}`"), f.dataType
        if isinstance(kind, T.StructType) and ("_labels" in kind.names or {"_type", "_src"} <= set(kind.names)):
            fixed = ["_id", "_labels"] if "_labels" in kind.names else ["_id", "_type", "_src", "_dst"]
            own = sorted(n for n in kind.names if n not in fixed)
            shaped = F.struct(*[x.getField(n).alias(n) for n in fixed], F.struct(*[x.getField(n).alias(n) for n in own]).alias("_properties"))
            x = F.when(x.isNotNull(), shaped)
        cols.append(x.alias(f.name))
    return df.select(F.to_json(F.struct(*cols)).alias("value"))
