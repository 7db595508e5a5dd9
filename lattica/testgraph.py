"""The property graph over the star-schema tables: keys become ids under a code for each label."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .graph import PropertyGraph, Tables

#: Labels in the order of their codes.
LABELS = ("Region", "Nation", "Customer", "Supplier", "Part", "Order", "Event", "Turn", "Document", "Label")
#: Ids are code * 2**SHIFT + key.
SHIFT = 48
#: Types in the order of their codes; an edge's id is code * 2**EDGE_SHIFT + its number within the type.
TYPES = ("IN_REGION", "FROM_NATION", "PLACED", "CONTAINS", "SUPPLIED_BY", "SUPPLIES", "PERFORMED", "NEXT", "FOLLOWED_BY", "LABELLED")
EDGE_SHIFT = 56


def node_id(label: str, key: str | Column) -> Column:
    x = F.col(key) if isinstance(key, str) else key
    return F.lit(LABELS.index(label) << SHIFT) + x.cast("long")


def load(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """The graph of a folder; its tables are opened when a query needs them."""
    opened: dict[str, DataFrame] = {}

    def read(name: str) -> DataFrame:
        if name not in opened:
            opened[name] = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        return opened[name]

    turn_key = lambda turn="turn": F.col("conv_id") * 1024 + F.col(turn)
    keys = {
        "Region": ("region", "r_regionkey"),
        "Nation": ("nation", "n_nationkey"),
        "Customer": ("customer", "c_custkey"),
        "Supplier": ("supplier", "s_suppkey"),
        "Part": ("part", "p_partkey"),
        "Order": ("orders", "o_orderkey"),
        "Event": ("events", "event_id"),
        "Turn": ("conversations", None),
        "Document": ("documents", "doc_id"),
        "Label": ("labels", "doc_id"),
    }

    def nodes(label: str) -> DataFrame:
        name, key = keys[label]
        return read(name).select(node_id(label, key or turn_key()).alias("_id"), "*")

    def edges(df: DataFrame, kind: str, own: Column, a: tuple[str, str | Column], b: tuple[str, str | Column], *more: Column) -> DataFrame:
        own = F.lit(TYPES.index(kind) << EDGE_SHIFT) + own.cast("long")
        return df.select(own.alias("_id"), node_id(*a).alias("_src"), node_id(*b).alias("_dst"), *more)

    def lines(kind: str, a: tuple[str, str], b: tuple[str, str]) -> DataFrame:
        """lineitem has no key: lines of an order are counted in an order of all columns, under which ties are alike."""
        df = read("lineitem")
        number = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*[c for c in df.columns if c != "l_orderkey"]))
        more = [F.col(f"l_{c}").alias(c) for c in ("quantity", "extendedprice", "discount", "tax", "returnflag", "linestatus", "shipdate", "linenumber")]
        return edges(df.withColumn("__id", F.col("l_orderkey") * 4096 + number), kind, F.col("__id"), a, b, *more)

    def chain(df: DataFrame, kind: str, label: str, key: Column, by: str, *order: str) -> DataFrame:
        following = F.lead("__key").over(Window.partitionBy(by).orderBy(*order))
        df = df.withColumn("__key", key).withColumn("__next", following).filter("__next is not null")
        return edges(df, kind, F.col("__key"), (label, "__key"), (label, "__next"))

    def from_nation() -> DataFrame:
        return edges(read("customer"), "FROM_NATION", F.col("c_custkey") * 2, ("Customer", "c_custkey"), ("Nation", "c_nationkey")).unionAll(
            edges(read("supplier"), "FROM_NATION", F.col("s_suppkey") * 2 + 1, ("Supplier", "s_suppkey"), ("Nation", "s_nationkey"))
        )

    kinds = {
        "IN_REGION": lambda: edges(read("nation"), "IN_REGION", F.col("n_nationkey"), ("Nation", "n_nationkey"), ("Region", "n_regionkey")),
        "FROM_NATION": from_nation,
        "PLACED": lambda: edges(read("orders"), "PLACED", F.col("o_orderkey"), ("Customer", "o_custkey"), ("Order", "o_orderkey")),
        "CONTAINS": lambda: lines("CONTAINS", ("Order", "l_orderkey"), ("Part", "l_partkey")),
        "SUPPLIED_BY": lambda: lines("SUPPLIED_BY", ("Order", "l_orderkey"), ("Supplier", "l_suppkey")),
        "SUPPLIES": lambda: lines("SUPPLIES", ("Supplier", "l_suppkey"), ("Part", "l_partkey")),
        "PERFORMED": lambda: edges(read("events"), "PERFORMED", F.col("event_id"), ("Customer", "user_id"), ("Event", "event_id")),
        "NEXT": lambda: chain(read("events"), "NEXT", "Event", F.col("event_id"), "user_id", "ts", "event_id"),
        "FOLLOWED_BY": lambda: chain(read("conversations"), "FOLLOWED_BY", "Turn", turn_key(), "conv_id", "turn"),
        "LABELLED": lambda: edges(read("labels"), "LABELLED", F.col("doc_id"), ("Document", "doc_id"), ("Label", "doc_id")),
    }
    ends = {
        "IN_REGION": ("Nation", "Region"),
        "PLACED": ("Customer", "Order"),
        "CONTAINS": ("Order", "Part"),
        "SUPPLIED_BY": ("Order", "Supplier"),
        "SUPPLIES": ("Supplier", "Part"),
        "PERFORMED": ("Customer", "Event"),
        "NEXT": ("Event", "Event"),
        "FOLLOWED_BY": ("Turn", "Turn"),
        "LABELLED": ("Document", "Label"),
    }

    def holding(kind: str, name: str, side: str, own: Column, a: tuple[str, str], b: tuple[str, str]) -> DataFrame:
        df = read(name)
        return edges(df, kind, own, a, b, *[F.col(c).alias(f"{side}${c}") for c in df.columns])

    carried = {
        ("IN_REGION", "src", ("Nation",)): lambda: holding("IN_REGION", "nation", "src", F.col("n_nationkey"), ("Nation", "n_nationkey"), ("Region", "n_regionkey")),
        ("FROM_NATION", "src", ("Customer",)): lambda: holding("FROM_NATION", "customer", "src", F.col("c_custkey") * 2, ("Customer", "c_custkey"), ("Nation", "c_nationkey")),
        ("FROM_NATION", "src", ("Supplier",)): lambda: holding("FROM_NATION", "supplier", "src", F.col("s_suppkey") * 2 + 1, ("Supplier", "s_suppkey"), ("Nation", "s_nationkey")),
        ("PLACED", "dst", ("Order",)): lambda: holding("PLACED", "orders", "dst", F.col("o_orderkey"), ("Customer", "o_custkey"), ("Order", "o_orderkey")),
        ("PERFORMED", "dst", ("Event",)): lambda: holding("PERFORMED", "events", "dst", F.col("event_id"), ("Customer", "user_id"), ("Event", "event_id")),
    }
    return PropertyGraph(
        spark,
        Tables({(label,): (lambda label=label: nodes(label)) for label in LABELS}),
        Tables(kinds),
        {t: ((a,), (b,)) for t, (a, b) in ends.items()},
        Tables(carried),
        (),
        len(LABELS) << SHIFT,
        len(TYPES) << EDGE_SHIFT,
    )
