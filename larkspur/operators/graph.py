"""Dataflow graphs as tables of nodes and edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.functions.text import input_handle, output_handle

#: Input types that are form fields and not connections.
FORM_TYPES = ["string", "number", "boolean", "options", "multiOptions", "asyncOptions", "asyncMultiOptions", "json", "code", "datagrid", "file", "folder", "password", "tabs", "array", "credential"]


def duplicate_nodes(nodes: DataFrame, key: str = "id") -> DataFrame:
    return nodes.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def split_inputs(specs: DataFrame, inputs: str = "inputs") -> DataFrame:
    """specs with their inputs as params (form fields) and anchors (the others)."""
    return specs.withColumns({"params": F.filter(inputs, lambda i: i["type"].isin(FORM_TYPES)), "anchors": F.filter(inputs, lambda i: ~i["type"].isin(FORM_TYPES))}).drop(inputs)


def normalised(specs: DataFrame) -> DataFrame:
    """specs (name, type, base_classes, inputs, ...) whose base classes, if there are none, are the type."""
    return specs.withColumn("base_classes", F.when(F.coalesce(F.size("base_classes"), F.lit(0)) == 0, F.array("type")).otherwise(F.col("base_classes")))


def nodes_from_specs(wanted: DataFrame, specs: DataFrame) -> DataFrame:
    """wanted (id, name, given: map of inputs, credential) as nodes: params and anchors, inputs with their defaults under what is given, the
    credential among them if the spec takes one, and an output named and typed by the spec. A node whose spec is not there has the problem "no spec".
    """
    known = normalised(specs).select("name", "type", "base_classes", "inputs", "takes_credential", F.lit(True).alias("_known"))
    joined = split_inputs(wanted.join(known, "name", "left").withColumn("_inputs", F.col("inputs")), "_inputs")
    defaults = F.map_from_entries(F.transform(F.filter("inputs", lambda i: i["default"].isNotNull()), lambda i: F.struct(i["name"], i["default"])))
    given = F.coalesce("given", F.create_map().cast("map<string,string>"))
    own = F.map_filter(F.coalesce(defaults, F.create_map().cast("map<string,string>")), lambda k, _: ~F.map_contains_key(given, k))
    inputs = F.map_concat(own, given)
    credential = F.when(F.coalesce(F.col("takes_credential"), F.lit(False)), F.col("credential"))
    return joined.select(
        "id", "name", F.col("params.name").alias("params"), F.col("anchors.name").alias("anchors"), F.array_sort(F.map_entries(inputs)).alias("inputs"), credential.alias("credential"),
        F.coalesce("name", F.lit("")).alias("out_name"), F.array_join("base_classes", "|").alias("out_type"),
        F.get("anchors.name", F.lit(0)).alias("in_name"), F.get("anchors.type", F.lit(0)).alias("in_type"), F.when(F.col("_known").isNull(), "no spec").alias("problem"),
    )


def build(nodes: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The edges of a graph, and why it cannot be built: (what, id, problem) of repeated nodes, nodes without a spec and broken edges."""
    made = edges(links, nodes)
    twice = duplicate_nodes(nodes).select(F.lit("node").alias("what"), "id", F.lit("repeated").alias("problem"))
    unknown = nodes.filter("problem is not null").select(F.lit("node").alias("what"), "id", "problem") if "problem" in nodes.columns else twice.limit(0)
    broken = made.filter("problem is not null").select(F.lit("edge").alias("what"), "id", "problem")
    return made.filter("problem is null").drop("problem"), twice.unionByName(unknown).unionByName(broken)


def clone(nodes: DataFrame, links: DataFrame, prefix: str) -> tuple[DataFrame, DataFrame]:
    """The same graph under ids that begin with prefix."""
    new = lambda c: F.concat(F.lit(prefix), F.col(c)).alias(c)
    return nodes.withColumn("id", new("id")), links.withColumns({"source": new("source"), "target": new("target")})


def edges(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """links (source, target) with edge id and handles, and the problem of those that cannot be built.

    nodes: id, out_name, out_type, in_name, in_type.
    """
    a = nodes.select(F.col("id").alias("source"), "out_name", "out_type", F.lit(True).alias("has_source"))
    b = nodes.select(F.col("id").alias("target"), "in_name", "in_type", F.lit(True).alias("has_target"))
    joined = links.join(a, "source", "left").join(b, "target", "left")
    empty = lambda c: F.coalesce(F.col(c) == "", F.lit(True))
    problem = F.when(F.col("has_source").isNull(), "no source").when(F.col("has_target").isNull(), "no target").when(empty("out_type") | empty("in_type"), "no type")
    return joined.select("source", "target", F.concat_ws("-", "source", "target").alias("id"), output_handle(F.col("source"), F.col("out_name"), F.col("out_type")).alias("source_handle"), input_handle(F.col("target"), F.col("in_name"), F.col("in_type")).alias("target_handle"), problem.alias("problem"))


def to_json(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """One JSON row per node and per edge, to be written as lines."""
    as_json = lambda df, kind: df.select(F.lit(kind).alias("kind"), F.to_json(F.struct(*df.columns)).alias("json"))
    return as_json(nodes, "node").unionByName(as_json(links, "edge"))
