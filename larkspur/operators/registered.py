"""Operators under names: SQL functions that a session can be given, tools that name them, and variables that queries read.

Scalar functions are SQL functions, which the optimizer puts in the place of their calls; splitters are table functions for ``LATERAL`` joins. A stored tool
names one of them by its name; source text that comes with a tool is never run.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from larkspur.functions.cost import CHARS_PER_TOKEN
from larkspur.operators.chunks import OVERLAP, SIZE, sentence_spans, split_text


class SplitRecursive:
    """split_recursive(text, size, overlap): the rows of recursive_chunks() for one text."""

    @staticmethod
    def analyze(text: AnalyzeArgument, size: AnalyzeArgument | None = None, overlap: AnalyzeArgument | None = None) -> AnalyzeResult:
        return _analyzed(text, size, overlap, StructType().add("chunk_no", IntegerType()).add("chunk", StringType()))

    def eval(self, text: str | None, size: int = SIZE, overlap: int = OVERLAP) -> Iterator[tuple]:
        yield from enumerate(split_text(text, size, overlap), 1) if text else ()


class SplitSentences:
    """split_sentences(text, size, overlap): the rows of sentence_chunks() for one text."""

    @staticmethod
    def analyze(text: AnalyzeArgument, size: AnalyzeArgument | None = None, overlap: AnalyzeArgument | None = None) -> AnalyzeResult:
        return _analyzed(text, size, overlap, StructType().add("chunk_no", IntegerType()).add("start", IntegerType()).add("chunk", StringType()))

    def eval(self, text: str | None, size: int = 500, overlap: int = 50) -> Iterator[tuple]:
        if text:
            yield from ((n, a, text[a:b]) for n, (a, b) in enumerate(sentence_spans(text, size * CHARS_PER_TOKEN, overlap * CHARS_PER_TOKEN), 1))


def _analyzed(text: AnalyzeArgument, size: AnalyzeArgument | None, overlap: AnalyzeArgument | None, schema: StructType) -> AnalyzeResult:
    if not isinstance(text.dataType, StringType):
        raise ValueError("the text to split is a string")
    for name, given in (("size", size), ("overlap", overlap)):
        if given is not None and (not given.isConstantExpression or given.value is None or given.value < (name == "size")):
            raise ValueError(f"{name} is a constant number, and a size is at least 1")
    if size is not None and overlap is not None and overlap.value >= size.value:
        raise ValueError("an overlap is shorter than its window")
    return AnalyzeResult(schema=schema)


def _scalar(signature: str, body: str) -> Callable[[SparkSession, str], None]:
    return lambda spark, name: spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{signature} RETURN {body}") and None


def _table(kind: type) -> Callable[[SparkSession, str], None]:
    return lambda spark, name: spark.udtf.register(name, F.udtf(kind)) and None


#: What can be registered, by name.
OPERATORS: dict[str, Callable[[SparkSession, str], None]] = {
    "approx_tokens": _scalar("(content STRING) RETURNS BIGINT", f"CAST(ceil(length(content) / {CHARS_PER_TOKEN}) AS BIGINT)"),
    "mask_value": _scalar("(content STRING) RETURNS STRING", "right(content, 4)"),
    "utc_day": _scalar("(at TIMESTAMP) RETURNS STRING", "date_format(at, 'yyyyMMdd')"),
    "split_recursive": _table(SplitRecursive),
    "split_sentences": _table(SplitSentences),
}

_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]{0,63}")


def register(spark: SparkSession, names: list[str] | None = None, prefix: str = "") -> list[str]:
    """Give the session these operators (all, if no names are given) as SQL functions; their names there."""
    wanted = list(OPERATORS) if names is None else names
    unknown = [n for n in wanted if n not in OPERATORS]
    if unknown:
        raise LookupError(f"no operator {', '.join(unknown)}")
    for n in wanted:
        OPERATORS[n](spark, _checked(prefix + n))
    return [prefix + n for n in wanted]


def _checked(name: str) -> str:
    if not _NAME.fullmatch(name):
        raise ValueError(f"not a name: {name!r}")
    return name


def tool_problem(name: Column, func: Column) -> Column:
    """Why a stored tool cannot be offered, or null: its name must be one, and what it runs the name of an operator, never source text."""
    return F.when(~F.coalesce(name.rlike(f"^{_NAME.pattern}$"), F.lit(False)), "name").when(~F.coalesce(func.isin(list(OPERATORS)), F.lit(False)), "no such operator")


def register_tools(spark: SparkSession, tools: DataFrame) -> list[str]:
    """Register the sound ones of tools (name, func), a list that is read as a whole; their names."""
    sound = tools.filter(tool_problem(F.col("name"), F.col("func")).isNull()).select("name", "func").orderBy("name").collect()
    for t in sound:
        OPERATORS[t["func"]](spark, _checked(t["name"]))
    return [t["name"] for t in sound]


#: Types that a variable may have.
TYPES = ("STRING", "BIGINT", "DOUBLE", "BOOLEAN")


def set_variable(spark: SparkSession, name: str, value: str | None, kind: str = "STRING") -> None:
    """Declare a session variable and set it; values go in as parameters, never as text of the statement."""
    if kind not in TYPES:
        raise ValueError(f"not a type: {kind!r}")
    spark.sql(f"DECLARE OR REPLACE VARIABLE {_checked(name)} {kind}")
    spark.sql(f"SET VAR {name} = CAST(:value AS {kind})", args={"value": value})


def set_variables(spark: SparkSession, variables: DataFrame, runtime: dict[str, str] | None = None) -> list[str]:
    """Set session variables of rows (name, type: static or runtime, value), a short list. A runtime variable takes its value from runtime, null if it is not there."""
    rows = variables.select("name", "type", "value").orderBy("name").collect()
    for r in rows:
        set_variable(spark, r["name"], (runtime or {}).get(r["name"]) if r["type"] == "runtime" else r["value"])
    return [r["name"] for r in rows]


def with_variables(spark: SparkSession, statement: str, *names: str) -> DataFrame:
    """The rows of a statement whose question marks stand for these variables, with the values that they have now."""
    return spark.sql(f"EXECUTE IMMEDIATE '{_quoted(statement)}' USING {', '.join(_checked(n) for n in names)}")


def _quoted(statement: str) -> str:
    return statement.replace("\\", "\\\\").replace("'", "\\'")
