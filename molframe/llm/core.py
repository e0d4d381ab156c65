"""Shared pieces of the operators: inputs, registration, stored tables."""

from __future__ import annotations

import importlib
import pkgutil

from pyspark.sql import Column, DataFrame, functions as F

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

#: Fixed values of the word rules: white space as the contracts define it.
SPACE = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def query(name: str, sql: str | None = None):
    """Register an ``opN_<name>`` query; ``sql`` is its oracle where SQL can say it."""
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def load_queries() -> None:
    """Import every module of the subpackage, so that its queries are registered."""
    package = importlib.import_module("molframe.llm")
    for m in pkgutil.iter_modules(package.__path__):
        importlib.import_module(f"molframe.llm.{m.name}")


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text with null texts as empty; every other column is left behind."""
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z; other letters stay as they are."""
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """Words between white space, as an array (empty for empty texts)."""
    bare = F.btrim(text, F.lit(SPACE))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(
        F.split(bare, "[\\x20\\x09-\\x0D]+"))
