"""Queries of the general training-data operators: common units and instants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.instants import InstantDictionary, normalise_times
from ..operators.units import hidden_units, to_common_unit, typed_sums, unit_changes
from ..session import table
from .general_sql import P3, P7

TIME_FIELDS = ["event_time", "created_at", "modified_at", "uploaded_at"]


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    sums = to_common_unit(table(spark, folder, "audit_records"))
    return sums.where("value_fen > 0").select("record_id", "field_name", "value_fen").distinct()


def p3_unit_changes(spark: SparkSession, folder: str) -> DataFrame:
    return unit_changes(typed_sums(table(spark, folder, "audit_records")))


def p3_hidden_units(spark: SparkSession, folder: str) -> DataFrame:
    return hidden_units(table(spark, folder, "audit_records"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    records, sources = table(spark, folder, "audit_records"), table(spark, folder, "source_systems")
    dictionary = InstantDictionary(spark.conf.get("clueforge.instants.path", None))
    found = normalise_times(records, sources, TIME_FIELDS, dictionary=dictionary)
    return found.where(F.col("utc_us").isNotNull()).select("record_id", "field_name", "utc_us").distinct()


QUERIES = {"p3_found": p3_found, "p3_unit_changes": p3_unit_changes, "p3_hidden_units": p3_hidden_units, "p7_found": p7_found}
ORACLE = {"p3_found": P3, "p7_found": P7}
