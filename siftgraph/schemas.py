"""Schemas and ranked values that the operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NODE = "struct<element_type:string,name:string,source_file:string,database_id:string>"
EDGES = f"type string, source {NODE}, target {NODE}, evidence string, source_file string, metadata map<string,string>, pos long"
BLOCKS = "category string, owner_type string, owner_name string, source_file string, database_id string, language string, event string, context string, body string, pos long"
ELEMENTS = "element_type string, name string, alias string, source_file string, database_id string, trigger string, selection string, n_columns int, fields array<struct<name:string,type:string,kind:string,hidewhen:string,is_ref:boolean,default_value:string,input_validation:string,input_translation:string,embedded:array<string>>>, subform_refs array<string>, pos long"
CODE_UNITS = "source_file string, element_name string, element_type string, language string, event string, body string, start_line int"

# Severities from the gravest, and handle statuses.
SEVERITIES = ["CRITICAL", "HIGH", "MEDIUM", "LOW"]
STATUSES = ["SAFE", "PROTECTED", "PARTIAL", "CONDITIONAL", "ESCAPE_PATH_GAP", "UNPROTECTED"]


def severity_rank(c: Column) -> Column:
    """0 for the gravest; what is unknown comes last."""
    return F.coalesce(F.element_at(F.create_map(*[x for k, s in enumerate(SEVERITIES) for x in (F.lit(s), F.lit(k))]), c), F.lit(len(SEVERITIES)))


def truthy(c: Column) -> Column:
    """Neither null nor empty: the two count as the same everywhere."""
    return c.isNotNull() & (c != "")


def or_none(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def ratio(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, F.lit(0.0)).otherwise(part / whole)


def clamped(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
