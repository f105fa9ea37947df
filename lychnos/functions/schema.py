"""The extraction record: field names in template order and its Spark type."""

from __future__ import annotations

from pyspark.sql import types as T

#: The extraction template, in order.
EXTRACTION_FIELDS = (
    "programme_name",
    "description",
    "programme_objective",
    "eligible_parties",
    "eligibility_criteria",
    "property_requirements",
    "minimum_funding_amount",
    "maximum_funding_amount",
    "funding_type",
    "interest_rate",
    "funding_coverage",
    "total_budget",
    "funding_sources",
    "duration",
    "loan_duration",
    "completion_deadline",
    "application_start_date",
    "application_end_date",
    "energy_performance_targets",
    "eligible_interventions",
    "application_process",
    "managing_body",
    "announcement_date",
    "contact_info",
    "additional_details",
)
ARRAY_FIELDS = frozenset({"eligible_parties", "eligibility_criteria", "property_requirements", "funding_sources", "eligible_interventions", "contact_info"})
SCALAR_FIELDS = tuple(f for f in EXTRACTION_FIELDS if f not in ARRAY_FIELDS)


def extraction_schema(fields: tuple[str, ...] = EXTRACTION_FIELDS, arrays: frozenset[str] = ARRAY_FIELDS) -> T.StructType:
    return T.StructType([T.StructField(f, T.ArrayType(T.StringType()) if f in arrays else T.StringType()) for f in fields])
