"""What a vision model answered: parsed strictly, field by field, with a reason for every rejected row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions.text import sanitize, strip_fence

CONFIDENCES = ["high", "medium", "low"]


def parse(rows: DataFrame, text: str = "text") -> DataFrame:
    """rows with is_relevant, category, brand, model_hint, description, confidence, and problem (null if the answer is sound)."""
    body = strip_fence(F.col(text))
    whole = F.try_parse_json(body)
    kind = F.schema_of_variant(whole)

    def string(name: str) -> Column:
        is_text = F.schema_of_variant(F.try_variant_get(whole, f"$.{name}", "variant")) == "STRING"
        return F.when(is_text, sanitize(F.try_variant_get(whole, f"$.{name}", "string")))

    relevant = F.when(F.schema_of_variant(F.try_variant_get(whole, "$.is_relevant", "variant")) == "BOOLEAN", F.try_variant_get(whole, "$.is_relevant", "boolean"))
    description = F.coalesce(string("description_ru"), F.lit(""))
    confidence = F.try_variant_get(whole, "$.confidence", "string")
    problem = (
        F.when(F.coalesce(F.col(text), F.lit("")) == "", "empty").when(whole.isNull(), "not JSON").when(~F.startswith(kind, F.lit("OBJECT")), "not an object")
        .when(relevant.isNull(), "no is_relevant").when(relevant & (description == ""), "no description")
    )
    return rows.withColumns({"problem": problem, "is_relevant": relevant, "category": string("category"), "brand": string("brand"), "model_hint": string("model_hint"), "description": description, "confidence": F.when(confidence.isin(CONFIDENCES), confidence).otherwise("low")})
