"""The closed domains: entity types, and relationship types with their ends and verbs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The ontology's entity types, relationship types with source and target, and the verbs of statements.
ENTITY_TYPES = ("Company", "Product", "BusinessSegment", "RegulatoryBody", "Person")
RELATIONSHIPS = (
    ("COMPETES_WITH", "Company", "Company", "competes with"),
    ("ACQUIRED", "Company", "Company", "acquired"),
    ("SUBSIDIARY_OF", "Company", "Company", "is a subsidiary of"),
    ("SUPPLIES", "Company", "Company", "supplies"),
    ("CUSTOMER_OF", "Company", "Company", "is a customer of"),
    ("PARTNERS_WITH", "Company", "Company", "partners with"),
    ("DEPENDS_ON", "Company", "Company", "depends on"),
    ("REGULATED_BY", "Company", "RegulatoryBody", "is regulated by"),
    ("OFFERS_PRODUCT", "Company", "Product", "offers the product"),
    ("PART_OF_SEGMENT", "Product", "BusinessSegment", "is part of the segment"),
    ("HAS_SEGMENT", "Company", "BusinessSegment", "has the business segment"),
    ("OFFICER_OF", "Person", "Company", "is an officer of"),
)


@dataclass(frozen=True)
class Ontology:
    entity_types: tuple[str, ...] = ENTITY_TYPES
    relationships: tuple[tuple[str, str, str, str], ...] = RELATIONSHIPS

    @classmethod
    def load(cls, path: str) -> "Ontology":
        """From a YAML file that says ``status: DEFINED``."""
        import yaml

        with open(path, encoding="utf-8") as f:
            spec = yaml.safe_load(f) or {}
        if spec.get("status") != "DEFINED":
            raise ValueError(f"the ontology in {path} is not DEFINED")
        verbs = {r[0]: r[3] for r in RELATIONSHIPS}
        return cls(
            tuple(e["name"] for e in spec["entity_types"]),
            tuple((r["name"], r["source"], r["target"], verbs.get(r["name"], r["name"].lower())) for r in spec["relationship_types"]),
        )

    @property
    def relationship_types(self) -> tuple[str, ...]:
        return tuple(r[0] for r in self.relationships)

    def check_type(self, name: str | None) -> str:
        """The name itself if the ontology has it: what is not listed never reaches a plan."""
        if name not in self.relationship_types:
            raise ValueError(f"no relationship type {name!r}")
        return name

    def verb(self, rel_type: Column) -> Column:
        """The verb of a relationship type; an unknown type is its own name in lower case."""
        pairs = [F.lit(x) for r in self.relationships for x in (r[0], r[3])]
        return F.coalesce(F.try_element_at(F.create_map(*pairs), rel_type), F.lower(rel_type))

    def prompt_block(self) -> str:
        """What an extractor is told of the domains."""
        lines = ["Entity types: " + ", ".join(self.entity_types), "Relationship types:"]
        return "\n".join(lines + [f"- {r[0]}: {r[1]} -> {r[2]}" for r in self.relationships])

    def json_schema(self) -> dict:
        """The form an extractor's output must have."""
        number = {"type": "number"}
        word = {"type": "string"}

        def rows(fields: dict) -> dict:
            return {"type": "array", "items": {"type": "object", "properties": fields, "required": list(fields), "additionalProperties": False}}

        parts = {
            "entities": rows({"entity_type": {"type": "string", "enum": list(self.entity_types)}, "raw_name": word, "confidence": number}),
            "relationships": rows({"relationship_type": {"type": "string", "enum": list(self.relationship_types)}, "source_entity": word, "target_entity": word, "confidence": number}),
        }
        return {"type": "object", "properties": parts, "required": list(parts), "additionalProperties": False}

    def frame(self, spark: SparkSession) -> DataFrame:
        """The relationship types as a small table."""
        return spark.createDataFrame(list(self.relationships), "relationship_type string, source_type string, target_type string, verb string")

    def outside(self, claims: DataFrame) -> DataFrame:
        """Claims whose type the ontology does not have."""
        return claims.filter(~F.col("relationship_type").isin(*self.relationship_types))

    def off_range(self, claims: DataFrame) -> DataFrame:
        """Strict mode: claims whose ends (source_type, target_type) are of other types than the ontology says."""
        ends = F.broadcast(self.frame(claims.sparkSession).select("relationship_type", F.col("source_type").alias("_s"), F.col("target_type").alias("_t")))
        return claims.join(ends, "relationship_type").filter((F.col("source_type") != F.col("_s")) | (F.col("target_type") != F.col("_t"))).drop("_s", "_t")
