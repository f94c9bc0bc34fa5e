"""Fixed values of the data model: open ends, ontology, and tables' columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Open ends of valid time. Time is a signed 64-bit number of units since the epoch.
TIME_MIN, TIME_MAX = -(2**63) + 1, 2**63 - 2

PREDICATES = "name string, object_kind string, subject_types string, cardinality string, temporality string, invalidation string, symmetric boolean, inverse_of string, profile boolean, prior double"
#: The predicates of the built-in ontology.
ONTOLOGY = [
    ("employed_by", "entity", "Person", "functional", "interval", "supersede", False, None, True, 1.0),
    ("works_on", "entity", "Person", "multi", "interval", "coexist", False, None, False, 1.0),
    ("born_in", "entity", "Person", "functional", "static", "supersede", False, None, True, 1.0),
    ("full_name", "text", "Person", "functional", "interval", "supersede", False, None, True, 1.0),
    ("died_at", "datetime", "Person", "functional", "static", "explicit_only", False, None, True, 1.0),
    ("knows", "entity", "Person", "multi", "interval", "coexist", True, None, False, 1.0),
    ("member_of", "entity", "Person", "multi", "interval", "coexist", False, None, True, 1.0),
    ("part_of", "entity", "Organization,Project,Artifact", "functional", "static", "supersede", False, None, False, 1.0),
    ("located_in", "entity", "Place,Artifact", "functional", "static", "supersede", False, None, False, 1.0),
    ("has_skill", "entity", "Person", "multi", "interval", "coexist", False, None, True, 1.0),
    ("created_by", "entity", "Artifact,Document", "functional", "static", "supersede", False, "author_of", False, 1.0),
    ("aliases", "text", "Person,Organization,Project,Artifact", "multi", "static", "coexist", False, None, True, 1.0),
    ("allegedly_employed_by", "entity", "Person", "multi", "interval", "coexist", False, None, False, 0.3),
    ("rumored_knows", "entity", "Person", "multi", "interval", "coexist", False, None, False, 0.3),
]

#: The types of entity that the objects of built-in predicates may have.
OBJECT_TYPES = {
    "employed_by": "Organization",
    "works_on": "Project",
    "born_in": "Place",
    "knows": "Person",
    "member_of": "Organization",
    "part_of": "Organization,Project",
    "located_in": "Place",
    "has_skill": "Concept",
    "created_by": "Person",
    "allegedly_employed_by": "Organization",
    "rumored_knows": "Person",
}


def ontology(spark: SparkSession) -> DataFrame:
    """The built-in predicates as a table."""
    return spark.createDataFrame(ONTOLOGY, PREDICATES)
