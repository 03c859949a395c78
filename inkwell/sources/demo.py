"""A corpus of two invented people to try the engine on, as the JSON lines that a user would bring."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import from_json_strings

FIELDS = ["name", "location", "bio"]
PEOPLE = [
    {"document_id": 1, "name": "Mara Quill", "location": {"city": "Turin", "country": "Italy"}, "bio": ["Mara repairs harbour cranes and tower clocks.", "On Sundays she sails to the lighthouse."]},
    {"document_id": 2, "name": "Odd Ferrant", "bio": "Odd keeps bees behind the old clock works in Bergen"},
]


def documents(spark: SparkSession) -> DataFrame:
    """(document_id, name, location, bio) of the people; who has no location has an empty one."""
    rows = spark.createDataFrame([(json.dumps(p),) for p in PEOPLE], "value string")
    return from_json_strings(rows, "value", FIELDS, F.get_json_object("value", "$.document_id").cast("long"))
