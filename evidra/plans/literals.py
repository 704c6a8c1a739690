"""Small literal tables that queries share: a vocabulary, project files; and how SQL names them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_VOCABULARY = "id string, label string, reuse string, foundational boolean, triggers array<string>, implies array<string>, narrows array<string>, checklist array<string>, search_terms array<string>, topics array<string>"
# A vocabulary of our own over words of the driver's invented prose.
VOCABULARY = (
    ("greeting", "Opening lines", "high", True, ["the of", "and that"], ["place"], [], ["names the reader", "is short"], ["opening line"], ["greetings"]),
    ("question", "Question", "medium", False, ["is the", "it is"], ["greeting"], ["greeting"], ["has one subject", "ends well"], ["short question", "plain question"], []),
    ("place", "Place", "low", False, ["in the", "on the", "at the"], ["question"], [], ["says where"], ["where it is"], []),
    ("order", "Order", "high", False, ["for the", "to the"], ["place", "question"], ["place"], ["says what first", "says what next", "says what last"], ["in order"], ["order", "sorting"]),
    ("french", "French", "medium", False, ["de la", "les des"], ["order"], [], ["is French"], [], []),
    ("german", "German", "high", False, ["der die", "und nicht"], ["french"], [], ["is German"], ["auf deutsch"], []),
)
IDIOMS = (("greeting", "salutation", 0), ("order", "ordinal", 0), ("order", "sequence", 1))


def vocabulary(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([tuple(r) for r in VOCABULARY], _VOCABULARY)


def idioms(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(IDIOMS), "id string, idiom string, ord int")


def _sql(v) -> str:
    if isinstance(v, (list, tuple)):
        return "[" + ", ".join(map(_sql, v)) + "]::varchar[]"
    return str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else "null" if v is None else "'" + v.replace("'", "''") + "'"


def values(rows, names: str) -> str:
    """A VALUES table of those rows for DuckDB."""
    return "(values " + ", ".join("(" + ", ".join(map(_sql, r)) + ")" for r in rows) + f") as t({names})"


VOCABULARY_SQL = f"vocabulary as (select * from {values(VOCABULARY, 'id, label, reuse, foundational, triggers, implies, narrows, checklist, search_terms, topics')})"
