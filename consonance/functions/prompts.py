"""Persona defaults, persona description and the prompt template (column expressions)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# They must equal the reference's for the same prompts.
PERSONA_DEFAULTS = {
    "age": "unknown",
    "sex": "person",
    "city": "an undisclosed city",
    "state": "an undisclosed state",
    "occupation": "an undisclosed occupation",
    "education_level": "an undisclosed education level",
    "persona": "",
    "cultural_background": "",
    "professional_persona": "",
}
PERSONA_DETAILS_TEMPLATE = (
    "I am a %s-year-old %s living in %s, %s.\n"
    "My occupation is %s.\n"
    "My education level is %s.\n"
    "%s\n"
    "%s\n"
    "%s"
)
PROMPT_TEMPLATE = (
    "Here's a bit about me.\n"
    "%s\n\n"
    "I'm interested in learning about the following topic:\n"
    "%s.\n\n"
    "Could you give me five facts about this topic?\n\n"
    "Present your response in this format:\n"
    "Fact 1\n"
    "Fact 2\n"
    "Fact 3\n"
    "Fact 4\n"
    "Fact 5\n\n"
    "Don't include any introduction or conclusion - all I want is the facts."
)
DROPPED_PERSONA_FIELDS = [
    "hobbies_and_interests_list",
    "sports_persona",
    "arts_persona",
    "travel_persona",
    "culinary_persona",
    "skills_and_expertise",
    "skills_and_expertise_list",
    "hobbies_and_interests",
]
# ---------------------------------------------------------------------------


def field_or_default(df: DataFrame, name: str) -> Column:
    """``name`` as text, or its default when NULL or when the column is absent."""
    default = F.lit(PERSONA_DEFAULTS[name])
    if name not in df.columns:
        return default
    return F.coalesce(F.col(name).cast("string"), default)


def persona_details(df: DataFrame) -> Column:
    """The six-line persona description."""
    f = lambda n: field_or_default(df, n)
    return F.format_string(PERSONA_DETAILS_TEMPLATE, f("age"), f("sex"), f("city"), f("state"),
                           f("occupation"), f("education_level"), f("persona"),
                           f("cultural_background"), f("professional_persona"))


def prompt_text(details: Column, topic: Column) -> Column:
    """The full prompt for a persona description and a topic."""
    return F.format_string(PROMPT_TEMPLATE, details, topic)
