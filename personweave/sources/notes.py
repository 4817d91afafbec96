"""Notes: plain text or lines `Label: text`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import content_hash, dedupe_ci, labelled_block, let, sentences, trim_ws, words
from ..schemas import SKILLS, extracted, record

#: Fixed values.
SOFT_SKILLS = ("communication", "collaboration", "leadership", "ownership", "mentoring", "empathy", "adaptability", "curiosity", "initiative", "problem solving", "stakeholder management", "teamwork")
STOP_WORDS = ("candidate", "interview", "notes", "summary", "strong", "good", "great", "with", "and", "the")
CUES = ("observed", "noted", "mentioned", "prefers", "concern", "strength", "impressed")
MOST_KEYWORDS, MOST_SUMMARY = 20, 280


def _block(text: Column, label: str) -> Column:
    """What stands after the label; null if nothing does."""
    return let(labelled_block(text, label), lambda block: F.when(block != "", block))


def summary(text: Column) -> Column:
    """The labelled summary, else the first sentence, else the first characters."""
    return F.coalesce(_block(text, "summary"), F.get(sentences(text), 0), F.substring(text, 1, MOST_SUMMARY))


def soft_skills(text: Column) -> Column:
    """Listed phrases that occur in the text, capitalised."""
    return let(F.lower(text), lambda low: F.transform(F.filter(F.array(*[F.lit(s) for s in SOFT_SKILLS]), lambda s: F.contains(low, s)), F.initcap))


def keywords(text: Column) -> Column:
    """The labelled list, else the first words that are neither stop words nor soft skills."""
    left = let(F.transform(soft_skills(text), F.lower), lambda soft: F.filter(words(text), lambda w: let(F.lower(w), lambda low: ~low.isin(*STOP_WORDS) & ~F.array_contains(soft, low))))
    free = dedupe_ci(F.transform(left, lambda w: F.btrim(w, F.lit("."))), MOST_KEYWORDS)
    return let(_block(text, "keywords"), lambda label: F.when(label.isNotNull(), dedupe_ci(F.split(label, "[,;|]"))).otherwise(free))


def observations(text: Column) -> Column:
    """The labelled list, else sentences with a cue."""
    cued = F.filter(sentences(text), lambda s: let(F.lower(s), lambda low: F.exists(F.array(*[F.lit(c) for c in CUES]), lambda c: F.contains(low, c))))
    label = F.coalesce(_block(text, "observations"), _block(text, "candidate observations"))
    return let(label, lambda found: F.when(found.isNotNull(), dedupe_ci(F.transform(F.split(found, r"[;\n]"), lambda x: F.btrim(x, F.lit(" -"))))).otherwise(cued))


def read(df: DataFrame, text: str = "text", entity_key: Column | None = None, src_ord: Column | None = None) -> DataFrame:
    """One extracted record for each note that is not blank; its metadata has soft skills, keywords and observations as JSON."""
    kept = df.withColumn("__text", trim_ws(F.col(text))).where("__text <> ''")
    t = F.col("__text")
    source_id = F.concat(F.lit("recruiter_notes:"), content_hash(t, 16))
    skills = F.transform(soft_skills(t), lambda s: record(SKILLS, name=s, category=F.lit("soft_skill"), source_context=F.lit("recruiter notes"), is_inferred=F.lit(False), github_occurrence_count=F.lit(1)))
    found = {"soft_skills": soft_skills(t), "keywords": keywords(t), "candidate_observations": observations(t)}
    metadata = F.create_map(*[x for k, v in found.items() for x in (F.lit(k), F.to_json(v))])
    return extracted(
        kept,
        entity_key=source_id if entity_key is None else entity_key,
        src_ord=F.lit(0) if src_ord is None else src_ord,
        source_type=F.lit("recruiter_notes"),
        source_id=source_id,
        summary=summary(t),
        skills=skills,
        raw_text=t,
        metadata=metadata,
    )
