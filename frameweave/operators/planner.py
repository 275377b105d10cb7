"""Query text to a structured plan and hybrid search."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import clamp
from .vectors import knn_exact

MOST_CHARS = 512
# Openings and the phrase of queries for a person's identity.
IDENTITY_OPENINGS = ("who is ", "who's ", "name this person", "identify this person", "identify the person", "find this person", "find the person")
IDENTITY_PHRASE = "person named "
# The phrases that name a filter, the filter with its value, its chip, and whether the words stay in the text.
FACES = (
    (("with 2 faces", "2 faces", "two faces"), ("faces", 2), "Faces: 2"),
    (("with 1 face", "1 face", "one face"), ("faces", 1), "Faces: 1"),
)
PEOPLE = ("two people", "2 people")
DECISIONS = (
    (("kept", "keep"), ("decision", "keep"), "Decision: Keep"),
    (("rejected", "reject"), ("decision", "reject"), "Decision: Reject"),
    (("review",), ("decision", "review"), "Decision: Review"),
)
SHARP = ("sharp",)
BLUR = ("blurry", "blur")
ISSUES = ("technical issue", "technical issues", "quality issue", "quality issues")
# Words that end the name of a camera, and words without meaning for the search.
CAMERA_ENDS = ("with", "sharp", "blurry", "blur", "kept", "rejected", "review")
FILLER = ("photos", "photo", "images", "image", "with", "and")


@dataclass
class Plan:
    """The filters found in a query, the text that is left, and what was recognised, in order."""

    text: str = ""
    faces: int | None = None
    rating: int | None = None
    least_rating: int | None = None
    decision: str | None = None
    sharp: bool = False
    blurry: bool = False
    technical_issue: bool = False
    camera: str | None = None
    blocked: bool = False
    chips: list[str] = field(default_factory=list)

    def predicate(self) -> Column:
        """The plan's filters as one condition; missing evidence fails."""
        out = F.lit(True)
        if self.faces is not None:
            out &= F.col("anonymous_face_count") == self.faces
        if self.rating is not None:
            out &= F.col("rating") == self.rating
        if self.least_rating is not None:
            out &= F.col("rating") >= self.least_rating
        if self.decision is not None:
            out &= F.col("decision") == self.decision
        if self.sharp:
            out &= F.col("technical_score") >= 0.62
        if self.blurry:
            out &= F.col("technical_score") < 0.20
        if self.technical_issue:
            out &= F.col("technical_score") < 0.30
        if self.camera is not None:
            out &= F.lower("camera_model") == self.camera.lower()
        return F.coalesce(out, F.lit(False))


class _Residual:
    """Query text between blanks, of which whole words are looked up and taken away."""

    def __init__(self, words: str) -> None:
        self.text = f" {words} "

    def has(self, *phrases: str) -> bool:
        return any(f" {p} " in self.text for p in phrases)

    def drop(self, *phrases: str) -> None:
        for p in phrases:
            self.text = self.text.replace(f" {p} ", " ")


def plan_query(text: str) -> Plan:
    """Extract faces, people, stars, decision, sharpness, blur, issue and camera, in this order.

    Empty and over-long queries are refused; a query for an identity (P19) is
    blocked and has no filters.  Words for people and the name of a camera stay in
    the text: they also describe a scene.  Camera names are upper case.
    """
    t = " ".join(text.split())
    if not t or len(t) > MOST_CHARS:
        raise ValueError("a query has 1 to 512 characters")
    low = t.lower()
    if low.startswith(IDENTITY_OPENINGS) or IDENTITY_PHRASE in low:
        return Plan(blocked=True, chips=["Identity search unavailable"])
    p, rest = Plan(), _Residual(low)

    def found(name: str, value: object, chip: str, *phrases: str) -> None:
        setattr(p, name, value)
        p.chips.append(chip)
        rest.drop(*phrases)

    for phrases, (name, value), chip in FACES:
        if rest.has(*phrases):
            found(name, value, chip, *phrases)
    if p.faces is None and rest.has(*PEOPLE):
        found("faces", 2, "Faces: 2")
    stars = {suffix: next((n for n in range(1, 6) if rest.has(f"{n}{suffix} star", f"{n}{suffix} stars")), None) for suffix in ("", "+")}
    if (n := stars[""]) is not None:
        found("rating", n, f"Rating: {n}\u2605", f"{n} star", f"{n} stars")
    elif (n := stars["+"]) is not None:
        found("least_rating", n, f"Rating: {n}\u2605+", f"{n}+ star", f"{n}+ stars")
    for phrases, (name, value), chip in DECISIONS:
        if rest.has(*phrases):
            found(name, value, chip, *phrases)
            break
    if rest.has(*SHARP):
        found("sharp", True, "Sharpness: sharp", *SHARP)
    if rest.has(*BLUR):
        found("blurry", True, "Blur: review", *BLUR)
    issue = next((i for i in ISSUES if rest.has(i)), None)
    if issue:
        found("technical_issue", True, "Technical quality: issue", issue)
    _, named, behind = rest.text.partition(" camera ")
    if named:
        ends = [at for e in CAMERA_ENDS if (at := behind.find(f" {e} ")) >= 0]
        camera = behind[: min(ends, default=len(behind))].strip().upper()
        if camera:
            found("camera", camera, f"Camera: {camera}", f"camera {camera}")
    rest.drop(*FILLER)
    p.text = " ".join(rest.text.split())
    return p


# O3: the search's sorts as columns of the metadata; relevance is the score itself.
SORTS = {"relevance": "score", "captureTime": "captured_at_unix_ms", "technicalQuality": "technical_score", "rating": "rating"}


def sorted_results(results: DataFrame, metadata: DataFrame, sort: str = "relevance", id_column: str = "asset_id") -> DataFrame:
    """O3: search results (at most a page) by relevance, capture time, technical quality or rating.

    Capture times ascend, the others descend; missing values come last, ties by
    score and then by id.  An unknown sort is an error.
    """
    column = SORTS[sort]
    if sort == "relevance":
        return results.orderBy(F.desc("score"), id_column)
    known = results.join(metadata.select(id_column, column), id_column, "left")
    first = F.col(column).asc_nulls_last() if sort == "captureTime" else F.col(column).desc_nulls_last()
    return known.orderBy(first, F.desc("score"), id_column)


def hybrid_search(vectors: DataFrame, metadata: DataFrame, plan: Plan, query: list[float] | None, k: int = 10, id_column: str = "asset_id", vector: str = "vector_values") -> DataFrame:
    """The plan's filters first, then the k nearest; without a vector the best rated.

    A blocked plan has no rows.
    """
    if plan.blocked:
        return metadata.select(id_column, F.lit(0.0).alias("score")).limit(0)
    kept = metadata.where(plan.predicate())
    if query is None:
        return kept.select(id_column, clamp(F.coalesce(F.col("technical_score").cast("double"), F.lit(0.0))).alias("score")).orderBy(F.desc("score"), id_column).limit(k)
    return knn_exact(vectors.join(kept.select(id_column).distinct(), id_column, "left_semi"), query, k, None, id_column, vector)
