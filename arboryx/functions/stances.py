"""Stances of claims as coordinates on epistemic axes, and relations named by properties."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Axes in the order of their dimensions with their weights, stances with their coordinates, other names of stances.
AXES = {"veridicality": 2.0, "modality": 1.0, "time": 1.0, "standing": 1.0, "force": 1.0, "attribution": 0.5, "register": 0.5}
PROFILES = {
    "definition": {"veridicality": 1.0, "modality": 1.0, "time": 1.0, "register": 1.0},
    "current_claim": {"veridicality": 1.0, "modality": 1.0, "time": 1.0},
    "historical_claim": {"veridicality": 1.0, "modality": 1.0, "time": -1.0, "attribution": -1.0},
    "refuted_claim": {"veridicality": -1.0, "modality": 1.0, "force": -1.0},
    "hypothesis": {"modality": -1.0, "time": 1.0},
    "observation": {"veridicality": 1.0, "register": -1.0, "attribution": -0.5},
    "direct_quote": {"veridicality": 1.0, "attribution": -1.0, "register": -0.5},
    "disputed": {"veridicality": 1.0, "standing": -1.0},
    "superseded": {"veridicality": 1.0, "time": -1.0, "force": -1.0},
    "neutral": {},
}
ALIASES = {
    "current_claim": "asserted assertion claim fact statement",
    "definition": "definitional",
    "historical_claim": "historical history past_claim",
    "refuted_claim": "refuted refutation negated denial denied",
    "hypothesis": "hypothetical supposition conjecture speculation",
    "observation": "observed report reported",
    "direct_quote": "quote quotation speech",
    "disputed": "contested variant alternative conflicting",
    "superseded": "obsolete replaced overtaken",
    "neutral": "none entity",
}
DEFAULT = "current_claim"


def _literal_map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for x in chain(*pairs.items())])


def stance(x: Column) -> Column:
    """The stance that a word means: lower case, - and spaces as _; what is unknown or null claims least (``DEFAULT``)."""
    known = {s: s for s in PROFILES} | {alias: s for s, names in ALIASES.items() for alias in names.split()}
    key = F.replace(F.replace(F.lower(F.trim(x)), F.lit("-"), F.lit("_")), F.lit(" "), F.lit("_"))
    return F.coalesce(F.try_element_at(_literal_map(known), key), F.lit(DEFAULT))


def axis_profile(stances: Column) -> Column:
    """Mean coordinates of an array of stances, in the order of AXES; an empty array is the default's."""
    told = F.when(F.size(stances) > 0, F.transform(stances, stance)).otherwise(F.array(F.lit(DEFAULT)))
    points = F.create_map(*chain(*[(F.lit(s), F.array(*[F.lit(p.get(a, 0.0)) for a in AXES])) for s, p in PROFILES.items()]))
    zero = F.array(*[F.lit(0.0)] * len(AXES))
    total = F.aggregate(told, zero, lambda sums, s: F.zip_with(sums, F.element_at(points, s), lambda a, b: a + b))
    return F.transform(total, lambda x: x / F.greatest(F.size(stances), F.lit(1)))


def frame_vector(stances: Column, dim: int = 64) -> Column:
    """The unit vector of a profile weighed by axis, with zeros up to ``dim``; a neutral profile stays zero."""
    weighed = F.zip_with(axis_profile(stances), F.array(*[F.lit(w) for w in AXES.values()]), lambda x, w: x * w)
    some = F.slice(weighed, 1, min(dim, len(AXES))) if dim else F.array().cast("array<double>")
    length = F.sqrt(F.aggregate(some, F.lit(0.0), lambda s, x: s + x * x))
    unit = F.transform(some, lambda x: F.when(length > 0, x / length).otherwise(x))
    return F.concat(unit, F.array_repeat(F.lit(0.0), max(0, dim - len(AXES))))


def histogram(claims: DataFrame, by: str, value: str) -> DataFrame:
    """(by, stance, n, place): how often each group's claims take each stance, the most frequent first, then by name."""
    from pyspark.sql import Window

    counts = claims.groupBy(by, stance(F.col(value)).alias("stance")).agg(F.count("*").alias("n"))
    return counts.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("n"), "stance")))


def with_properties(edges: DataFrame, properties: DataFrame, rel: str = "rel") -> DataFrame:
    """``edges`` with ``pid``: the property of their relation by ``properties`` (descriptor, pid), null where there is none.

    Spellings are evened out on both sides ("father of", "Father_Of" and "father-of" are one); of descriptors that
    become one the smallest pid counts. A property that reads the other way round has no place in the table.
    """
    from . import text

    known = properties.groupBy(text.relation_form(F.col("descriptor")).alias("_form")).agg(F.min("pid").alias("pid")).where("_form <> ''")
    return edges.withColumn("_form", text.relation_form(F.col(rel))).join(known, "_form", "left").drop("_form")
