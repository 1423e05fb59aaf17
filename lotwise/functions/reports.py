"""Reports stored as JSON in the schema of their day, read into one: variants whose paths depend on the version."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What each field is called in each version, and its type; a version that lacks a field has none.
PATHS = {
    1: {"artist": "$.artist", "title": "$.title", "low": "$.price.low", "high": "$.price.high", "currency": "$.price.currency"},
    2: {"artist": "$.attribution.artist.name", "hand": "$.attribution.hand", "title": "$.work.title", "low": "$.estimate[0]", "high": "$.estimate[1]", "currency": "$.currency"},
}
TYPES = {"artist": "string", "hand": "string", "title": "string", "low": "double", "high": "double", "currency": "string"}
#: Comparables were bare prices in version 1 and have their tier since.
COMPS = {1: ("$.comparables", "array<double>"), 2: ("$.comps", "array<struct<price: double, tier: int>>")}


def read(text: Column) -> Column:
    """A struct of ``version``, the fields of :data:`TYPES`, ``comps`` (price, tier) and ``unread``: why nothing was read, if so.

    The version stands under ``schema.version`` or, in the oldest, nowhere.  A value of another type than its field's is
    null; text that isn't JSON, and versions that aren't known, leave all fields null.
    """
    v = F.try_parse_json(text)
    at = lambda path, kind: F.try_variant_get(v, path, kind)
    version = F.when(v.isNotNull(), F.coalesce(at("$.schema.version", "int"), F.lit(1)))

    def by_version(name: str) -> Column:
        out = F.lit(None).cast(TYPES[name])
        for number, paths in PATHS.items():
            if name in paths:
                out = F.when(version == number, at(paths[name], TYPES[name])).otherwise(out)
        return out

    comp = "array<struct<price: double, tier: int>>"
    old = F.transform(at(*COMPS[1]), lambda p: F.struct(p.alias("price"), F.lit(None).cast("int").alias("tier"))).cast(comp)
    comps = F.when(version == 1, old).when(version == 2, at(*COMPS[2]))
    unread = F.when(text.isNull(), "no report").when(v.isNull(), "not JSON").when(~version.isin(*PATHS), F.concat(F.lit("version "), version.cast("string")))
    return F.struct(version.alias("version"), *(by_version(n).alias(n) for n in TYPES), comps.alias("comps"), unread.alias("unread"))
