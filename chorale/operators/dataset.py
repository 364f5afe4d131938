"""Building a dataset from curated items, and testing whether one that is there can be used again."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import identity as I
from .manifest import PORTABLE, totals
from .order import ordered_digest
from .verification import path_key

#: Fields of a build that must be the same for it to be used again; hashes fold case (fixed values).
EXACT, FOLDED = ("selection_fingerprint", "semantic_profile_hash", "link_mode", "build_fingerprint", "audio_profile_fingerprint"), ("source_manifest_sha256", "profile_sha256", "manifest_sha256", "csv_sha256")


#: Fields of a selection in the order of its fingerprint (fixed values); lists come last, with their counts.
SELECTION = ("version", "manifest", "profile", "minimum-duration", "maximum-duration", "minimum-bytes", "maximum-bytes", "include-unknown-duration", "incoming-only")
SELECTION_VERSION = "dataset-selection-digest-v1"


@dataclass(frozen=True)
class Selection:
    """What a selection was made by: the manifest and the profile, bounds, and quality flags that exclude."""

    manifest_sha256: str
    profile_version: str
    least_ms: int | None = None
    most_ms: int | None = None
    least_bytes: int | None = None
    most_bytes: int | None = None
    unknown_duration: bool = False
    incoming_only: bool = False
    excluded_flags: tuple[str, ...] = ()

    def __post_init__(self):
        if not self.manifest_sha256.strip() or not self.profile_version.strip():
            raise ValueError("a selection names its manifest and its profile")

    def fields(self) -> list[tuple[str, str]]:
        bound = lambda x: "" if x is None else str(x)
        values = (SELECTION_VERSION, self.manifest_sha256.lower(), self.profile_version, *map(bound, (self.least_ms, self.most_ms, self.least_bytes, self.most_bytes)), str(int(self.unknown_duration)), str(int(self.incoming_only)))
        flags = [("excluded-quality-flags.count", str(len(self.excluded_flags))), *(("excluded-quality-flags.item", f) for f in self.excluded_flags)]
        return [*zip(SELECTION, values), *flags]


def _field(name: Column, value: Column) -> Column:
    """A field's line: each of its parts after its length, so that no two lists of fields look alike."""
    return F.concat(F.length(name).cast("string"), F.lit(":"), name, F.length(value).cast("string"), F.lit(":"), value, F.lit("\n"))


def folded_ids(items: DataFrame, item: str) -> DataFrame:
    """``id``: the different ids, trimmed and folded; blank ones are left out."""
    return items.select(F.lower(F.trim(item)).alias("id")).where(I.not_blank(F.col("id"))).distinct()


def selection_fingerprint(selection: Selection, items: DataFrame, item: str, representatives: DataFrame | None = None) -> DataFrame:
    """One row: ``fingerprint`` of a selection and its number of lines ``n``. The lines are the selection's fields and flags,
    the selected ids in order, and the ids that represent their duplicates, each list with its count before it."""
    spark = items.sparkSession
    head = spark.createDataFrame([(0, f"{i:09}", name, value) for i, (name, value) in enumerate(selection.fields())], "section int, place string, name string, value string")
    lists = [(2, "selected-items", folded_ids(items, item)), (4, "duplicate-representatives", folded_ids(representatives if representatives is not None else items.where("false"), item))]
    rows = [head]
    for section, name, ids in lists:
        rows.append(ids.agg(F.count("*").cast("string").alias("value")).select(F.lit(section - 1).alias("section"), F.lit("").alias("place"), F.lit(f"{name}.count").alias("name"), "value"))
        rows.append(ids.select(F.lit(section).alias("section"), F.col("id").alias("place"), F.lit(f"{name}.item").alias("name"), F.col("id").alias("value")))
    lines = reduce(DataFrame.unionByName, rows)
    return ordered_digest(lines, [], [F.col("section"), F.col("place")], _field(F.col("name"), F.col("value")))


def build_items(items: DataFrame, selected: Column, flags: Column) -> DataFrame:
    """The portable rows of the selected items with their merged flags; the order of files is that of the ids."""
    rows = items.where(selected).withColumns({"quality_flags": F.array_join(flags, "|"), "selected": F.lit("True")})
    return rows.select(*PORTABLE)


def build_summary(rows: DataFrame) -> DataFrame:
    """One row: items, durations and bytes of a build."""
    return totals(rows, F.col("duration_ms"), F.col("byte_length"), F.lit(True)).select("items", "total_duration", "total_bytes")


def field_issues(wanted: DataFrame, found: DataFrame, exact: tuple[str, ...] = EXACT, folded: tuple[str, ...] = FOLDED) -> DataFrame:
    """(item, code) of the fields in which two one-row frames differ; a field that is not wanted (null) is not compared."""
    left, right = (df.select(*[F.col(c).cast("string").alias(f"{p}{c}") for c in (*exact, *folded)]) for df, p in ((wanted, "w_"), (found, "f_")))
    both = left.crossJoin(F.broadcast(right))  # one row each
    fold = lambda c, name: F.lower(c) if name in folded else c
    differs = [F.when(F.col(f"w_{c}").isNotNull() & ~fold(F.col(f"w_{c}"), c).eqNullSafe(fold(F.col(f"f_{c}"), c)), c) for c in (*exact, *folded)]
    return both.select(F.explode(F.array_compact(F.array(*differs))).alias("item"), F.lit("field-differs").alias("code"))


def item_issues(build: DataFrame, manifest: DataFrame, selected: DataFrame, audio: DataFrame) -> DataFrame:
    """(item, code) that keep a dataset from being used again: items not selected, or unlike between the build and the manifest,
    audio that is not there, differs, or that nobody expects.

    ``build`` and ``manifest``: item_id, relative_audio_path, sha256, byte_length, duration_ms, and the manifest perhaps selected,
    which must be true then; ``selected``: item_id; ``audio``: path, sha256, bytes.
    """
    if "selected" in manifest.columns:
        flags = manifest.select(F.lower("item_id").alias("item"), F.lower(F.col("selected").cast("string")).alias("flag"))
        unselected = flags.where(~F.col("flag").eqNullSafe(F.lit("true"))).select("item", F.lit("item-unselected").alias("code"))
    else:
        unselected = None
    keyed = lambda df, p: df.select(F.lower("item_id").alias("item"), F.lit(True).alias(f"{p}in"), *[F.col(c).alias(f"{p}{c}") for c in ("relative_audio_path", "sha256", "byte_length", "duration_ms")])
    chosen = selected.select(F.lower("item_id").alias("item")).distinct().withColumn("chosen", F.lit(True))
    both = keyed(build, "b_").join(keyed(manifest, "m_"), "item", "full_outer").join(chosen, "item", "left")
    same = F.col("b_relative_audio_path").eqNullSafe(F.col("m_relative_audio_path")) & F.lower("b_sha256").eqNullSafe(F.lower("m_sha256"))
    same = same & F.col("b_byte_length").eqNullSafe(F.col("m_byte_length")) & F.col("b_duration_ms").eqNullSafe(F.col("m_duration_ms"))
    code = F.when(F.col("m_in").isNull(), "item-missing").when(F.col("chosen").isNull(), "item-not-selected").when(F.col("b_in").isNull(), "item-unknown").when(~same, "item-differs")
    items = both.select("item", code.alias("code")).where(F.col("code").isNotNull())

    there = audio.select(path_key(F.col("path")).alias("_path"), F.lower("sha256").alias("_sha"), F.col("bytes").alias("_bytes"), F.lit(True).alias("_there"))
    own = build.select(F.lower("item_id").alias("item"), path_key(F.col("relative_audio_path")).alias("_path"), F.lower("sha256").alias("sha"), "byte_length")
    joined = own.join(there, "_path", "left")
    wrong = F.when(F.col("_there").isNull(), "audio-missing").when(~(F.col("sha").eqNullSafe(F.col("_sha")) & F.col("byte_length").eqNullSafe(F.col("_bytes"))), "audio-differs")
    sound = joined.select("item", wrong.alias("code")).where(F.col("code").isNotNull())
    extra = there.join(own, "_path", "left_anti").select(F.col("_path").alias("item"), F.lit("audio-unexpected").alias("code"))
    return reduce(DataFrame.unionByName, (items, sound, extra) + ((unselected,) if unselected is not None else ()))


def order_issues(wanted: DataFrame, found: DataFrame, item: str, place: str) -> DataFrame:
    """(item, code) of two selections' ids, folding case, that are not the same sequence: places in which they differ."""
    left, right = (df.select(F.lower(item).alias(name), F.col(place).alias("place")) for df, name in ((wanted, "w"), (found, "f")))
    both = left.join(right, "place", "full_outer").where(~F.col("w").eqNullSafe(F.col("f")))
    return both.select(F.coalesce("w", "f").alias("item"), F.lit("selection-differs").alias("code"))


def reusable(issues: DataFrame) -> DataFrame:
    """One row: a dataset can be used again if there is no issue."""
    return issues.agg(F.count("*").alias("issues"), (F.count("*") == 0).alias("reusable"))
