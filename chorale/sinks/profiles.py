"""Curation profiles: a selection with its ids and representatives, saved as one unit and refused if it isn't what was saved."""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession

from ..operators import dataset as D
from .publish import PublishError, Run, read_run


def save_profile(run: Run, selection: D.Selection, items: DataFrame, item: str, representatives: DataFrame | None = None) -> str:
    """Publish a profile under the run's name; its fingerprint."""
    representatives = representatives if representatives is not None else items.where("false")
    fingerprint = D.selection_fingerprint(selection, items, item, representatives).first()["fingerprint"]
    head = items.sparkSession.createDataFrame([(json.dumps(asdict(selection)), fingerprint)], "selection string, fingerprint string")
    run.publish({"selection": head, "items": D.folded_ids(items, item), "representatives": D.folded_ids(representatives, item)})
    return fingerprint


def load_profile(spark: SparkSession, root: str, run_id: str | None = None) -> tuple[D.Selection, DataFrame, DataFrame, str]:
    """(selection, ids, representatives, fingerprint) of a saved profile, by default the latest; its files are verified and its
    fingerprint is computed again."""
    head, items, representatives = (read_run(spark, root, name, run_id, verify=True) for name in ("selection", "items", "representatives"))
    told = head.first()
    fields = json.loads(told["selection"])
    selection = D.Selection(**fields | {"excluded_flags": tuple(fields["excluded_flags"])})
    if D.selection_fingerprint(selection, items, "id", representatives).first()["fingerprint"] != told["fingerprint"]:
        raise PublishError("profile-invalid")
    return selection, items, representatives, told["fingerprint"]


def profile_fits(selection: D.Selection, items: DataFrame, manifest_sha256: str, manifest_items: DataFrame, item: str = "item_id") -> DataFrame:
    """(item, code) of a profile over a manifest: another manifest's, or ids that the manifest does not have."""
    spark = items.sparkSession
    other = [("manifest", "profile-manifest-mismatch")] if selection.manifest_sha256.lower() != manifest_sha256.lower() else []
    unknown = items.join(D.folded_ids(manifest_items, item), "id", "left_anti").selectExpr("id AS item", "'profile-item-unknown' AS code")
    return spark.createDataFrame(other, "item string, code string").unionByName(unknown)
