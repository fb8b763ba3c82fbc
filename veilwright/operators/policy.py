"""Which labels are masked: a catalog, a default, and a file or table that overlays it."""

from __future__ import annotations

import json
import os
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilwright.functions.wordlists import LABELS

_GROUPS = {"identity": "TC_No Passport_No SGK_No Person Title", "finance": "IBAN Card_No Tax_No Account_No Money_Amount", "contact": "Email Phone_No Address IP_Address URL", "place": "Location Facility License_Plate"}
CATALOG = "label string, display string, `group` string"


def catalog(spark: SparkSession) -> DataFrame:
    """Every known label with a readable name and a group."""
    group = {x: g for g, names in _GROUPS.items() for x in names.split()}
    return spark.createDataFrame([(x, x.replace("_", " "), group.get(x, "document")) for x in LABELS], CATALOG)


def read(spark: SparkSession, text: str | None) -> DataFrame:
    """``label, enabled`` of a policy file's text: only booleans count, a broken file is an empty overlay."""
    try:
        given = json.loads(text or "{}")
    except ValueError:
        given = {}
    rows = [(k, v) for k, v in given.items() if isinstance(v, bool)] if isinstance(given, dict) else []
    return spark.createDataFrame(rows, "label string, enabled boolean")


def effective(known: DataFrame, overlay: DataFrame) -> DataFrame:
    """All known labels, masked unless the overlay says otherwise."""
    return known.select("label").join(overlay.groupBy("label").agg(F.last("enabled").alias("enabled")), "label", "left").select("label", F.coalesce("enabled", F.lit(True)).alias("enabled"))


def update(current: DataFrame, changes: DataFrame) -> DataFrame:
    """Change known labels; unknown ones are ignored."""
    new = changes.groupBy("label").agg(F.last("enabled").alias("new"))
    return current.join(new, "label", "left").select("label", F.coalesce("new", "enabled").alias("enabled"))


def disabled(policy: DataFrame) -> list[str]:
    """Labels that stay unmasked. The policy has one row per label of the catalog."""
    return sorted(r["label"] for r in policy.where("enabled = false").select("label").collect())


def load(path: str) -> str | None:
    """Text of a policy file, None if there is none."""
    try:
        return Path(path).read_text(encoding="utf-8")
    except OSError:
        return None


def save(policy: DataFrame, path: str) -> None:
    """Write a policy as a JSON object of booleans, labels in order; readers see the old file or the new one."""
    rows = {r["label"]: r["enabled"] for r in policy.select("label", "enabled").collect()}  # one row per label of the catalog
    folder = Path(path).parent
    folder.mkdir(parents=True, exist_ok=True)
    handle, temporary = tempfile.mkstemp(dir=folder, suffix=".json")
    with os.fdopen(handle, "w", encoding="utf-8") as f:
        json.dump(dict(sorted(rows.items())), f, ensure_ascii=False, indent=2)
    os.replace(temporary, path)
