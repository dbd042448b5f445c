"""A label taxonomy from a YAML or JSON file: read, checked, and as a table."""

from __future__ import annotations

import json
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession

#: The fields that every label must have.
REQUIRED = ("name", "display_name", "definition", "inclusion_criteria", "exclusion_criteria", "auto_handle", "escalation_risk", "examples")
SCHEMA = (
    "ord int, name string, display_name string, definition string, inclusion_criteria array<string>, exclusion_criteria array<string>, auto_handle boolean, "
    "escalation_risk string, examples array<string>, is_fallback boolean"
)


class TaxonomyError(ValueError):
    """A taxonomy file that breaks a rule."""


def check_taxonomy(config: Any) -> dict[str, Any]:
    """``config`` if it holds a list of labels with unique names, all required fields and a definition, and names one of
    them as fallback; otherwise TaxonomyError says what is wrong."""
    labels = config.get("intents") if isinstance(config, dict) else None
    if not isinstance(labels, list) or not labels:
        raise TaxonomyError("'intents' must be a list that is not empty")
    names: set[str] = set()
    for label in labels:
        name = label.get("name") if isinstance(label, dict) else None
        if not name:
            raise TaxonomyError(f"a label has no name: {label}")
        if name in names:
            raise TaxonomyError(f"the name {name!r} is used twice")
        names.add(name)
        missing = [f for f in REQUIRED if f not in label]
        if missing:
            raise TaxonomyError(f"the label {name!r} lacks {', '.join(missing)}")
        if not isinstance(label["definition"], str) or not label["definition"].strip():
            raise TaxonomyError(f"the label {name!r} has no definition")
    fallback = (config.get("metadata") or {}).get("fallback_intent")
    if not fallback:
        raise TaxonomyError("'metadata.fallback_intent' is missing")
    if fallback not in names:
        raise TaxonomyError(f"the fallback {fallback!r} is no label")
    return config


def read_taxonomy(path: str) -> dict[str, Any]:
    """The checked content of a ``.json`` file, or of a YAML file where a YAML reader is installed."""
    text = Path(path).read_text(encoding="utf-8")
    if path.endswith(".json"):
        return check_taxonomy(json.loads(text))
    try:
        import yaml
    except ImportError as e:
        raise TaxonomyError("reading YAML needs the package yaml; give the taxonomy as JSON") from e
    return check_taxonomy(yaml.safe_load(text))


def label_names(config: dict[str, Any]) -> list[str]:
    """The names in the order of the file."""
    return [x["name"] for x in config["intents"]]


def label_by_name(config: dict[str, Any], name: str) -> dict[str, Any]:
    """One label; KeyError if there is none of that name."""
    return {x["name"]: x for x in config["intents"]}[name]


def taxonomy_table(spark: SparkSession, config: dict[str, Any]) -> DataFrame:
    """One row a label in the order of the file; small configuration, ready to be broadcast."""
    texts = lambda v: [str(x) for x in v] if isinstance(v, list) else [str(v)] if v else []
    rows = [
        (i, x["name"], str(x["display_name"]), x["definition"].strip(), texts(x["inclusion_criteria"]), texts(x["exclusion_criteria"]), bool(x["auto_handle"]), str(x["escalation_risk"]),
         texts(x["examples"]), x["name"] == config["metadata"]["fallback_intent"])
        for i, x in enumerate(config["intents"])
    ]
    return spark.createDataFrame(rows, SCHEMA)
