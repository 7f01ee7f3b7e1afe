"""The rule catalogue: a small file read on the driver and validated as a whole."""

import json

from pyspark.sql import DataFrame, SparkSession

from pagewarden import lexicon, schemas


class CatalogueError(ValueError):
    """The catalogue was rejected; nothing of it is used."""


def default_rules() -> list:
    return [dict(zip(lexicon.RULE_FIELDS, row)) for row in lexicon.RULES]


def load_rules(path: str) -> list:
    """Rules of a JSON or YAML file with a top-level ``rules`` list."""
    with open(path, encoding="utf-8") as source:
        if path.endswith((".yaml", ".yml")):
            try:
                import yaml
            except ImportError as exc:
                raise CatalogueError("YAML catalogues need PyYAML") from exc
            content = yaml.safe_load(source)
        else:
            content = json.load(source)
    if not isinstance(content, dict) or not isinstance(content.get("rules"), list):
        raise CatalogueError("a catalogue is an object with a list of rules")
    return validated(content["rules"])


def validated(rules: list) -> list:
    """All seven fields are required strings; one bad rule rejects the load."""
    for number, rule in enumerate(rules, 1):
        if not isinstance(rule, dict):
            raise CatalogueError(f"rule {number} is not an object")
        for field in lexicon.RULE_FIELDS:
            if not isinstance(rule.get(field), str):
                raise CatalogueError(f"rule {number}: field {field} is missing or no string")
    return [{f: rule[f] for f in lexicon.RULE_FIELDS} for rule in rules]


def rules_frame(spark: SparkSession, rules: list = None) -> DataFrame:
    rows = validated(default_rules() if rules is None else rules)
    return spark.createDataFrame(
        [tuple(r[f] for f in lexicon.RULE_FIELDS) for r in rows], schemas.RULE
    )
