"""Policy text analysis: which required elements does a text mention?"""

from pyspark.sql import DataFrame, functions as F

from pagewarden import lexicon
from pagewarden.functions import text as tx


def _struct(fields) -> str:
    return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in fields) + ")"


def element_flags(lower_text: str, language: str) -> str:
    """Struct of ten booleans; dictionaries follow the language of the text.

    ``pt*`` and ``en*`` use their own dictionary, every other language both.
    """
    def flag(key):
        pt = tx.contains_any(lower_text, lexicon.POLICY_PHRASES["pt"][key])
        en = tx.contains_any(lower_text, lexicon.POLICY_PHRASES["en"][key])
        return (f"(NOT startswith({language}, 'en') AND {pt}) "
                f"OR (NOT startswith({language}, 'pt') AND {en})")

    return _struct((key, flag(key)) for key in lexicon.POLICY_ELEMENTS)


def dictionary_hits(lower_text: str) -> str:
    """Which elements each dictionary finds: one reading of the text for any number of languages."""
    return _struct((f"{lang}_{key}", tx.contains_any(lower_text, phrases[key]))
                   for lang, phrases in lexicon.POLICY_PHRASES.items() for key in lexicon.POLICY_ELEMENTS)


def chosen_flags(hits: str, language: str) -> str:
    """``element_flags`` from the hits of both dictionaries."""
    return _struct((key, f"(NOT startswith({language}, 'en') AND {hits}.pt_{key}) "
                         f"OR (NOT startswith({language}, 'pt') AND {hits}.en_{key})")
                   for key in lexicon.POLICY_ELEMENTS)


def check_flags(lower_text: str) -> str:
    """Five flags of the independent profile: one list, no language choice."""
    return _struct(
        (key, tx.contains_any(lower_text, phrases))
        for key, phrases in lexicon.CHECK_POLICY_PHRASES.items()
    )


def flags_by(pages: DataFrame, *keys: str) -> DataFrame:
    """OR of every flag over the pages of a key."""
    return pages.groupBy(*keys).agg(
        *[F.bool_or(f"flags.{k}").alias(k) for k in lexicon.POLICY_ELEMENTS])


def first_evidence(pages: DataFrame, key: str, order: str) -> DataFrame:
    """URL of the first page, in visit order, on which a flag is true."""
    hit = F.explode(F.expr("filter(array(" + ", ".join(
        f"CASE WHEN flags.{k} THEN '{k}' END" for k in lexicon.POLICY_ELEMENTS
    ) + "), f -> f IS NOT NULL)")).alias("flag")
    return pages.select(key, order, "url", hit).groupBy(key, "flag").agg(
        F.min_by("url", order).alias("evidence_url"))
