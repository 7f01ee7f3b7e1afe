"""Company data: cleaning, confidence gate and merge into the site record."""

from pyspark.sql import DataFrame, functions as F

from pagewarden import lexicon
from pagewarden.functions import text as tx


def cleaned(value: str) -> str:
    """NULL, blank and the sentinel become NULL; other values stay as they are."""
    return (f"CASE WHEN lower({tx.strip(value)}) IN ('', '{lexicon.COMPANY_SENTINEL}') "
            f"THEN NULL ELSE {value} END")


def nameserver_list(value: str) -> str:
    """Text of a name server field to an array: JSON list, one name, or nothing."""
    return (f"CASE WHEN {cleaned(value)} IS NULL THEN CAST(array() AS array<string>) "
            f"WHEN startswith({value}, '[') "
            f"THEN coalesce(from_json({value}, 'array<string>'), array({value})) "
            f"ELSE array({value}) END")


def parse_input(raw: DataFrame, column: str = "raw") -> DataFrame:
    """Company input rows with an error code; NULL error means accepted."""
    field = lambda name: f"try_variant_get(parsed, '$.{name}', 'string')"
    opened = raw.withColumn("parsed", F.expr(f"try_parse_json({column})"))
    return opened.withColumn("error", F.expr(
        "CASE WHEN parsed IS NULL THEN 'invalid_json' "
        "WHEN NOT startswith(schema_of_variant(parsed), 'OBJECT') THEN 'not_an_object' "
        f"WHEN coalesce({tx.strip(field('company_name'))}, '') = '' "
        "THEN 'missing_company_name' END"
    )).withColumns({
        "company_name": F.expr(
            f"CASE WHEN error IS NULL THEN {tx.strip(field('company_name'))} END"),
        **{name: F.expr(f"CASE WHEN error IS NULL THEN {field(name)} END")
           for name in ("legal_name", "country", "address")},
    }).drop("parsed")


def with_input_legal_name(results: DataFrame, inputs: DataFrame, key: str) -> DataFrame:
    """Legal name of the resolution, else the one that was given."""
    given = inputs.select(key, F.col("legal_name").alias("_given"))
    return results.join(given, key, "left").withColumn("legal_name", F.expr(
        f"coalesce({cleaned('legal_name')}, {cleaned('_given')})")).drop("_given")


def gate(results: DataFrame, force: bool = False) -> DataFrame:
    """Adds ``decision`` (go / blocked), ``reason`` and ``warnings``."""
    forced = "true" if force else "false"
    decided = results.withColumns({
        "site_url": F.expr(cleaned("url")),
        "level": F.expr(f"coalesce(lower({cleaned('confidence')}), '')"),
    }).withColumn("reason", F.expr(
        "CASE WHEN site_url IS NULL THEN 'no_url' "
        f"WHEN level = 'low' AND NOT {forced} THEN 'low_confidence' END"
    )).withColumn("decision", F.expr(
        "CASE WHEN reason IS NULL THEN 'go' ELSE 'blocked' END"))
    return decided.withColumn("warnings", F.expr(
        "CASE WHEN decision = 'blocked' THEN CAST(array() AS array<string>) ELSE "
        "array_compact(array(CASE WHEN level IN ('low', 'medium') "
        "THEN concat(level, '_confidence') END, "
        "CASE WHEN NOT registry_verified THEN 'registry_not_confirmed' END)) END"
    )).drop("level")


FIELDS = ("company_legal_name", "company_nif", "company_address",
          "company_registry_verified", "company_note", "company_nameservers")


def record_fields(results: DataFrame) -> DataFrame:
    """The six company fields a site record carries, one row per site URL.

    Should several companies resolve to one site, one of them is taken, always
    the same one.
    """
    fields = results.selectExpr(
        f"{cleaned('url')} AS url",
        f"coalesce({cleaned('legal_name')}, {cleaned('company_name')}) AS company_legal_name",
        f"{cleaned('nif')} AS company_nif",
        f"{cleaned('address')} AS company_address",
        "registry_verified AS company_registry_verified",
        f"{cleaned('note')} AS company_note",
        f"{nameserver_list('nameservers')} AS company_nameservers",
    ).where("url IS NOT NULL")
    return fields.groupBy("url").agg(F.max(F.struct(*FIELDS)).alias("c")).select(
        "url", "c.*")


def merge_into_sites(sites: DataFrame, results: DataFrame) -> DataFrame:
    """Site records with company data; never touches what rules look at and
    never repeats a site."""
    return sites.join(record_fields(results), "url", "left")


def display_name(url: str = "url") -> str:
    return (f"coalesce({cleaned('company_name')}, {cleaned('legal_name')}, {url})")


def store_rows(results: DataFrame) -> DataFrame:
    """Company values as the store keeps them, by site URL."""
    names = nameserver_list("nameservers")
    return results.where(f"{cleaned('url')} IS NOT NULL").selectExpr(
        f"{cleaned('url')} AS url",
        f"{display_name()} AS name",
        f"{cleaned('legal_name')} AS legal_name",
        f"{cleaned('nif')} AS nif",
        f"{cleaned('address')} AS address",
        "registry_verified",
        f"{cleaned('note')} AS note",
        f"CASE WHEN size({names}) > 0 THEN to_json({names}) END AS nameservers_json",
    )
