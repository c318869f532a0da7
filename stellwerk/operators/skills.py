"""Skill extraction from posting texts with an extendable taxonomy.

Every variant of every skill is found in one scan of the text. The pattern is a look-ahead, so each
start position is tested on its own and overlapping skills do not hide each other; only variants of
different skills that begin at the same place could, and those go to separate patterns.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Skill(NamedTuple):
    canonical: str
    category: str
    synonyms: tuple[str, ...]


# The standard taxonomy (canonical name, category, synonyms).
STANDARD_TAXONOMY = [
    Skill("Python", "sprache", ("python", "python3", "py")),
    Skill("SQL", "sprache", ("sql", "ansi sql", "t-sql", "pl/sql", "ansi-sql")),
    Skill("Java", "sprache", ("java", "jvm")),
    Skill("Scala", "sprache", ("scala",)),
    Skill("Go", "sprache", ("golang", "go")),
    Skill("R", "sprache", ("r-programmierung",)),
    Skill("TypeScript", "sprache", ("typescript", "ts")),
    Skill("Airflow", "orchestrierung", ("airflow", "apache airflow", "mwaa")),
    Skill("Dagster", "orchestrierung", ("dagster",)),
    Skill("Prefect", "orchestrierung", ("prefect",)),
    Skill("dbt", "transformation", ("dbt", "dbt core", "dbt cloud")),
    Skill("Spark", "verarbeitung", ("spark", "apache spark", "pyspark", "spark sql")),
    Skill("Flink", "verarbeitung", ("flink", "apache flink")),
    Skill("Kafka", "streaming", ("kafka", "apache kafka", "ksql")),
    Skill("Kinesis", "streaming", ("kinesis", "aws kinesis")),
    Skill("Snowflake", "warehouse", ("snowflake",)),
    Skill("BigQuery", "warehouse", ("bigquery", "big query", "gcp bigquery")),
    Skill("Redshift", "warehouse", ("redshift", "aws redshift")),
    Skill("Databricks", "plattform", ("databricks",)),
    Skill("DuckDB", "warehouse", ("duckdb",)),
    Skill("PostgreSQL", "datenbank", ("postgres", "postgresql", "pgsql")),
    Skill("MySQL", "datenbank", ("mysql", "mariadb")),
    Skill("MongoDB", "datenbank", ("mongodb", "mongo")),
    Skill("Cassandra", "datenbank", ("cassandra",)),
    Skill("ClickHouse", "datenbank", ("clickhouse",)),
    Skill("AWS", "cloud", ("aws", "amazon web services", "amazon aws")),
    Skill("Azure", "cloud", ("azure", "microsoft azure")),
    Skill("GCP", "cloud", ("gcp", "google cloud", "google cloud platform")),
    Skill("Docker", "infrastruktur", ("docker", "docker compose")),
    Skill("Kubernetes", "infrastruktur", ("kubernetes", "k8s", "kube")),
    Skill("Terraform", "infrastruktur", ("terraform", "hcl")),
    Skill("Ansible", "infrastruktur", ("ansible",)),
    Skill("Looker", "visualisierung", ("looker", "looker studio")),
    Skill("Tableau", "visualisierung", ("tableau",)),
    Skill("PowerBI", "visualisierung", ("power bi", "powerbi")),
    Skill("Superset", "visualisierung", ("superset", "apache superset")),
    Skill("Metabase", "visualisierung", ("metabase",)),
    Skill("Pandas", "bibliothek", ("pandas",)),
    Skill("Polars", "bibliothek", ("polars",)),
    Skill("NumPy", "bibliothek", ("numpy",)),
    Skill("PyTorch", "bibliothek", ("pytorch", "torch")),
    Skill("TensorFlow", "bibliothek", ("tensorflow", "tf2")),
    Skill("Scikit-Learn", "bibliothek", ("scikit-learn", "sklearn")),
    Skill("MLflow", "ml_ops", ("mlflow",)),
    Skill("Kubeflow", "ml_ops", ("kubeflow",)),
    Skill("Git", "tools", ("git", "github", "gitlab", "bitbucket")),
    Skill("Linux", "tools", ("linux", "unix", "bash")),
]

OTHER_CATEGORY = "sonstige"

_WORD = "[A-Za-z0-9_+#]"

TAXONOMY_FILE = T.StructType(
    [
        T.StructField("canonical", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("synonyms", T.ArrayType(T.StringType())),
    ]
)


def _holds_word(text: str, word: str) -> bool:
    """Does ``text`` hold ``word`` between word boundaries?"""
    return re.search(f"(?<!{_WORD}){re.escape(word)}(?!{_WORD})", text) is not None


def _needed_variants(skill: Skill) -> list[str]:
    """Spellings without those in which a shorter spelling of the same skill is found anyway."""
    spellings = sorted({v.lower() for v in (skill.canonical, *skill.synonyms)}, key=lambda v: (len(v), v))
    needed: list[str] = []
    for spelling in spellings:
        if not any(_holds_word(spelling, shorter) for shorter in needed):
            needed.append(spelling)
    return needed


def _same_start(a: str, b: str) -> bool:
    """Can both spellings match at one position, one being a whole-word prefix of the other?"""
    short, long = sorted((a, b), key=len)
    return long.startswith(short) and re.match(_WORD, long[len(short) :]) is None


def _scan_groups(taxonomy: Sequence[Skill]) -> list[dict[str, list[int]]]:
    """Distribute spellings over as few scans as possible without same-start conflicts.

    Each scan maps a spelling to the positions of the entries that use it.
    """
    groups: list[dict[str, list[int]]] = []
    for position, skill in enumerate(taxonomy):
        for spelling in _needed_variants(skill):
            for group in groups:
                if spelling in group:
                    group[spelling].append(position)
                    break
                if not any(_same_start(spelling, other) for other in group):
                    group[spelling] = [position]
                    break
            else:
                groups.append({spelling: [position]})
    return groups


def _quoted(text: str) -> str:
    return re.sub(r"([^A-Za-z0-9_ ])", r"\\\1", text)


def _pattern(spellings: Sequence[str]) -> str:
    """One alternation, branched on the first letter so that most words fail at once."""
    by_letter: dict[str, list[str]] = {}
    for spelling in spellings:
        by_letter.setdefault(spelling[0], []).append(spelling[1:])
    branches = [
        _quoted(letter) + "(?:" + "|".join(_quoted(rest) for rest in rests) + ")"
        for letter, rests in by_letter.items()
    ]
    return f"(?iu)(?<!{_WORD})(?=({'|'.join(branches)})(?!{_WORD}))"


def _positions_found(text: Column, group: dict[str, list[int]]) -> Column:
    """Taxonomy positions of the entries one scan finds."""
    positions = F.create_map(
        *[item for spelling, entries in group.items() for item in (F.lit(spelling), F.array(*map(F.lit, entries)))]
    )
    hits = F.array_distinct(F.regexp_extract_all(text, F.lit(_pattern(list(group))), F.lit(1)))
    # Case folding as the case-insensitive match does it: dotted capital I, dotless i, long s and
    # the Kelvin sign all equal their ASCII letter.
    return F.flatten(
        F.transform(hits, lambda hit: F.try_element_at(positions, F.lower(F.translate(hit, "İıſ\u212a", "iisk"))))
    )


def extract_skills(text: Column, taxonomy: Sequence[Skill] = STANDARD_TAXONOMY) -> Column:
    """Canonical names found in the text, in taxonomy order, each once; NULL or '' gives []."""
    filled = F.coalesce(text, F.lit(""))
    found = F.concat(*[_positions_found(filled, group) for group in _scan_groups(taxonomy)])
    canonical = F.array(*[F.lit(skill.canonical) for skill in taxonomy])
    return F.array_distinct(F.transform(F.array_sort(found), lambda i: F.get(canonical, i)))


def with_skills(
    df: DataFrame, text_col: str = "description", taxonomy: Sequence[Skill] = STANDARD_TAXONOMY
) -> DataFrame:
    """Add the ``skills`` array for a whole text column."""
    return df.withColumn("skills", extract_skills(F.col(text_col), taxonomy))


def taxonomy_frame(spark: SparkSession, taxonomy: Sequence[Skill] = STANDARD_TAXONOMY) -> DataFrame:
    """Taxonomy as rows; ``position`` keeps its order."""
    rows = [(i, s.canonical, s.category, list(s.synonyms)) for i, s in enumerate(taxonomy)]
    return spark.createDataFrame(
        rows, "position int, canonical string, category string, synonyms array<string>"
    )


def load_taxonomy(spark: SparkSession, path: str) -> DataFrame:
    """Taxonomy from JSON lines; a missing category or synonym list is filled in."""
    rows = spark.read.schema(TAXONOMY_FILE).json(path)
    return rows.select(
        "canonical",
        F.coalesce(F.nullif("category", F.lit("")), F.lit(OTHER_CATEGORY)).alias("category"),
        F.coalesce("synonyms", F.array().cast("array<string>")).alias("synonyms"),
    )


def skill_category(df: DataFrame, taxonomy: DataFrame, skill_col: str = "skill") -> DataFrame:
    """Add the category of each skill, matched without case; unknown skills get NULL.

    When names repeat the first entry counts. The join side is one row per taxonomy name, so Spark
    broadcasts it while it is small.
    """
    first = Window.partitionBy(F.lower("canonical")).orderBy("position")
    lookup = (
        taxonomy.withColumn("__n", F.row_number().over(first))
        .where("__n = 1")
        .select(F.lower("canonical").alias("__name"), F.col("category").alias("skill_category"))
    )
    return df.join(lookup, F.lower(F.col(skill_col)) == F.col("__name"), "left").drop("__name")


def canonical_skills(taxonomy: DataFrame) -> DataFrame:
    return taxonomy.select("canonical")


def merge_taxonomies(primary: DataFrame, secondary: DataFrame) -> DataFrame:
    """Primary entries win on equal names (any case); inside secondary the first one wins."""
    name = F.lower("canonical")
    fresh = secondary.join(primary.select(name.alias("__name")), name == F.col("__name"), "left_anti")
    first = Window.partitionBy(name).orderBy("position")
    fresh = fresh.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")
    return primary.withColumn("origin", F.lit("primary")).unionByName(
        fresh.withColumn("origin", F.lit("secondary"))
    )


def collect_taxonomy(taxonomy: DataFrame) -> list[Skill]:
    """Bring a taxonomy (a dictionary of names, never posting data) into the form patterns need."""
    ordered = taxonomy.orderBy("position") if "position" in taxonomy.columns else taxonomy
    return [
        Skill(row.canonical, row.category, tuple(row.synonyms))
        for row in ordered.select("canonical", "category", "synonyms").toLocalIterator()
    ]
