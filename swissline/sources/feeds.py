"""CSV and JSON feeds: text in, typed columns out; and the sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# fixed values: endings of numeric column names, by type
INT_NAMES = ("best_of", "rank", "seed", "swiss_round", "wins", "losses", "round")
DOUBLE_NAMES = ("points", "rating", "kd", "winrate", "strength", "success", "odds_team1", "odds_team2", "confidence", "american")


def kind_of(name: str) -> str:
    if name.endswith(INT_NAMES):
        return "int"
    return "double" if name.endswith(DOUBLE_NAMES) else "string"


def typed(df: DataFrame) -> DataFrame:
    """Blank is null; numbers by name, ints through double ("12.7" is 12); ``_corrupt`` counts cells that failed."""
    out, bad = {}, F.lit(0)
    for c in df.columns:
        text = F.nullif(F.trim(c), F.lit(""))
        value = {"int": text.try_cast("double").try_cast("int"), "double": text.try_cast("double"), "string": text}[kind_of(c)]
        bad = bad + (text.isNotNull() & value.isNull()).cast("int")
        out[c] = value
    return df.select(*(v.alias(c) for c, v in out.items()), bad.alias("_corrupt"))


def read_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    return typed(spark.read.schema(", ".join(f"`{c}` string" for c in columns)).csv(path, header=True))


def with_seeds(teams: DataFrame, order: str) -> DataFrame:
    """Seed is the row's place, strength falls with it; only where the columns are missing. A stage has some tens of teams."""
    if "seed" not in teams.columns:
        teams = teams.withColumn("seed", F.row_number().over(Window.orderBy(order)))
    if "strength" not in teams.columns:
        teams = teams.withColumn("strength", F.greatest(F.lit(0.05), 1 - (F.col("seed") - 1) / F.count("*").over(Window.partitionBy())))
    return teams


def write_csv(df: DataFrame, path: str) -> None:
    flat = [F.array_join(f.name, "|").alias(f.name) if f.dataType.typeName() == "array" else F.col(f.name) for f in df.schema]
    df.select(*flat).write.mode("overwrite").csv(path, header=True)


def write_json(df: DataFrame, path: str) -> None:
    df.select(*sorted(df.columns)).write.mode("overwrite").json(path)
