"""Team pages whose rows stand in arrays inside a script."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: what only a page of the firewall holds
BLOCKED = ("aliyun_waf", "acw_sc__v2", "TJCaptcha", "captcha")
#: Strings with their escapes, brackets, what is between them; a string that isn't closed takes the rest.
_TOKENS = r"""\"(?:[^\"\\]++|\\[\s\S])*+\"|'(?:[^'\\]++|\\[\s\S])*+'|[\[\]]|[^\[\]\"']++|[\"'][\s\S]*"""


def blocked(html: Column) -> Column:
    return F.coalesce(html.rlike("|".join(BLOCKED)), F.lit(False))


def with_script_array(pages: DataFrame, html: str, key: str, out: str) -> DataFrame:
    """``out``: the text of the array that follows the first ``key``, up to the bracket that closes it. Brackets in strings don't count; null
    where the key, an opening or the closing bracket is missing."""
    at = F.instr(html, key)
    rest = F.when(at > 0, F.regexp_extract(F.substr(html, at), r"^[^\[]*(\[[\s\S]*)", 1))
    tokens = F.regexp_extract_all("_rest", F.lit(_TOKENS), F.lit(0))

    def step(s: Column, token: Column) -> Column:
        depth = s.depth + F.when(token == "[", 1).when(token == "]", -1).otherwise(0)
        closes = (s.end == 0) & (token == "]") & (depth == 0)
        return F.struct(depth.alias("depth"), (s.at + 1).alias("at"), F.when(closes, s.at + 1).otherwise(s.end).alias("end"))

    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("at"), F.lit(0).alias("end"))
    found = pages.withColumn("_rest", rest).withColumn("_tokens", tokens).withColumn("_end", F.aggregate("_tokens", start, step, lambda s: s.end))
    return found.withColumn(out, F.when(F.col("_end") > 0, F.array_join(F.slice("_tokens", 1, F.col("_end")), ""))).drop("_rest", "_tokens", "_end")


def read_pages(pages: DataFrame, key: str, row: str, html: str = "html") -> DataFrame:
    """``pages`` with ``status`` (ok, blocked, or unparsed: no whole array of such rows) and ``rows``, an array of structs of ``row`` (a schema)."""
    read = with_script_array(pages, html, key, "_array")
    options = {"allowUnquotedFieldNames": "true", "allowSingleQuotes": "true"}
    rows = read.withColumn("rows", F.when(~blocked(F.col(html)), F.from_json("_array", f"array<struct<{row}>>", options))).drop("_array")
    return rows.withColumn("status", F.when(blocked(F.col(html)), "blocked").when(F.col("rows").isNull(), "unparsed").otherwise("ok"))


def status_counts(read: DataFrame) -> DataFrame:
    """Pages and rows by status."""
    return read.groupBy("status").agg(F.count("*").alias("pages"), F.coalesce(F.sum(F.size("rows")), F.lit(0)).alias("n_rows"))
