"""Match pages and JSON payloads read with built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def strip_tags(c: Column) -> Column:
    text = F.regexp_replace(F.regexp_replace(c, r"<[^>]+>", ""), r"\s+", " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return F.trim(text)


def links(pages: DataFrame) -> DataFrame:
    """Number of double-quoted link targets in each page, and the md5 of its url."""
    return pages.select("page_id", F.size(F.regexp_extract_all("html", F.lit(r'href="([^"]*)"'), 1)).cast("long").alias("n_links"), F.md5("url").alias("url_md5"))


# fixed values: parts of event names that tell the tier, tried in this order; any other is B
TIER_MARKS = (("S", ("major", "iem", "blast", "esl pro league", "rmr")), ("A", ("cct", "challenger", "epl", "thunderpick")))


def event_tier(name: Column) -> Column:
    out = F.lit("B")
    for tier, marks in reversed(TIER_MARKS):
        out = F.when(F.lower(name).rlike("|".join(marks)), tier).otherwise(out)
    return out


def best_of(fragment: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(F.lower(strip_tags(fragment)), r"\bbo([135])\b", 1), F.lit("")).cast("long"), F.lit(1).cast("long"))


def texts(fragment: Column, *classes: str) -> Column:
    """Distinct texts of the elements of each class, class after class."""
    found = F.flatten(F.array(*(F.regexp_extract_all(fragment, F.lit(rf'(?is)<[^>]+class="[^"]*\b{c}\b[^"]*"[^>]*>(.*?)</[^>]+>'), 1) for c in classes)))
    return F.array_distinct(F.filter(F.transform(found, strip_tags), lambda x: x != ""))


def first_text(fragment: Column, *classes: str) -> Column:
    return F.get(texts(fragment, *classes), 0)


def first_number(fragment: Column, *classes: str) -> Column:
    """The first number in the texts of the classes; thousands' commas dropped."""
    numbers = F.transform(texts(fragment, *classes), lambda x: F.regexp_extract(F.replace(x, F.lit(","), F.lit("")), r"(-?\d+(?:\.\d+)?)", 1).try_cast("double"))
    return F.get(F.filter(numbers, lambda x: x.isNotNull()), 0)


def ratio(fragment: Column, *classes: str) -> Column:
    """As a share: a percentage, or any number over one, is divided by 100."""
    x = first_number(fragment, *classes)
    return F.when(F.coalesce(F.array_join(texts(fragment, *classes), " ").contains("%"), F.lit(False)) | (x > 1), x / 100).otherwise(x)


def page_date(fragment: Column) -> Column:
    """From the text, else from milliseconds since 1970, else 1970-01-01."""
    stamp = F.regexp_extract(fragment, r'(?i)data-unix="(\d+)"', 1).try_cast("long")
    return F.coalesce(F.try_to_date(F.regexp_extract(first_text(fragment, "date", "match-date", "time"), r"^(\d{4}-\d{2}-\d{2})", 1)), F.date_from_unix_date(F.floor(stamp / 86_400_000).cast("int")), F.date_from_unix_date(F.lit(0)))


def parts(html: Column, start: str) -> Column:
    """What follows each match of ``start``, up to the next."""
    return F.slice(F.split(html, start), 2, 2**31 - 1)


# fixed values: the class names and attributes in match_cards, ranking_rows and player_rows are those of the pages
def match_cards(pages: DataFrame) -> DataFrame:
    """A row for each result card: date, event, tier, teams, scores, winner (the first team at equal scores), best_of, map and link.
    Cards without two different teams or two scores give no row; a null page gives none."""
    card = F.col("card")
    cards = pages.select("page_id", F.posexplode(parts(F.col("html"), r'(?is)<div[^>]+class="[^"]*result-con[^"]*"[^>]*>')).alias("card_no", "card"))
    scores = F.regexp_extract_all(card, F.lit(r'(?is)<[^>]+class="[^"]*(?:score-won|score-lost|score)[^"]*"[^>]*>(\d+)</[^>]+>'), 1)
    # each figure is read once: a generated row's columns are neither repeated in the filter nor in what is derived from them
    read = F.struct(
        page_date(card).alias("date"), first_text(card, "event-name", "event").alias("_event"), first_text(card, "team1", "team-cell", "team").alias("team1"),
        F.try_element_at(texts(card, "team2", "team-cell", "team"), F.lit(-1)).alias("team2"), scores.alias("_scores"), best_of(card).alias("best_of"),
        F.lower(F.coalesce(first_text(card, "map-text", "map"), F.lit("unknown"))).alias("map"), F.regexp_extract(card, 'href="([^"]+)"', 1).alias("link"),
    )
    cards = cards.select("page_id", "card_no", "card", F.inline(F.array(read)))
    rows = cards.select(
        "page_id", "card_no", "date", F.coalesce("_event", F.lit("unknown")).alias("event"), event_tier(F.coalesce(F.col("_event"), card)).alias("tier"), "team1", "team2",
        F.get("_scores", 0).try_cast("long").alias("score1"), F.get("_scores", 1).try_cast("long").alias("score2"), "best_of", "map", "link",
    )
    return rows.filter("team1 <> team2 and score1 is not null and score2 is not null").withColumn("winner", F.when(F.col("score1") >= F.col("score2"), F.col("team1")).otherwise(F.col("team2")))


def ranking_rows(pages: DataFrame, most: int = 80) -> DataFrame:
    """Teams of ranking and event pages in page order, the first row of each name: rank (else first #number, else place), points, region, link."""
    card = F.col("card")
    cards = pages.select("page_id", F.posexplode(parts(F.col("html"), r'(?is)<div[^>]+class="[^"]*\bteam(?:-[a-z0-9]+)?\b[^"]*"[^>]*>')).alias("card_no", "card"))
    anchor = F.regexp_extract(card, r'(?is)<a[^>]+href="[^"]*/team/[^"]+"[^>]*>(.*?)</a>', 1)
    name = F.trim(F.regexp_replace(F.coalesce(first_text(anchor, "team-name", "name", "text-ellipsis"), strip_tags(anchor)), r"\s+#\d+\b.*$", ""))
    named = cards.select("page_id", "card_no", "card", name.alias("team")).filter("team <> ''")
    first = named.groupBy("page_id", F.lower("team").alias("_k")).agg(F.min_by(F.struct("card_no", "card", "team"), "card_no").alias("r")).select("page_id", "r.*")
    placed = first.withColumn("place", F.row_number().over(Window.partitionBy("page_id").orderBy("card_no")).cast("long")).filter(F.col("place") <= most)
    points = F.regexp_extract(strip_tags(card), r"(?i)([\d,]+)\s*points?", 1)
    return placed.select(
        "page_id", "place", "team", F.coalesce(first_number(card, "position", "rank", "ranking", "event-seed", "seed").cast("long"), F.regexp_extract(strip_tags(card), r"#\s*(\d+)", 1).try_cast("long"), "place").alias("rank"),
        F.coalesce(F.replace(points, F.lit(","), F.lit("")).try_cast("long"), F.lit(0)).alias("points"), F.coalesce(first_text(card, "country", "region"), F.lit("")).alias("region"), F.regexp_extract(card, r'(?i)href="([^"]*/team/[^"]+)"', 1).alias("link"),
    )


def player_rows(pages: DataFrame, default_date: str) -> DataFrame:
    """Players of statistics tables; missing figures are 1.0, missing shares 0.5."""
    card = F.col("card")
    rows = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), 1)).alias("row_no", "card")).filter(card.contains("/player/"))
    number = lambda *c: F.coalesce(first_number(card, *c), F.lit(1.0))
    share = lambda *c: F.coalesce(ratio(card, *c), F.lit(0.5))
    role = F.lower(F.array_join(texts(card, "role", "status", "note"), " "))
    return rows.select(
        "page_id", "row_no", F.coalesce(first_text(card, "date", "snapshot-date"), F.lit(default_date)).alias("date"), first_text(card, "team", "team-name").alias("team"),
        strip_tags(F.regexp_extract(card, r'(?is)<a[^>]+href="[^"]*/player/[^"]+"[^>]*>(.*?)</a>', 1)).alias("player"), number("rating", "rating2", "rating-20").alias("rating"), number("kd", "k-d", "kd-ratio").alias("kd"),
        share("opening-success", "opening", "fk-success").alias("opening_success"), share("clutch-winrate", "clutch", "clutch-success").alias("clutch_winrate"), role.rlike("sub|stand-in|stand in").cast("int").alias("is_substitute"),
    ).filter("player <> '' and team is not null")


def props(events: DataFrame, schema: str = "page string, ref string") -> DataFrame:
    return events.select("event_id", F.from_json("props", schema).alias("props"))


def version_log(lines: DataFrame) -> DataFrame:
    """date and tag of each line; comma or space between them, # starts a comment."""
    text = F.trim(F.regexp_replace("value", "#.*$", ""))
    parts = F.split(text, r"\s*,\s*|\s+", 2)
    return lines.filter(F.length(text) > 0).select(F.try_to_date(F.substring(parts[0], 1, 10)).alias("date"), F.trim(parts[1]).alias("tag")).filter("date is not null")
