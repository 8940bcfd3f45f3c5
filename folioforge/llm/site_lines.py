"""Problem 6: lines that a site repeats in many of its documents.

Method: PrefixSpan over line-identifier sequences, one sequence database per site. A line's
identifier is the 64-bit hash of its normal form (lower case, runs of other characters one blank,
digit runs 0). A request is the sequence of its frequent lines; equal sequences of a site are one row with their number, so the database of
a site with a third of all requests is as long as the ways in which its standing lines occur. Patterns grow level by level: a row of a projected
database is (site, pattern, what follows the pattern's first occurrence, number of requests); it is extended by each line that follows,
whether or not others lie between, and equal rows are merged again. Support is the number of distinct requests of the site.
Occurrences of frequent patterns, single lines included, are then removed.

No group is gathered: lines are counted by (site, line), rows by (site, pattern, rest), with partial sums before each shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.llm.texts import latest, with_site
from folioforge.plans.runtime import fan_out, save_table

MIN_REQUESTS = 5
MIN_SHARE = 0.03
#: Levels that are grown to find the lines to remove. Each line of a longer pattern is a line of a shorter one too, so more levels remove the same lines;
#: with all of them the number of patterns can grow exponentially with the standing lines of a request.
LEVELS = 2


def normal_form(line: Column) -> Column:
    """Lines are the same if their normal forms are."""
    return F.regexp_replace(F.trim(F.regexp_replace(F.lower(line), r"[^\p{L}\p{N}]+", " ")), r"\p{Nd}+", "0")


def site_requests(requests: DataFrame, publishers: DataFrame) -> DataFrame:
    """(request_id, site, body) once per request that has a site, in its latest delivery."""
    once = latest(requests, "request_id", "received_at", "publisher", "origin", "body")
    return with_site(once, publishers).where("site is not null").select("request_id", "site", "body")


def line_table(bodies: DataFrame) -> DataFrame:
    """(site, request_id, line_no, line_id) of every line with at least one letter."""
    lines = bodies.select("site", "request_id", F.posexplode(F.split("body", "\n")).alias("pos", "line"))
    norm = lines.select("site", "request_id", (F.col("pos") + 1).alias("line_no"), normal_form(F.col("line")).alias("norm"))
    return norm.where(F.col("norm").rlike(r"\p{L}")).select("site", "request_id", "line_no", F.xxhash64("norm").alias("line_id"))


def frequent(pairs: DataFrame, totals: DataFrame, pattern: str = "pattern", min_requests: int = MIN_REQUESTS, min_share: float = MIN_SHARE) -> DataFrame:
    """(site, pattern, support) of patterns in enough requests of their site.

    ``pairs`` holds (site, pattern, request_id), repeats allowed. ``totals`` has one row per
    site (site, site_requests).
    """
    once = pairs.select("site", pattern, "request_id").distinct()
    support = once.groupBy("site", pattern).agg(F.count("*").alias("support"))
    kept = support.where(F.col("support") >= min_requests).join(totals, "site")
    return kept.where(F.col("support") >= min_share * F.col("site_requests")).select("site", pattern, "support")


def _extended(rows: DataFrame) -> DataFrame:
    """Projected databases of all patterns longer by one line: of each line that follows, what comes after its first occurrence."""
    step = rows.select("site", "pattern", "rest", "weight", F.explode(F.array_distinct("rest")).alias("x_"))
    rest = F.slice("rest", (F.array_position("rest", F.col("x_")) + 1).cast("int"), F.size("rest"))
    return step.select("site", F.concat("pattern", F.array("x_")).alias("pattern"), rest.alias("rest"), "weight").groupBy("site", "pattern", "rest").agg(F.sum("weight").alias("weight"))


def frequent_sequences(lines: DataFrame, totals: DataFrame, min_requests: int = MIN_REQUESTS, min_share: float = MIN_SHARE, levels: int | None = None) -> DataFrame:
    """PrefixSpan: (site, pattern ARRAY<BIGINT>, support) of every sequence of lines that is frequent in its site, gaps allowed.

    lines: (site, request_id, line_no, line_id); totals: (site, site_requests). Patterns of any length, grown until no pattern of a level is
    frequent, or of at most ``levels`` lines (then as one plan, without a job per level). A line that a request repeats may stand in a pattern as often.
    """
    singles = frequent(lines.withColumnRenamed("line_id", "pattern"), totals, "pattern", min_requests, min_share)
    kept = lines.join(singles.select("site", F.col("pattern").alias("line_id")), ["site", "line_id"], "left_semi")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line_id"))), lambda e: e["line_id"])  # the lines of one request
    sequences = kept.groupBy("site", "request_id").agg(ordered.alias("rest")).groupBy("site", "rest").agg(F.count("*").alias("weight"))
    rows = sequences.withColumn("pattern", F.array().cast("array<bigint>"))
    rows = save_table(rows, "sequences") if levels is None else rows
    found, k = [], 0
    while levels is None or k < levels:
        k += 1
        longer = _extended(rows)
        longer = save_table(longer, f"level{k}") if levels is None else longer
        support = longer.groupBy("site", "pattern").agg(F.sum("weight").alias("support")).where(F.col("support") >= min_requests).join(totals, "site")
        good = support.where(F.col("support") >= min_share * F.col("site_requests")).select("site", "pattern", "support")
        if levels is None:
            good = save_table(good, f"patterns{k}")
            if good.isEmpty():
                break
        found.append(good)
        rows = longer.join(good.select("site", "pattern"), ["site", "pattern"], "left_semi")
    return reduce(DataFrame.unionByName, found) if found else singles.select("site", F.array("pattern").alias("pattern"), "support")


def _databases(requests: DataFrame, publishers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lines, requests per site) of all sites, in the shared folder. Counting needs no bodies, so it reads none."""
    sites = with_site(latest(requests, "request_id", "received_at", "publisher", "origin"), publishers).where("site is not null")
    totals = save_table(sites.groupBy("site").agg(F.count("*").alias("site_requests")), "sites")
    return save_table(line_table(fan_out(site_requests(requests, publishers))), "lines"), totals


def repeated_lines(requests: DataFrame, publishers: DataFrame, min_requests: int = MIN_REQUESTS, min_share: float = MIN_SHARE, levels: int = LEVELS) -> DataFrame:
    """(request_id, line_no) of each line with a letter that belongs to a frequent sequence of its site, single lines included.

    line_no counts from 1, lines end in a line feed. Null bodies, requests without site and
    empty tables give no rows; a request counts once however often it was delivered.
    """
    lines, totals = _databases(requests, publishers)
    patterns = frequent_sequences(lines, totals, min_requests, min_share, levels)
    standing = patterns.select("site", F.explode("pattern").alias("line_id")).distinct()
    return lines.join(standing, ["site", "line_id"], "left_semi").select("request_id", "line_no")


def site_patterns(requests: DataFrame, publishers: DataFrame) -> DataFrame:
    """(site, pattern, n_lines, support) of every frequent sequence of one or more lines, adjacent or with others between; pattern is line identifiers joined by blanks."""
    patterns = frequent_sequences(*_databases(requests, publishers))
    return patterns.select("site", F.array_join(F.col("pattern").cast("array<string>"), " ").alias("pattern"), F.size("pattern").alias("n_lines"), "support")


def clean_bodies(requests: DataFrame, publishers: DataFrame, min_requests: int = MIN_REQUESTS, min_share: float = MIN_SHARE) -> DataFrame:
    """(request_id, site, body, n_removed) of every request: its body without the site's standing lines.

    Requests without site keep their body; a null body stays null. Kept lines are unchanged and in order;
    blank lines left doubled by a removal are joined to one.
    """
    once = with_site(latest(requests, "request_id", "received_at", "publisher", "origin", "body"), publishers)
    found = repeated_lines(requests, publishers, min_requests, min_share).groupBy("request_id").agg(F.collect_set("line_no").alias("drop_"))
    joined = once.join(found, "request_id", "left")
    kept = F.filter(F.transform(F.split("body", "\n"), lambda x, i: F.when(~F.array_contains(F.col("drop_"), i + 1), x)), lambda x: x.isNotNull())
    text = F.regexp_replace(F.array_join(kept, "\n"), r"\n{3,}", "\n\n")
    body = F.when(F.col("drop_").isNull(), F.col("body")).otherwise(text)
    return joined.select("request_id", "site", body.alias("body"), F.coalesce(F.size("drop_"), F.lit(0)).alias("n_removed"))
