"""The quality gate of one board's records, and its dedupes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.functions.predicates import plausible, valid_url
from tidewheel.functions.text import blank, strip
from tidewheel.operators.inventory import first_by


def dedupe_extracted(rows: DataFrame, order: str = "ord") -> DataFrame:
    """First by (url, title, location), letter case aside."""
    return first_by(rows, [blank(F.col("job_url")), F.lower("title"), F.lower(blank(F.col("location")))], [order])


def quality_key():
    url, eid = strip(blank(F.col("job_url"))), strip(blank(F.col("external_id")))
    title, location = F.lower(strip(blank(F.col("title")))), F.lower(strip(blank(F.col("location"))))
    named = F.when((title != "") & (location != ""), F.concat_ws("\u0001", F.lit("fallback"), title, location)).otherwise("fallback")
    return F.when(valid_url(url), F.concat_ws("\u0001", F.lit("url"), url)).when(eid != "", F.concat_ws("\u0001", F.lit("id"), "company_id", eid)).otherwise(named)


def dedupe_quality(rows: DataFrame, order: str = "ord") -> DataFrame:
    """First by URL, else id, else (title, location); rows with none of them share one key. Within a board."""
    return first_by(rows, [F.col("company_id"), quality_key()], [order])


def gate(rows: DataFrame, order: str = "ord") -> DataFrame:
    """Plausible rows, URLs repaired from URL-shaped ids; unusable fragments of usable rows go; first of each key."""
    good = rows.where(plausible(F.col("title"), F.col("source_type"), F.col("job_url"))).withColumn("title", strip(F.col("title")))
    repair = ~valid_url(F.col("job_url")) & valid_url(F.col("external_id"))
    good = good.withColumns({"repaired_url": F.coalesce(repair, F.lit(False)), "job_url": F.when(repair, F.col("external_id")).otherwise(F.col("job_url"))})
    eid = F.nullif(strip(blank(F.col("external_id"))), F.lit(""))
    place = F.struct(F.lower(F.col("title")), F.lower(strip(blank(F.col("location")))))
    named = (F.col("title") != "") & (strip(blank(F.col("location"))) != "")
    good = good.withColumns({"_usable": (F.col("title") != "") & valid_url(F.col("job_url")), "_eid": eid, "_place": F.when(named, place)})
    ids = good.where("_usable and _eid is not null").select("company_id", "_eid").distinct()
    spots = good.where("_usable and _place is not null").select("company_id", "_place").distinct()
    fragments = good.where("not _usable").join(ids, ["company_id", "_eid"], "left_anti").join(spots, ["company_id", "_place"], "left_anti")
    kept = good.where("_usable").unionByName(fragments.select(*good.columns))
    return dedupe_quality(kept.drop("_usable", "_eid", "_place"), order)


def board_quality(rows: DataFrame) -> DataFrame:
    """Per board: rows, valid titles and URLs, ratios, distinct keys and duplicates."""
    filled = lambda c: strip(blank(F.col(c))) != ""
    eid, url = strip(blank(F.col("external_id"))), strip(blank(F.col("job_url")))
    key = F.when(eid != "", F.concat(F.lit("id:"), eid)).when(url != "", F.concat(F.lit("url:"), url)).otherwise(F.concat(F.lit("title:"), F.lower(strip(blank(F.col("title")))), F.lit("|"), F.lower(strip(blank(F.col("location"))))))
    counted = rows.groupBy("company_id").agg(
        F.count("*").alias("n"),
        F.count_if(filled("title")).alias("titles_valid"),
        F.count_if(valid_url(F.col("job_url"))).alias("urls_valid"),
        F.count_if(filled("external_id")).alias("ids"),
        F.count_if(filled("description")).alias("descriptions"),
        F.count_if(filled("location")).alias("locations"),
        F.countDistinct(key).alias("unique_jobs"),
        F.array_join(F.sort_array(F.collect_set("source_type")), ",").alias("source_types"),
    )
    ratio = lambda c: F.round(F.col(c) / F.col("n"), 4)
    return counted.withColumns({"quality_ratio": F.round(F.least("titles_valid", "urls_valid") / F.col("n"), 4), "valid_url_ratio": ratio("urls_valid"), "stable_id_ratio": ratio("ids"), "description_ratio": ratio("descriptions"), "location_ratio": ratio("locations"), "duplicates": F.col("n") - F.col("unique_jobs")})


def even_sample(rows: DataFrame, size: int, key: str = "company_id", order: str = "ord") -> DataFrame:
    """size rows of each board, evenly spread: places round(i (n - 1) / (size - 1)), halves to even; the middle for one."""
    w = Window.partitionBy(key)
    numbered = rows.withColumns({"_i": F.row_number().over(w.orderBy(order)) - 1, "_n": F.count("*").over(w)})
    if size <= 0:
        return rows.limit(0)
    if size == 1:
        wanted = F.col("_i") == F.floor(F.col("_n") / 2)
    else:
        places = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.bround(i * (F.col("_n") - 1) / (size - 1)).cast("int"))
        wanted = (F.col("_n") <= size) | F.array_contains(places, F.col("_i"))
    return numbered.where(wanted).drop("_i", "_n")
