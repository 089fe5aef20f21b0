"""The pipeline's inputs, made from the given tables, which hold no postings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.operators.matching import placed
from tidewheel.operators.stored import stored

TITLES = [
    "Senior Software Engineer - Backend", "Full Stack Developer", "SDE II", "Engineering Manager", "Software Engineer II", "Product Designer",
    "Data Scientist", "Platform Engineer (Java)", "Node.js Developer", "Careers", "Sr Software Engineer", "View all jobs",
]
LOCATIONS = [
    "Bengaluru, India", "Bangalore", "Gurgaon, Haryana", "Remote - India", "London, UK", "Hyderabad, Pakistan", "Pune", "BLR Office", None,
    "Remote", "Berlin, Germany", "Whitefield", "Remote - US", "Karnataka", "New Delhi", "IN", "San Francisco, United States",
]
SNIPPETS = [
    "Requirements\n3-5 years of Java and Spring Boot\nREST API design, PostgreSQL",
    "What you need\n6+ years building backend microservices in Java\nNice to have\nReact, TypeScript",
    "We use Node.js, TypeScript and React with AWS and Docker. 2 years minimum.",
    "Minimum qualifications\n10+ years leading teams\nBenefits\nGreat office",
    "Location: Pune, India\n1 year of JavaScript, full-stack web work",
    "Must have\nspring framework, distributed systems, SQL 4 to 6 yrs\nBonus\nkubernetes, terraform, lambda",
    "General role with no listed stack.",
    "This role is remote within India. React, CI/CD, grafana monitoring.",
    "Preferred Qualifications\nGo, Rust\n7 years",
    "Java developer 5.5 years, junit, latency and performance optimization at large scale",
]
SOURCES = ["greenhouse", "generic_html", "browser_html", "lever", "custom_api"]


def pick(key: Column, values: list) -> Column:
    return F.get(F.array(*(F.lit(v).cast("string") for v in values)), (key % len(values)).cast("int"))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, k = read(spark, sf_dir, "documents"), F.col("doc_id")
    url = F.when(k % 6 == 0, None).when(k % 6 == 1, F.concat(F.lit("https://jobs.example.com/careers?page="), k.cast("string"))).otherwise(F.concat(F.lit("https://jobs.example.com/"), "source", F.lit("/job/"), (k % 400).cast("string")))
    return d.select(
        F.col("source").alias("company_id"),
        k.cast("string").alias("external_id"),
        F.concat(F.lit("Company "), "source").alias("company_name"),
        pick(k, SOURCES).alias("source_type"),
        pick(k, TITLES).alias("title"),
        pick(k, LOCATIONS).alias("location"),
        F.concat(pick(k, SNIPPETS), F.lit("\n"), "text").alias("description"),
        url.alias("job_url"),
        F.concat(F.lit("2026-0"), (k % 9 + 1).cast("string"), F.lit("-1"), (k % 10).cast("string")).alias("posted_at"),
        (k % 31).alias("first_seen_day"),
        (k % 10 != 0).alias("active"),
        pick(k, ["new", "changed", "unchanged", None]).alias("last_change_type"),
        k.alias("ord"),
    )


def boards(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = read(spark, sf_dir, "nation")
    s = read(spark, sf_dir, "supplier").join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey"), "left")  # 25 nations
    return s.select(F.concat(F.lit("src"), F.col("s_suppkey").cast("string")).alias("company_id"), F.col("s_name").alias("company_name"), (F.col("s_suppkey") + 1).alias("rank"), (F.col("s_acctbal") >= 0).alias("enabled"), F.col("n_name").alias("country"))


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run, company_id, external_id, content): each day's last event of a key."""
    e = read(spark, sf_dir, "events")
    rows = e.select(F.to_date("ts").alias("run"), F.concat(F.lit("src"), (F.col("user_id") % 10).cast("string")).alias("company_id"), (F.get_json_object("props", "$.k").cast("long") % 50).cast("string").alias("external_id"), "event_type", "ts", "event_id")
    return rows.groupBy("run", "company_id", "external_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("content"))


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(company_id, run, jobs_found): the orders of a supplier in a month."""
    li = read(spark, sf_dir, "lineitem")
    return li.groupBy(F.concat(F.lit("src"), F.col("l_suppkey").cast("string")).alias("company_id"), F.trunc("l_shipdate", "month").alias("run")).agg(F.countDistinct("l_orderkey").alias("jobs_found"))


def page_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(board, page_no, external_id, total): order keys ten to a page; some pages dropped, repeated or blank."""
    o = read(spark, sf_dir, "orders").select((F.col("o_custkey") % 10).alias("board"), F.col("o_orderkey").alias("external_id"))
    totals = o.groupBy("board").agg(F.count("*").alias("total"))
    numbered = placed(o, "board", "external_id", lambda df: stored(df, "pagelog")).join(F.broadcast(totals), "board")  # ten boards
    paged = numbered.withColumn("page_no", F.floor((F.col("place") - 1) / 10))
    kept = paged.where("page_no % 17 != 5").select("board", "page_no", F.when(F.col("page_no") % 23 == 7, None).otherwise(F.col("external_id")).alias("external_id"), "total")
    again = paged.where("page_no % 29 = 3").select("board", (F.col("page_no") + 100000).alias("page_no"), "external_id", "total")
    return kept.unionByName(again)


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages")


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, turn, title, status, content_type, body): landed detail checks."""
    c = read(spark, sf_dir, "conversations")
    k = F.col("conv_id") + F.col("turn")
    status = F.get(F.array(*(F.lit(x) for x in (200, 404, 403, 200, 500, 410, 200, 429, 302, 200))), (k % 10).cast("int"))
    return c.select("conv_id", "turn", F.substring_index("text", " ", 3).alias("title"), status.alias("status"), pick(k, ["text/html", "application/pdf", None]).alias("content_type"), F.when(k % 4 == 0, F.concat(F.lit("JobPosting "), "text")).when(k % 4 == 1, F.reverse("text")).otherwise(F.col("text")).alias("body"))
