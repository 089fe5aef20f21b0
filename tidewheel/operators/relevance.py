"""Deterministic relevance scoring, as staged columns, and its incremental upkeep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewheel.functions import profile as P
from tidewheel.functions.predicates import title_excluded
from tidewheel.functions.text import analysis_hash, blank, coarse_location, content_hash, either, has_any, normalize_text, plain_dashes, plainly_foreign, strip
from tidewheel.operators.location import classify
from tidewheel.operators.stored import size_of

#: Bytes of the files read that one scoring task gets at most.
PART = 4 << 20


def with_sections(df: DataFrame, description: str, headings: dict[str, list[str]], normal: str | None = None) -> DataFrame:
    """Adds a column of each name: the lines after the first line with one of its headings, up to the next line that
    looks like another heading; the first line after it is always taken.

    Each step reads columns of the step before, so a line is split, stripped and normalised once whatever reads it.
    normal: the column of the normalised text, if there is one; a text without any of the headings is not split.
    """
    text = blank(F.col(description))
    if normal:
        text = F.when(either(F.col(normal).contains(h) for words in headings.values() for h in words), text).otherwise("")
    df = df.withColumn("_lines", F.transform(F.split(text, r"\R"), strip))
    looks = lambda x: x.rlike(r"^[A-Za-z][A-Za-z /&+-]{2,55}:?$") & (F.size(F.split(x, r"\s+")) <= 7)
    df = df.withColumns({"_plain": F.transform("_lines", normalize_text), "_looks": F.transform("_lines", looks)})
    ours = lambda words: F.transform("_plain", lambda x: either(x.contains(h) for h in words))
    df = df.withColumns({f"_ours{k}": ours(words) for k, words in headings.items()})
    df = df.withColumns({f"_start{k}": F.array_position(f"_ours{k}", True) for k in headings})  # from 1; 0 where there is none
    closes = lambda k: F.zip_with("_looks", f"_ours{k}", lambda closes, ours: closes & ~ours)
    df = df.withColumns({f"_stop{k}": F.array_position(F.slice(closes(k), (F.col(f"_start{k}") + 2).cast("int"), F.size("_lines")), True) for k in headings})
    stop = lambda k: F.when(F.col(f"_stop{k}") > 0, F.col(f"_stop{k}")).otherwise(F.size("_lines")).cast("int")
    body = lambda k: strip(F.array_join(F.slice("_lines", (F.col(f"_start{k}") + 1).cast("int"), stop(k)), "\n"))
    df = df.withColumns({k: F.when(F.col(f"_start{k}") > 0, body(k)).otherwise("") for k in headings})
    return df.drop("_lines", "_plain", "_looks", *(f"_{x}{k}" for k in headings for x in ("ours", "start", "stop")))


def experience_mentions(text: Column) -> Column:
    """array of struct(low, open, high): ranges first, then single values outside of ranges."""
    clean = plain_dashes(text)
    # \d(?<!\d\d)\d? is \d{1,2} after no digit, with the digit tested first
    span = r"(?i)(\d(?<!\d\d)\d?(?:\.\d+)?)\s*(?:-|to)\s*(\d{1,2}(?:\.\d+)?)\s*(?:\+\s*)?(?:years?|yrs?)\b"
    single = r"(?i)(\d(?<!\d\d)\d?(?:\.\d+)?)\s*(?:\+|plus|or more|and above|minimum|min\.?)?\s*(?:years?|yrs?)\b"
    number = lambda x, g, pattern: F.regexp_extract(x, pattern, g).cast("double")
    made = lambda low, high: F.struct(low.alias("low"), high.isNull().alias("open"), high.alias("high"))
    ranges = F.transform(F.regexp_extract_all(clean, F.lit(span), 0), lambda x: made(F.least(number(x, 1, span), number(x, 2, span)), F.greatest(number(x, 1, span), number(x, 2, span))))
    rest = F.regexp_replace(clean, span, " ; ")
    singles = F.transform(F.regexp_extract_all(rest, F.lit(single), 0), lambda x: made(number(x, 1, single), F.lit(None).cast("double")))
    return F.filter(F.concat(ranges, singles), lambda r: (r["low"] <= 25) & (r["high"].isNull() | (r["high"] <= 30)))


def experience_points(low: Column, high: Column, years: float = P.YEARS, reject: float = P.REJECT_YEARS) -> Column:
    return (
        F.when(low.isNull(), 18.0)
        .when(low >= reject, 0.0)
        .when(high.isNotNull() & (low <= years) & (high >= years), 20.0)
        .when(high.isNull() & low.between(2, years), 20.0)
        .when(high < years, F.when(high >= years - 1, 14.0).when(high >= 3, 8.0).otherwise(5.0))
        .when(low > years, F.when(low - years <= 1, 12.0).when(low - years <= 2, 5.0).otherwise(0.0))
        .when(low < 2, 12.0)
        .otherwise(15.0)
    )


def skill_contexts(skills: list, required: Column, preferred: Column, full: Column) -> Column:
    """For each skill where it is named first: required, preferred or general, or null. Texts are normalised."""
    return F.array(*(F.when(has_any(required, aliases), "required").when(has_any(preferred, aliases), "preferred").when(has_any(full, aliases), "general") for _, aliases, _ in skills))


_SHARES = {"required": 1.0, "preferred": 0.55, "general": 0.85}  # fixed values


def skill_points(skills: list, contexts: Column) -> Column:
    """array of struct(name, points, max, context, evidence) of the matched skills."""
    rows = []
    for i, (name, _, weight) in enumerate(skills):
        share = F.lit(None).cast("double")
        for context, value in _SHARES.items():
            share = F.when(contexts[i] == context, round(value * weight, 2)).otherwise(share)
        rows.append(F.struct(F.lit(name).alias("name"), share.alias("points"), F.lit(weight).alias("max"), contexts[i].alias("context"), F.lit("demonstrated" if name in P.DEMONSTRATED else "resume_skill").alias("evidence")))
    return F.filter(F.array(*rows), lambda r: r["context"].isNotNull())


def _exact_points(skills: list, contexts: Column) -> Column:
    """The sum in thousandths, whole: 5.5 x weight / 0.1 and so on stay exact."""
    total = F.lit(0)
    for i, (_, _, weight) in enumerate(skills):
        points = F.lit(0)
        for context, value in _SHARES.items():
            points = F.when(contexts[i] == context, round(weight * value * 1000)).otherwise(points)
        total = total + points
    return total / 1000.0


def role_scores(title: Column, signals: Column) -> dict[str, Column]:
    """Points of each family. title is normalised; signals is a struct of P.SIGNALS."""
    s = {k: signals[k] for k in P.SIGNALS}
    backend = either(title.contains(x) for x in ("backend", "back end", "platform", "server"))
    full = either(title.contains(x) for x in ("full stack", "fullstack", "full-stack"))
    software = either(title.contains(x) for x in ("software engineer", "software developer", "sde", "member of technical staff", "mts"))
    script = s["typescript"] | s["javascript"]
    served = full | s["fullstack"] | s["rest_api"] | s["backend"]

    def total(most, *parts):
        points = F.lit(0.0)
        for condition, value in parts:
            points = points + F.when(condition, float(value)).otherwise(0.0)
        return F.least(points, F.lit(float(most)))

    return {
        "java_backend": total(40, (s["java"], 10), (s["spring"], 10), (s["backend"] | backend, 8), (s["rest_api"], 4), (s["microservices"], 3), (s["distributed_systems"], 3), (s["sql"], 2), (s["java"] & software & ~backend, 2)),
        "java_react_fullstack": total(40, (s["java"], 10), (s["spring"], 10), (s["react"], 8), (script, 6), (served, 6)),
        "node_backend": total(40, (s["node"], 12), (s["typescript"], 10), (s["javascript"], 5), (s["react"], 5), (s["sql"], 2), (s["backend"] | backend | s["rest_api"], 6)),
        "node_react_fullstack": total(40, (s["node"], 10), (s["typescript"], 8), (s["javascript"], 4), (s["react"], 8), (s["sql"], 2), (served, 8)),
        "software_engineering_general": total(36, (software, 10), (s["java"], 10), (script, 7), (s["distributed_systems"], 5), (s["rest_api"], 4), (s["sql"], 4)),
    }


def band(score: Column, filtered: Column) -> Column:
    return F.when(filtered, "filtered").when(score >= P.HIGH, "high").when(score >= P.GOOD, "good").when(score >= P.RELEVANT, "possible").when(score >= P.LOW, "low").otherwise("filtered")


def is_relevant(status: Column) -> Column:
    return status.isin("high", "good", "possible")


def spread(rows: DataFrame) -> DataFrame:
    """Rows dealt evenly to tasks of at most ``PART`` bytes of the files read, some for each core at least, before work that is heavy for each row.

    The splits of a scan don't say how rows are dealt: one row group is one task's, however many splits its file has, and
    after a join partitions are coalesced by bytes, not by work.
    """
    session = rows.sparkSession
    tasks = max(-(-size_of(session, rows.inputFiles()) // PART), 4 * session.sparkContext.defaultParallelism)
    return rows.repartition(tasks)


def score(postings: DataFrame) -> DataFrame:
    """Postings with the scoring columns."""
    postings = spread(postings)
    postings = postings.withColumn("_full", normalize_text(F.col("description")))
    texts = with_sections(postings, "description", {"_required": P.REQUIRED_HEADINGS, "_preferred": P.PREFERRED_HEADINGS}, "_full")
    mentions = (F.when(c.rlike("(?i)y(?:ea)?r"), experience_mentions(c)) for c in (F.col("_required"), blank(F.col("description")), F.col("_preferred")))
    texts = texts.withColumns(
        {
            "_title": normalize_text(F.col("title")),
            "_nreq": normalize_text(F.col("_required")),
            "_npref": normalize_text(F.col("_preferred")),
            "_nloc": normalize_text(F.col("location")),
            "_exp": F.coalesce(*(F.array_min(m) for m in mentions)),
        }
    )
    skills = (F.col("_nreq"), F.col("_npref"), F.col("_full"))
    both = F.trim(F.concat_ws(" ", "_title", "_full"))  # as the two texts normalise together
    texts = texts.withColumn("_both", both).withColumns(
        {
            "_signals": F.struct(*(has_any(F.col("_both"), v).alias(k) for k, v in P.SIGNALS.items())),
            "_primary": skill_contexts(P.PRIMARY_SKILLS, *skills),
            "_supporting": skill_contexts(P.SUPPORTING_SKILLS, *skills),
            "_excluded": title_excluded(F.col("_title")),
            "_foreign": plainly_foreign(F.col("_nloc")),
        }
    )
    families = role_scores(F.col("_title"), F.col("_signals"))
    ranked = F.array(*(F.struct(families[k].alias("points"), F.lit(priority).alias("priority"), F.lit(-i).alias("place"), F.lit(k).alias("family")) for i, (k, _, priority) in enumerate(P.ROLE_FAMILIES)))
    primary, supporting = F.col("_primary"), F.col("_supporting")
    scored = texts.withColumns(
        {
            "_best": F.array_max(ranked),
            "min_experience": F.col("_exp.low"),
            "max_experience": F.col("_exp.high"),
            "experience_score": experience_points(F.col("_exp.low"), F.col("_exp.high")),
            "primary_skill_score": F.least(F.lit(P.PRIMARY_CAP), F.bround(_exact_points(P.PRIMARY_SKILLS, primary), 2)),
            "supporting_score": F.least(F.lit(P.SUPPORTING_CAP), F.bround(_exact_points(P.SUPPORTING_SKILLS, supporting), 2)),
            "matched_primary": skill_points(P.PRIMARY_SKILLS, primary),
            "matched_supporting": skill_points(P.SUPPORTING_SKILLS, supporting),
            "normalized_location": coarse_location(F.col("location"), F.col("_nloc")),
        }
    )
    scored = scored.withColumns({"role_score": F.col("_best.points"), "role_family": F.when(F.col("_best.points") < 5, "other").otherwise(F.col("_best.family"))})
    total = F.least(F.lit(100.0), F.round(F.col("role_score") + F.col("experience_score") + F.col("primary_skill_score") + F.col("supporting_score"), 2))
    whole = F.col("min_experience") == F.floor("min_experience")
    reason = (
        F.when(F.col("_excluded").isNotNull(), F.col("_excluded"))
        .when(F.col("_foreign"), "location_outside_target")
        .when(F.col("min_experience") >= P.REJECT_YEARS, F.concat(F.lit("requires_"), F.when(whole, F.col("min_experience").cast("int").cast("string")).otherwise(F.col("min_experience").cast("string")), F.lit("+_years")))
        .when((F.col("role_score") < 10) & (F.col("primary_skill_score") < 5), "insufficient_target_stack_signal")
    )
    scored = scored.withColumns({"relevance_score": total, "_reason": reason})
    scored = scored.withColumns({"hard_filtered": F.col("_reason").isNotNull(), "relevance_status": band(F.col("relevance_score"), F.col("_reason").isNotNull())})
    scored = scored.withColumns({"is_relevant": is_relevant(F.col("relevance_status")), "filter_reason": F.coalesce("_reason", F.when(F.col("relevance_status") == "filtered", "relevance_score_below_threshold"))})
    return scored.drop(*(c for c in scored.columns if c.startswith("_")))


def apply_location_policy(scored: DataFrame) -> DataFrame:
    """The classified location replaces the coarse one; what isn't in the target country is filtered, whatever the reason before."""
    out = classify(scored)
    outside = F.col("location_status") != "india"
    why = F.when(F.col("location_status") == "foreign", "location_outside_target").otherwise("location_unverified_india")
    return out.withColumns(
        {
            "normalized_location": F.col("location_normalized"),
            "hard_filtered": F.col("hard_filtered") | outside,
            "is_relevant": F.col("is_relevant") & ~outside,
            "relevance_status": F.when(outside, "filtered").otherwise(F.col("relevance_status")),
            "filter_reason": F.when(outside, why).otherwise(F.col("filter_reason")),
        }
    ).drop("location_normalized", "location_country_code")


KEY = ["company_id", "external_id"]


def analyze(inventory: DataFrame, previous: DataFrame, recompute_all: bool = False) -> DataFrame:
    """The analysis of an inventory. What was analysed with the same text and rules is only relabelled.

    previous: earlier output (KEY, source_hash, change_type and scoring columns).
    """
    current = inventory.withColumn("source_hash", analysis_hash(content_hash(F.col("title"), F.col("location"), F.col("description"))))
    change = change_label(F.col("last_change_type"), F.col("old_hash"), F.col("source_hash"))
    joined = current.join(previous.select(*KEY, F.col("source_hash").alias("old_hash")), KEY, "left").withColumn("change_type", change)
    same = F.coalesce(F.col("old_hash") == F.col("source_hash"), F.lit(False)) & F.lit(not recompute_all)
    fresh = apply_location_policy(score(joined.where(~same))).withColumn("analyzed", F.lit(True))
    kept = joined.where(same).select(*KEY, "change_type").join(previous.drop("change_type"), KEY).withColumn("analyzed", F.lit(False))
    columns = [*KEY, "source_hash", "change_type", *SCORED, "analyzed"]
    return fresh.select(*columns).unionByName(kept.select(*columns))


SCORED = ["normalized_location", "role_family", "min_experience", "max_experience", "role_score", "experience_score", "primary_skill_score", "supporting_score", "relevance_score", "relevance_status", "is_relevant", "hard_filtered", "filter_reason"]


def change_label(fetch_change: Column, old_hash: Column, new_hash: Column) -> Column:
    """From the fetch's lifecycle; rule changes alone don't make a posting look changed."""
    known = F.lower(fetch_change)
    return F.when(known.isin("new", "changed", "unchanged", "baseline"), known).when(old_hash.isNull(), "baseline").when(old_hash != new_hash, "changed").otherwise("unchanged")
