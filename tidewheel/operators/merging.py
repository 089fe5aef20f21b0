"""Records of several passes or sources made one: field by field, or one laid over another."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.functions.text import blank, strip

#: Lists that grow from pass to pass. Fixed values.
LISTS = ["locations", "standardizedLocations", "locationNames"]


def ordered_union(lists: Column, order: Column) -> Column:
    """An aggregate: the elements of all lists, each once, in the order of the lists and then of each list."""
    return F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), lists.alias("v")))), lambda x: F.coalesce(x["v"], F.array().cast("array<string>")))))


def merge_passes(rows: DataFrame, key: list[str], order: str, lists: list[str] = (), texts: list[str] = (), others: list[str] = ()) -> DataFrame:
    """One row a key from its rows in ``order``: lists are united, of texts the longest stays, of other values the last.

    Null and empty texts count for nothing; of texts of one length the later one
    stays. Rows are combined in each task before the shuffle, but for lists.
    """
    o = F.col(order)
    text = lambda c: F.max_by(c, F.when(blank(F.col(c)) != "", F.struct(F.length(c), o)))
    return rows.groupBy(*key).agg(
        *(ordered_union(F.col(c), o).alias(c) for c in lists),
        *(text(c).alias(c) for c in texts),
        *(F.max_by(c, F.when(F.col(c).isNotNull(), o)).alias(c) for c in others),
        F.count("*").alias("passes"),
    )


def merge_records(rows: DataFrame, key: list[str], order: str, body: str, lists: list[str] = LISTS) -> DataFrame:
    """(key, body): the merged JSON object of each key's objects in ``order``, for records of any fields.

    The rules of :func:`merge_passes` by each value's own type: a value that isn't
    a text replaces what was there, a text replaces anything but a longer text, null and
    empty values replace nothing. The first object's fields all stay, a later one adds those that
    aren't empty. Fields come out by name; bodies that aren't objects count for nothing.
    """
    parsed = rows.select(*key, F.col(order).alias("_o"), F.try_parse_json(F.col(body)).alias("_v"))
    parsed = parsed.where(F.schema_of_variant("_v").startswith("OBJECT"))
    first = parsed.groupBy(*key).agg(F.min("_o").alias("_first"))
    fields = parsed.lateralJoin(parsed.sparkSession.tvf.variant_explode(F.col("_v").outer()).select(F.col("key").alias("_f"), F.col("value").alias("_x"))).drop("_v")
    kind = F.schema_of_variant("_x")
    fields = fields.select(*key, "_o", "_f", F.to_json("_x").alias("_json"), (kind == "STRING").alias("_text"), F.when(kind == "STRING", F.length(F.expr("cast(_x as string)"))).alias("_n"), (kind.isin("VOID") | F.to_json("_x").isin('""', "[]", "{}", "null")).alias("_empty"), F.when(kind.startswith("ARRAY"), F.expr("cast(_x as array<variant>)")).alias("_list"))
    elements = F.transform("_list", lambda v: F.to_json(v))
    fields = fields.withColumn("_list", elements).join(first, key)
    by = [*key, "_f"]
    # texts compete from the last value on that isn't one
    after = F.max(F.when(~F.col("_text") & ~F.col("_empty"), F.col("_o"))).over(Window.partitionBy(*by))
    fields = fields.withColumn("_after", after)
    late = ~F.col("_empty") & (F.col("_after").isNull() | (F.col("_o") > F.col("_after")))
    chosen = fields.groupBy(*by).agg(
        F.max_by("_json", F.when(F.col("_text") & late, F.struct("_n", "_o"))).alias("_longest"),
        F.max_by("_json", F.when(~F.col("_text") & ~F.col("_empty"), F.col("_o"))).alias("_last"),
        F.min_by("_json", F.when(F.col("_o") == F.col("_first"), F.col("_o"))).alias("_begun"),
        F.when(F.col("_f").isin(*lists) & (F.count("*") > 1), F.concat(F.lit("["), F.array_join(ordered_union(F.col("_list"), F.col("_o")), ","), F.lit("]"))).alias("_union"),
    )
    value = F.coalesce("_union", "_longest", "_last", "_begun")
    name = F.to_json(F.array("_f"))
    entry = F.when(value.isNotNull(), F.struct(F.col("_f"), F.concat(F.substring(name, 2, 1 << 30).substr(F.lit(1), F.length(name) - 2), F.lit(":"), value).alias("e")))
    return chosen.groupBy(*key).agg(F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["e"]), ","), F.lit("}")).alias("body"))


def _has(c: str) -> Column:
    return strip(blank(F.col(c))) != ""


def hydrate(rows: DataFrame, detail: DataFrame, public: DataFrame, key: list[str], wanted: Column, fields: list[str], text: str = "description") -> DataFrame:
    """Rows that lack a text, overlaid by their detail row, and the text taken from the public page as the last resort.

    detail: the key and any of ``fields``, whose filled values replace the row's;
    public: the key and the text. Both have one row a key at most, the first by all columns
    else. Only rows for which ``wanted`` holds and whose text is empty change; ``hydrated`` says whether one was found, and
    ``text_source``: position_details, public_job_page or missing; both are null for other rows.
    """
    once = lambda df: df.groupBy(*key).agg(*(F.min(c).alias(c) for c in df.columns if c not in key))
    given = [c for c in fields if c in detail.columns]
    d = once(detail.select(*key, *given)).withColumnsRenamed({c: f"_d_{c}" for c in given})
    p = once(public.select(*key, F.col(text).alias("_public")))
    held = rows.withColumn("_lacks", F.coalesce(wanted, F.lit(False)) & ~_has(text)).join(d, key, "left").join(p, key, "left")
    lacks = F.col("_lacks")
    laid = {c: F.when(lacks & _has(f"_d_{c}"), F.col(f"_d_{c}")).otherwise(F.col(c)) for c in given}
    by_detail = _has(f"_d_{text}") if text in given else F.lit(False)
    by_page = ~by_detail & _has("_public")
    laid[text] = F.when(lacks & by_page, F.col("_public")).otherwise(laid.get(text, F.col(text)))
    source = F.when(lacks, F.when(by_detail, "position_details").when(by_page, "public_job_page").otherwise("missing"))
    out = held.withColumns({**laid, "hydrated": F.when(lacks, by_detail | by_page), "text_source": source})
    return out.select(*rows.columns, "hydrated", "text_source")


def supplement_details(listed: DataFrame, jsonld: DataFrame, texts: DataFrame) -> DataFrame:
    """Listed records with their official detail pages: the first JSON-LD posting of the page, else the listing's title and the page's main text.

    listed: record_id, page_id, title, url; jsonld: as ``pages.jsonld``; texts: page_id, main. (record_id, title, location, description, job_url, posted_at, source)
    """
    posting = jsonld.groupBy("page_id").agg(F.min_by(F.struct("title", "location", "description", "posted_at"), F.struct("script", "obj")).alias("j"))
    held = listed.join(posting, "page_id", "left").join(texts.select("page_id", "main"), "page_id", "left")
    j, has = F.col("j"), F.col("j").isNotNull()
    description = F.when(has, j["description"]).otherwise(F.nullif(F.col("main"), F.lit("")))
    return held.select("record_id", F.when(has, j["title"]).otherwise(F.col("title")).alias("title"), F.when(has, j["location"]).alias("location"), description.alias("description"), F.col("url").alias("job_url"), F.when(has, j["posted_at"]).alias("posted_at"), F.when(has, "jsonld").when(description.isNotNull(), "main_text").otherwise("listing").alias("source"))


def best_attempt(attempts: DataFrame, key: list[str], mode: str = "longest") -> DataFrame:
    """Of each key's attempts (attempt, rows, ...) the one that counts: ``first`` with any rows, or the ``longest``, the earliest of equals.

    A key whose attempts are all empty keeps its first one.
    """
    if mode not in ("first", "longest"):
        raise ValueError(f"unknown mode {mode}")
    rank = F.struct((F.col("rows") == 0).alias("e"), F.when(F.lit(mode == "longest"), -F.col("rows")).otherwise(0).alias("n"), F.col("attempt").alias("a"))
    return attempts.groupBy(*key).agg(F.min_by(F.struct(*(c for c in attempts.columns if c not in key)), rank).alias("x")).select(*key, "x.*")


def overlay(sources: list[tuple[str, DataFrame]], key: list[str], fields: list[str]) -> DataFrame:
    """Each field from the first source that fills it, with ``{field}_from``; sources: (label, rows with one row a key)."""
    tagged = reduce(DataFrame.unionByName, (df.select(*key, *fields, F.lit(i).alias("_rank"), F.lit(label).alias("_label")) for i, (label, df) in enumerate(sources)))
    best = lambda what, c: F.min_by(what, F.when(blank(F.col(c).cast("string")) != "", F.col("_rank")))
    return tagged.groupBy(*key).agg(*(x for c in fields for x in (best(c, c).alias(c), best("_label", c).alias(f"{c}_from"))))
