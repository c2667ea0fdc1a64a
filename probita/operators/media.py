"""Adverse media: findings, results, news signals, regulation search, detector scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from probita import fixed_values as V
from probita.functions import text as tx
from probita.functions.scalars import alphanumeric_tokens, half_even, known
from probita.operators.skew import top_n
from probita.session import cut_lineage


def analyze_articles(articles: DataFrame, terms: list[str] | None = None) -> DataFrame:
    """One finding per article (``article_id``, ``entity_id``, ``source_url``, ``content``); the text itself is not changed."""
    flagged = tx.with_injection(articles, "content").withColumn("extracted_claims", tx.claims("content", terms))
    return flagged.select(
        F.concat(F.lit("EVD-"), F.substring(F.sha2(F.concat_ws("|", F.lit("article"), F.col("article_id").cast("string")), 256), 1, 16)).alias("evidence_id"),
        "article_id", "entity_id", "source_url", "extracted_claims",
        (F.size("categories") > 0).alias("injection_attempt_detected"), tx.injection_summary("categories").alias("injection_details"),
        F.create_map(F.lit("extraction_method"), F.lit("heuristic_keyword")).alias("metadata"))


def _best_claim() -> Column:
    return F.coalesce(F.array_max(F.transform("extracted_claims", lambda c: c["confidence"])), F.lit(0.0))


def media_results(findings: DataFrame) -> DataFrame:
    """Findings in the shared result shape, confidence on the 0-100 scale; media never confirm an identity."""
    some = F.size("extracted_claims") > 0
    return findings.select(
        F.col("evidence_id").alias("result_id"), F.col("entity_id").alias("client_id"), F.lit("adverse_media").alias("source_type"),
        F.coalesce(known("source_url"), F.lit("adverse_media")).alias("source_name"), F.lit(None).cast("string").alias("matched_entity_name"),
        half_even(_best_claim() * 100, 2).alias("match_confidence"),
        F.when(F.col("injection_attempt_detected"), "needs_review").when(~some, "no_match").otherwise("likely_match").alias("decision"),
        F.when(some, F.array(F.lit("adverse_media"))).otherwise(F.array().cast("array<string>")).alias("matched_attributes"),
        F.array("evidence_id").alias("evidence_references"))


def media_signal(findings: DataFrame) -> DataFrame:
    """Media section of a risk payload (0-1 scale). A text that carries an injection reports no news."""
    news = ~F.col("injection_attempt_detected") & (F.size("extracted_claims") > 0)
    return findings.select("entity_id", "article_id", F.struct(
        news.alias("negative_news_found"), F.when(news, _best_claim()).alias("confidence"),
        F.when(news, F.coalesce(known("source_url"), F.lit("adverse_media"))).alias("source"),
        F.when(news, F.lit(1)).alias("source_count"), "evidence_id").alias("adverse_media"))


def last_signal(findings: DataFrame) -> DataFrame:
    """The media section of each entity's last finding."""
    return media_signal(findings).groupBy("entity_id").agg(F.max_by("adverse_media", "article_id").alias("adverse_media"))


def company_news(news: DataFrame, n: int = 5) -> DataFrame:
    """Risk signal from the ``n`` newest articles per company (``company``, ``title``, ``description``, ``source``, ``published_at``, ``news_id``)."""
    newest = top_n(news, ["company"], [F.col("published_at").desc(), F.col("news_id")], n)
    text = F.lower(F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("description", F.lit(""))))
    high = tx.term_hits(text, V.NEWS_HIGH) > 0
    medium = tx.term_hits(text, V.NEWS_MEDIUM) > 0
    signals = newest.groupBy("company").agg(
        F.bool_or(high).alias("high"), F.bool_or(medium).alias("medium"), F.count(F.lit(1)).alias("source_count"),
        F.min_by(F.coalesce(known("source"), F.lit("Unknown source")), "rank").alias("source"))
    severity = F.when(F.col("high"), "HIGH").when(F.col("medium"), "MEDIUM").otherwise("LOW")
    return signals.select("company", (F.col("source_count") > 0).alias("negative_news_found"), severity.alias("severity"), "source", "source_count",
                          F.lit(0.72).alias("confidence"), F.col("high").alias("mentions_sanctions"))


def headlines(feed: DataFrame) -> DataFrame:
    title = F.coalesce("title", F.lit("Unknown Title"))
    return feed.withColumns({"title": title, "source_id": F.concat(F.lit("LiveNews:"), F.substring(title, 1, 40), F.lit("..."))})


def first_texts(regulation: DataFrame) -> DataFrame:
    """The first paragraph of each distinct text."""
    columns = [c for c in regulation.columns if c != "position"]
    digest = F.sha2("article_text", 256)
    return regulation.groupBy(digest.alias("_digest")).agg(F.min(F.struct("position", *columns)).alias("r")).select("r.*")


#: Paragraphs that a query's rarest words may bring in first, for each one it wants, and how many of them are scored in full.
SEEDS, SEEDS_SCORED = 64, 4


def _share(words: Column, of: Column) -> Column:
    return F.floor(words / of * 100).cast("int")


def search_regulation(queries: DataFrame, regulation: DataFrame, n: int = 5) -> DataFrame:
    """Best paragraphs per query (``query_id``, ``query``) by the share of its words they hold; ties go to the first position.

    Postings are read from the rarest word on. The paragraphs of a few rare words are scored first, and the ``n``-th best of them is a
    score that results must reach. A paragraph that holds none of a query's m rarest words shares at most the others, so only as many
    words are looked up as it takes for that to be too few; common words are read just for the paragraphs found, and those only
    where what they still may share is enough. Nothing that could be a result is passed over.
    """
    asked = cut_lineage(queries.select("query_id", alphanumeric_tokens("query").alias("_asked")).where(F.size("_asked") > 0))
    blob = F.concat_ws(" ", "article_title", "article_text", "article_recitals")
    paragraphs = cut_lineage(first_texts(regulation).select("position", "article_id", "article_title", alphanumeric_tokens(blob).alias("_held")))
    filed = paragraphs.select("position", F.explode("_held").alias("_word"))
    sizes = filed.groupBy("_word").agg(F.count(F.lit(1)).alias("_rows"))
    rarest = Window.partitionBy("query_id").orderBy("_rows", "_word")  # a query's own words
    said = asked.select("query_id", F.size("_asked").alias("_n"), F.explode("_asked").alias("_word")).join(sizes, "_word")
    words = cut_lineage(said.withColumns({
        "_place": F.row_number().over(rarest), "_sum": F.sum("_rows").over(rarest.rowsBetween(Window.unboundedPreceding, 0)),
        "_words": F.count(F.lit(1)).over(Window.partitionBy("query_id"))}))

    def scored(pairs: DataFrame) -> DataFrame:
        full = pairs.select("query_id", "position").join(asked, "query_id").join(paragraphs.select("position", "_held"), "position")
        return full.select("query_id", "position", _share(F.size(F.array_intersect("_asked", "_held")), F.size("_asked")).alias("score")).where("score > 0")

    seeds = filed.join(words.where((F.col("_place") == 1) | (F.col("_sum") <= SEEDS * n)).select("query_id", "_word"), "_word")
    likely = top_n(seeds.groupBy("query_id", "position").agg(F.count(F.lit(1)).alias("_shared")), ["query_id"], [F.col("_shared").desc(), F.col("position")], SEEDS_SCORED * n)
    order = [F.col("score").desc(), F.col("position")]
    least = top_n(scored(likely), ["query_id"], order, n).where(F.col("rank") == n).select("query_id", F.col("score").alias("_least"))
    reach = F.greatest(F.coalesce("_least", F.lit(1)), F.lit(1))
    # The words before and with which the rest could still make a result.
    needed = words.join(least, "query_id", "left").withColumn("_least", reach).where(_share(F.col("_words") - F.col("_place") + 1, F.col("_n")) >= F.col("_least"))
    lists = needed.groupBy("query_id").agg(F.count(F.lit(1)).alias("_read"))
    met = filed.join(needed.select("query_id", "_word"), "_word").groupBy("query_id", "position").agg(F.count(F.lit(1)).alias("_shared"))
    bounds = words.where("_place = 1").select("query_id", "_n", "_words").join(lists, "query_id").join(least, "query_id", "left").withColumn("_least", reach)
    open_ = met.join(bounds, "query_id").where(_share(F.col("_shared") + F.col("_words") - F.col("_read"), F.col("_n")) >= F.col("_least"))
    best = top_n(scored(open_), ["query_id"], order, n)
    return best.join(paragraphs.select("position", "article_id", "article_title"), "position")


def detector_scores(predictions: DataFrame) -> DataFrame:
    """Confusion counts, precision and recall of boolean ``predicted`` against ``actual``."""
    p, a = F.col("predicted"), F.col("actual")
    counts = predictions.agg(
        F.count_if(p & a).alias("caught"), F.count_if(a).alias("positives"), F.count_if(p & ~a).alias("false_alarms"), F.count_if(~a).alias("negatives"))
    return counts.select("*", half_even(F.col("caught") / F.nullif(F.col("caught") + F.col("false_alarms"), F.lit(0)), 6).alias("precision"),
                         half_even(F.col("caught") / F.nullif(F.col("positives"), F.lit(0)), 6).alias("recall"))
