"""Screening of customers against watch-lists: blocking, component scores, ranking, results.

A query and an entry are compared only when they share a blocking key. The comparison is exact:
nothing is sampled or capped before the final top-n, which is part of the operator.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from probita import fixed_values as V
from probita.functions import scalars as S
from probita.functions import similarity as sim
from probita.operators.skew import skew_join, top_n
from probita.session import cut_lineage, scratch_path

QUERY_FIELDS = ["name", "dob", "nationality", "company", "context"]
ENTRY_FIELDS = ["row_id", "entity_id", "name", "aliases", "dob", "nationality", "company", "source_list", "context"]
VECTOR = "context_vector"
PARTS = list(V.MATCH_WEIGHTS)


def with_defaults(queries: DataFrame) -> DataFrame:
    """Adds the optional query columns as NULL where they are missing."""
    missing = {c: F.lit(None).cast("string") for c in [*QUERY_FIELDS, "evidence_id"] if c not in queries.columns}
    return queries.withColumns(missing) if missing else queries


def profiles(queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct query profiles, and the queries with the id of theirs.

    Customers with the same name and attributes are screened once, however many there are.
    """
    queries = with_defaults(queries)
    fields = [*QUERY_FIELDS, *([VECTOR] if VECTOR in queries.columns else [])]
    keyed = queries.withColumn("profile_id", F.sha2(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}), 256))
    distinct = keyed.groupBy("profile_id").agg(*[F.first(f).alias(f) for f in fields])
    return distinct, keyed.select("profile_id", "entity_id", "evidence_id")


PAIR_SHARE, PAIR_FLOOR = 20_000, 2_000  # a pair join's work is a product, so keys are split sooner


def _prepare(df: DataFrame, side: str) -> DataFrame:
    """Columns of one side under its prefix, with everything a comparison needs made once per row."""
    made = {}
    for name in ("name", "company", "context"):
        made.update(sim.prepared(f"{side}_", name, name))
    if "aliases" in df.columns:
        made.update(sim.prepared_aliases(f"{side}_", "aliases"))
    made.update({f"{side}_born": S.birth_date("dob"), f"{side}_dob_text": F.lower(S.strip(S.known("dob"))),
                 f"{side}_code": S.country_code("nationality")})
    kept = [c for c in df.columns if c not in ("company", "context", "dob", "nationality", "aliases")]
    return df.select(*[F.col(c).alias(f"{side}_{c}") for c in kept], *[v.alias(k) for k, v in made.items()],
                     (S.query_keys("name") if side == "q" else S.index_keys("name", "aliases")).alias(f"{side}_keys"))


def blocking_pairs(left: DataFrame, entries: DataFrame, **skew) -> DataFrame:
    """Every (profile, entry) pair that shares a key, once.

    Both sides carry their key lists; a pair that shares several keys is kept at the smallest one
    only, so no later shuffle is needed to remove repeats.
    """
    asked = _prepare(left, "q").withColumn("block", F.explode("q_keys"))
    filed = _prepare(entries, "w").withColumn("block", F.explode("w_keys"))
    options = {"share": PAIR_SHARE, "floor": PAIR_FLOOR, **skew}
    pairs = skew_join(asked, filed, ["block"], both=True, spread=True, **options)
    return pairs.where(F.col("block") == F.array_min(F.array_intersect("q_keys", "w_keys"))).drop("block", "q_keys", "w_keys")


def candidate_counts(left: DataFrame, entries: DataFrame) -> DataFrame:
    """How many entries each profile is compared with, without forming the pairs.

    Profiles and entries are grouped by their key lists first; only the groups are joined.
    """
    asked = left.select("profile_id", S.query_keys("name").alias("_qk"))
    groups = asked.select("_qk").distinct()
    filed = entries.select(S.index_keys("name", "aliases").alias("_wk")).groupBy("_wk").agg(F.count(F.lit(1)).alias("n"))
    met = groups.withColumn("block", F.explode("_qk")).join(filed.withColumn("block", F.explode("_wk")), "block")
    met = met.where(F.col("block") == F.array_min(F.array_intersect("_qk", "_wk")))
    counts = met.groupBy("_qk").agg(F.sum("n").alias("candidates_scored"))
    return skew_join(asked, counts, ["_qk"], how="left").select(
        "profile_id", F.coalesce("candidates_scored", F.lit(0)).alias("candidates_scored"))


def weighted(parts: dict[str, Column]) -> Column:
    total = None
    for name in PARTS:
        term = F.lit(V.MATCH_WEIGHTS[name]) * parts[name]
        total = term if total is None else total + term
    return total


def weighted_score(parts: dict[str, Column]) -> Column:
    return S.half_even(weighted(parts), 4)


def _rounded_score(name: str) -> Column:
    """``half_even`` of a column to four digits; its exact test, which no generated code holds, runs near the half only."""
    scaled = F.col(name) * 1e4
    near = F.abs(scaled - F.floor(scaled) - 0.5) < 1e-3
    return F.when(near, S.half_even(F.col(name), 4)).otherwise(F.rint(scaled) / 1e4)


def classify(score: Column) -> Column:
    return (F.when(score >= V.CONFIRMED_THRESHOLD, "CONFIRMED_MATCH").when(score >= V.POSSIBLE_THRESHOLD, "POSSIBLE_MATCH")
            .otherwise("LIKELY_FALSE_POSITIVE"))


def _column(name: str) -> dict[str, Column]:
    return {part: F.col(f"s_{part}") for part in PARTS} | ({} if not name else {"context": F.lit(V.UNKNOWN_CONTEXT)})


def _missing(name: str) -> Column:
    return F.col(f"q_{name}_low").isNull() | F.col(f"w_{name}_low").isNull()


def _vectors(pairs: DataFrame) -> Column | None:
    if f"q_{VECTOR}" in pairs.columns and f"w_{VECTOR}" in pairs.columns:
        return sim.vector_similarity(f"q_{VECTOR}", f"w_{VECTOR}")
    return None


def _context(pairs: DataFrame) -> Column:
    """Vector cosine where both sides have a vector, else text similarity, else the unknown value."""
    text = F.when(_missing("context"), F.lit(V.UNKNOWN_CONTEXT)).otherwise(sim.prepared_similarity("q_context", "w_context"))
    cosine = _vectors(pairs)
    return text if cosine is None else F.when(_missing("context"), text).otherwise(F.coalesce(cosine, text))


def _dob_score() -> Column:
    return (F.when(F.col("q_dob_text").isNull() | F.col("w_dob_text").isNull(), F.lit(V.UNKNOWN_ATTRIBUTE))
            .when(F.col("q_born").isNull() | F.col("w_born").isNull(), (F.col("q_dob_text") == F.col("w_dob_text")).cast("double"))
            .otherwise(S.dates_agree(F.col("q_born"), F.col("w_born")).cast("double")))


def _nationality_score() -> Column:
    return F.when(F.col("q_code").isNull() | F.col("w_code").isNull(), F.lit(V.UNKNOWN_ATTRIBUTE)).otherwise((F.col("q_code") == F.col("w_code")).cast("double"))


def _attribute_scores(pairs: DataFrame) -> DataFrame:
    """Scores that need no similarity function."""
    return pairs.withColumns({"s_dob": _dob_score(), "s_nationality": _nationality_score()})


def _text_scores(pairs: DataFrame) -> DataFrame:
    company = F.when(_missing("company"), F.lit(V.UNKNOWN_ATTRIBUTE)).otherwise(sim.prepared_similarity("q_company", "w_company"))
    return pairs.withColumns({
        "s_name": sim.prepared_similarity("q_name", "w_name"),
        "s_alias": sim.prepared_alias_similarity("q_name", "w_aliases"),
        "s_company": company,
    })


def component_scores(pairs: DataFrame) -> DataFrame:
    """All six scores of every pair; context is compared only where it can change the class. Texts of ``every_pair`` have their scores already."""
    known = "s_context_text" in pairs.columns
    scored = _attribute_scores(pairs) if known else _text_scores(_attribute_scores(pairs))
    best = F.col("_best") - F.lit(V.MATCH_WEIGHTS["context"] * V.UNKNOWN_CONTEXT) + F.lit(V.MATCH_WEIGHTS["context"])
    scored = scored.withColumn("_best", weighted(_column("bound"))).withColumn("_best", _rounded_score("_best"))
    gated = scored.withColumn("_open", best >= V.POSSIBLE_THRESHOLD).drop("_best")
    if known:
        return gated.withColumn("s_context", F.when(F.col("_open"), F.col("s_context_text")).otherwise(F.lit(V.UNKNOWN_CONTEXT))).drop("s_context_text")
    # A pair that stays closed sends NULLs to the comparison, which costs next to nothing.
    forms = [f"{side}_context_{form}" for side in "qw" for form in ("low", "words")]
    gated = gated.withColumns({form: F.when(F.col("_open"), F.col(form)) for form in forms})
    return gated.withColumn("s_context", _context(gated))


def evaluate(pairs: DataFrame) -> DataFrame:
    """Score and class of every pair."""
    scored = component_scores(pairs).withColumn("match_score", weighted(_column(""))).withColumn("match_score", _rounded_score("match_score"))
    return scored.withColumn("classification", classify(F.col("match_score")))


@dataclass(frozen=True)
class PreparedList:
    """A watch-list as screening reads it: its entries with everything a comparison needs, its distinct names with their keys, and its classes."""

    entries: DataFrame
    names: DataFrame
    classes: DataFrame


def _hashed(columns: list[str]) -> Column:
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def _class_columns(filed: DataFrame) -> list[str]:
    """What the scores of an entry depend on; its names are all in ``w_listed``."""
    texts = [f"w_{part}_{form}" for part in ("company", "context") for form in ("low", "words")]
    return ["w_listed", "w_born", "w_dob_text", "w_code", *texts, *([f"w_{VECTOR}"] if f"w_{VECTOR}" in filed.columns else [])]


def _filed(watchlist: DataFrame) -> DataFrame:
    entries = watchlist.select(*ENTRY_FIELDS, *([VECTOR] if VECTOR in watchlist.columns else []))
    n = int(watchlist.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    filed = _prepare(entries.repartition(n, "row_id"), "w").withColumn("w_listed", _hashed(["w_name", "w_aliases_low", "w_keys"]))
    return filed.withColumn("w_class", _hashed(_class_columns(filed)))


def _classes(filed: DataFrame) -> DataFrame:
    """Groups of entries that every query scores alike, with their sizes."""
    return filed.groupBy("w_class").agg(F.count(F.lit(1)).alias("_n"), *[F.first(c).alias(c) for c in _class_columns(filed)])


def _listed(filed: DataFrame) -> DataFrame:
    return filed.groupBy("w_listed").agg(*[F.first(c).alias(c) for c in ("w_name_low", "w_name_words", "w_aliases_low", "w_aliases_words", "w_keys")])


def prepared_list(watchlist: DataFrame) -> PreparedList:
    """``watchlist`` prepared once and written to the shared folder, for many screenings; those read these tables and never the list itself."""
    spark, path = watchlist.sparkSession, scratch_path(watchlist.sparkSession, "watchlist")
    _filed(watchlist).write.parquet(f"{path}/entries")
    entries = spark.read.parquet(f"{path}/entries")
    _listed(entries).write.parquet(f"{path}/names")
    _classes(entries).write.parquet(f"{path}/classes")
    return PreparedList(entries, spark.read.parquet(f"{path}/names"), spark.read.parquet(f"{path}/classes"))


def name_pairs(asked: DataFrame, listed: DataFrame, **skew) -> DataFrame:
    """Pairs of a query name and a group of equal names and aliases that share a key, with their scores.

    Keys and name scores depend on these texts only, so they are found once however many profiles or entries have them.
    A pair that shares several keys is kept at the smallest one.
    """
    names = asked.groupBy("q_name").agg(*[F.first(c).alias(c) for c in ("q_name_low", "q_name_words", "q_keys")])
    options = {"share": PAIR_SHARE, "floor": PAIR_FLOOR, **skew}
    met = skew_join(names.withColumn("block", F.explode("q_keys")), listed.withColumn("block", F.explode("w_keys")), ["block"], both=True, spread=True, **options)
    once = met.where(F.col("block") == F.array_min(F.array_intersect("q_keys", "w_keys")))
    return once.select("q_name", "w_listed", sim.prepared_similarity("q_name", "w_name").alias("s_name"), sim.prepared_alias_similarity("q_name", "w_aliases").alias("s_alias"))


def _named_sides(queries: DataFrame, watchlist: DataFrame, **skew) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Queries with their profile, profiles and entries prepared, and the name pairs: written once, as ``screen`` does."""
    distinct, keyed = profiles(queries)
    n = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asked = cut_lineage(_prepare(distinct.repartition(n, "profile_id"), "q"))
    filed = cut_lineage(_filed(watchlist))
    return keyed, asked, filed, cut_lineage(name_pairs(asked, _listed(filed), **skew))


def name_scores(queries: DataFrame, watchlist: DataFrame, worth: Column, **skew) -> DataFrame:
    """``entity_id``, ``row_id``, ``s_name`` and ``s_alias`` of every pair of a query and an entry that share a key and whose scores are ``worth`` it."""
    keyed, asked, filed, named = _named_sides(queries, watchlist, **skew)
    owners = keyed.select("profile_id", "entity_id").join(asked.select(F.col("q_profile_id").alias("profile_id"), "q_name"), "profile_id")
    left = named.where(worth).join(owners, "q_name").select("entity_id", "w_listed", "s_name", "s_alias")
    options = {"share": PAIR_SHARE, "floor": PAIR_FLOOR, **skew}
    return skew_join(left, filed.select("w_listed", F.col("w_row_id").alias("row_id")), ["w_listed"], both=True, spread=True, **options).drop("w_listed")


def every_pair(queries: DataFrame, watchlist: DataFrame, **skew) -> tuple[DataFrame, DataFrame]:
    """Every pair of a profile and a class of ``w_n`` entries that share a key, for ``component_scores`` and ``evaluate``; and the queries with their profile.

    Each different pair of texts is compared once and its score joined, so what is left of a pair is arithmetic on a few
    columns. No pair is left out: their number is that of the profiles times the classes that share a key with them.
    """
    keyed, asked, filed, named = _named_sides(queries, watchlist, **skew)
    return paired(named, asked, cut_lineage(_classes(filed).withColumnRenamed("_n", "w_n")), **skew), keyed


def paired(named: DataFrame, asked: DataFrame, classes: DataFrame, **skew) -> DataFrame:
    """A row for each pair of a profile of ``asked`` and one of ``classes`` under ``named``, as ``every_pair`` describes it."""
    texts = {}
    for part in ("company", "context"):
        sides = [side.select(key, f"{p}_{part}_low", f"{p}_{part}_words").distinct() for side, key, p in ((asked, "q_name", "q"), (classes, "w_listed", "w"))]
        texts[part] = _written_texts(named.join(sides[0], "q_name").join(sides[1], "w_listed"), part)
    vectors = f"q_{VECTOR}" in asked.columns and f"w_{VECTOR}" in classes.columns
    used = ["born", "dob_text", "code", "company_low", "context_low", *([VECTOR] if vectors else [])]
    left = named.join(asked.select("q_profile_id", "q_name", *[f"q_{c}" for c in used]), "q_name").drop("q_name")
    options = {"share": PAIR_SHARE, "floor": PAIR_FLOOR, **skew}
    met = skew_join(left, classes.select("w_listed", "w_class", "w_n", *[f"w_{c}" for c in used]), ["w_listed"], both=True, spread=True, **options)
    met = _with_score(met, texts["company"], "company", V.UNKNOWN_ATTRIBUTE)
    met = _with_score(met, texts["context"], "context", V.UNKNOWN_CONTEXT).withColumnRenamed("s_context", "s_context_text")
    if vectors:
        met = met.withColumn("s_context_text", F.when(_missing("context"), F.col("s_context_text")).otherwise(F.coalesce(_vectors(met), F.col("s_context_text"))))
    return met.drop("w_listed")


def _groups(named: DataFrame, asked: DataFrame, filed: DataFrame, part: str, unknown: float) -> DataFrame:
    """Pairs of (name, text) groups that can still reach the threshold, by name scores and text lengths, everything else at its best."""
    sides = [side.select(key, f"{p}_{part}_low", f"{p}_{part}_words").distinct() for side, key, p in ((asked, "q_name", "q"), (filed, "w_listed", "w"))]
    most = F.when(_missing(part), F.lit(unknown)).otherwise(sim.prepared_bound(f"q_{part}", f"w_{part}"))
    rest = sum(w for p, w in V.MATCH_WEIGHTS.items() if p not in ("name", "alias", part))
    met = named.join(sides[0], "q_name").join(sides[1], "w_listed")
    return met.where(F.col("_base") + V.MATCH_WEIGHTS[part] * most + rest >= V.POSSIBLE_THRESHOLD - SLACK)


def _written_texts(groups: DataFrame, part: str) -> DataFrame:
    """Similarity of each different pair of texts of ``groups`` that are both there: compared once and written down."""
    keys = [f"q_{part}_low", f"w_{part}_low"]
    found = groups.where(~_missing(part)).select(*keys, f"q_{part}_words", f"w_{part}_words").distinct()
    path = scratch_path(groups.sparkSession, "texts")
    found.select(*keys, sim.prepared_similarity(f"q_{part}", f"w_{part}").alias(f"s_{part}")).write.parquet(path)
    return groups.sparkSession.read.parquet(path)


def _with_score(pairs: DataFrame, scores: DataFrame, part: str, unknown: float) -> DataFrame:
    joined = pairs.join(scores, [f"q_{part}_low", f"w_{part}_low"], "left")
    return joined.withColumn(f"s_{part}", F.when(_missing(part), F.lit(unknown)).otherwise(F.coalesce(f"s_{part}", F.lit(0.0))))


SLACK = 1e-4  # more than rounding to four digits can add


def _met(left: DataFrame, keyed: DataFrame, right: DataFrame, n: int, on: list[str] = (), worth: Column | None = None) -> DataFrame:
    """Profiles and classes that meet under groups of name and context that are ``worth`` it, and on ``on`` where both may be missing.

    Few rows make many here, so they are dealt to all partitions of the session whatever their size.
    """
    near = left.join(keyed, ["q_name", "_q_context"])
    near = (near if worth is None else near.where(worth)).repartition(n)
    same = [F.col(f"q_{c}").eqNullSafe(F.col(f"w_{c}")) for c in on]
    renamed = right.withColumnsRenamed({"w_listed": "_listed", "_w_context": "_wc"})
    both = (F.col("w_listed") == F.col("_listed")) & (F.col("_w_context") == F.col("_wc"))
    return near.join(renamed, reduce(and_, same, both)).drop("_listed", "_wc")


def _floors(scored: DataFrame, limit: int) -> DataFrame:
    """Per profile the greatest score that ``limit`` entries of ``scored`` classes reach, where so many do."""
    better = Window.partitionBy("q_profile_id").orderBy(F.col("_total").desc(), "w_class")
    filled = scored.select("q_profile_id", "w_class", "_total", F.sum("_n").over(better).alias("_filled"))
    return filled.where(F.col("_filled") >= limit).groupBy("q_profile_id").agg(F.max("_total").alias("_floor"))


def possible_pairs(named: DataFrame, asked: DataFrame, filed: DataFrame, limit: int | None = None) -> DataFrame:
    """Scores of the (profile, class) pairs that reach the lower threshold, the same values as ``evaluate``; with ``limit`` those that can be among a profile's first ``limit`` entries.

    A floor for each profile comes from a part of its pairs: the classes under its best group that agree with it on date and country, or on
    country alone where those are too few. It is a score that ``limit`` entries reach, so no pair below it is needed; the bound of the main join takes it in.

    Texts are compared before profiles and entries meet, between groups of equal (name, text): each different pair of
    texts once, and none whose group cannot reach the threshold whatever the other parts are. Groups with contexts, their
    scores known, are then what profiles and entries meet under, on name and context; the bound over dates, countries and
    company lengths is a condition of that join, so a pair that cannot reach the threshold is never a row.
    """
    weights = V.MATCH_WEIGHTS
    named = named.withColumn("_base", weights["name"] * F.col("s_name") + weights["alias"] * F.col("s_alias"))
    companies = _written_texts(_groups(named, asked, filed, "company", V.UNKNOWN_ATTRIBUTE), "company")
    groups = _groups(named, asked, filed, "context", V.UNKNOWN_CONTEXT)
    vectors = f"q_{VECTOR}" in asked.columns and f"w_{VECTOR}" in filed.columns
    rest = weights["dob"] + weights["nationality"] + weights["company"]
    if vectors:  # the cosine is not known before the pair is: two contexts may be as good as equal
        groups = groups.withColumn("s_context", F.when(_missing("context"), F.lit(V.UNKNOWN_CONTEXT)).otherwise(F.lit(1.0)))
    else:
        groups = _with_score(groups, _written_texts(groups, "context"), "context", V.UNKNOWN_CONTEXT)
    open_ = groups.where(F.col("_base") + weights["context"] * F.col("s_context") + rest >= V.POSSIBLE_THRESHOLD - SLACK)
    keyed = cut_lineage(open_.select("q_name", "w_listed", "s_name", "s_alias", F.col("s_context").alias("_context_most"), *[F.coalesce(f"{p}_context_low", F.lit("")).alias(f"_{p}_context") for p in "qw"]))
    dropped = ["name_low", "name_words", "keys", "aliases_low", "aliases_words", "company_words", *([] if vectors else ["context_low", "context_words"])]
    left, right = (side.withColumn(f"_{p}_context", F.coalesce(f"{p}_context_low", F.lit(""))).withColumns({f"_{p}_{form}": F.length(f"{p}_company_{form}") for form in ("low", "words")}).drop(
        *[f"{p}_{c}" for c in dropped]) for side, p in ((asked, "q"), (filed, "w")))
    n = int(named.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sizes = [F.least(f"_q_{form}", f"_w_{form}") * 2.0 / F.greatest(F.col(f"_q_{form}") + F.col(f"_w_{form}"), F.lit(1)) for form in ("low", "words")]
    wordless = (F.col("_q_words") == 0) & (F.col("_w_words") == 0)
    company = F.when(F.col("_q_low").isNull() | F.col("_w_low").isNull(), F.lit(V.UNKNOWN_ATTRIBUTE)).otherwise(F.when(wordless, F.lit(1.0)).otherwise(F.greatest(*sizes)))
    most = weighted({"name": F.col("s_name"), "alias": F.col("s_alias"), "dob": _dob_score(), "nationality": _nationality_score(), "company": company, "context": F.col("_context_most")})

    def scored(met: DataFrame, least: Column) -> DataFrame:
        likely = _attribute_scores(met.where(most >= least - SLACK))
        found = _with_score(likely, companies, "company", V.UNKNOWN_ATTRIBUTE)
        if vectors:
            reach = weighted(_column("") | {"context": F.col("_context_most")})
            found = found.where(reach >= least - SLACK).withColumn("s_context", _context(found))
        else:
            found = found.withColumnRenamed("_context_most", "s_context")
        return found.withColumn("_total", weighted(_column(""))).where(F.col("_total") >= least - SLACK)

    least, worth = F.lit(V.POSSIBLE_THRESHOLD), None
    if limit is not None:
        group = sum(weights[part] * F.col(score) for part, score in (("name", "s_name"), ("alias", "s_alias"), ("context", "_context_most")))
        first = keyed.groupBy("q_name", "_q_context").agg(F.max_by(F.struct("w_listed", "_w_context"), F.struct(group, "w_listed", "_w_context")).alias("_best"))
        nearest = keyed.join(first.select("q_name", "_q_context", "_best.*"), ["q_name", "_q_context", "w_listed", "_w_context"])
        floors = cut_lineage(_floors(scored(_met(left, nearest, right, n, ["code", "dob_text"]), least), limit))
        rest = left.join(floors.select("q_profile_id"), "q_profile_id", "left_anti")
        floors = floors.unionByName(cut_lineage(_floors(scored(_met(rest, nearest, right, n, ["code"]), least), limit)))
        left = left.join(floors, "q_profile_id", "left").withColumn("_floor", F.greatest(least, F.coalesce(F.col("_floor") - SLACK, least)))
        least = F.col("_floor")
        rest = sum(weights[part] * F.when(F.col(column).isNull(), unknown).otherwise(1.0) for part, column, unknown in (
            ("dob", "q_dob_text", V.UNKNOWN_ATTRIBUTE), ("nationality", "q_code", V.UNKNOWN_ATTRIBUTE), ("company", "q_company_low", V.UNKNOWN_ATTRIBUTE)))
        worth = group + rest >= least - SLACK
    reached = scored(_met(left, keyed, right, n, worth=worth), least)
    reached = reached.withColumn("match_score", _rounded_score("_total")).drop("_total")
    return reached.where(F.col("match_score") >= V.POSSIBLE_THRESHOLD).withColumn("classification", classify(F.col("match_score")))


def _counted(named: DataFrame, filed: DataFrame) -> DataFrame:
    """How many entries each query name is compared with, from the same pairs."""
    sizes = filed.groupBy("w_listed").agg(F.count(F.lit(1)).alias("_n"))
    return named.select("q_name", "w_listed").join(sizes, "w_listed").groupBy("q_name").agg(F.sum("_n").alias("candidates_scored"))


RESULT = ["row_id", "matched_against", "candidate_name", "source", "match_score", "classification", *[f"s_{p}" for p in PARTS]]


def _first_entries(pairs: DataFrame, filed: DataFrame, limit: int | None) -> DataFrame:
    """Entries of the classes in ``pairs``, in the order of a result: the first ``limit`` of each profile, or all.

    A class that ``limit`` entries go before is dropped, and of the others only as many members are read as there is room for.
    """
    slim = pairs.select(F.col("q_profile_id").alias("profile_id"), "w_class", "match_score", "classification", *[f"s_{p}" for p in PARTS], "_n")
    texts = filed.select("w_class", F.col("w_row_id").alias("row_id"), F.col("w_entity_id").alias("matched_against"), F.col("w_name").alias("candidate_name"), F.col("w_source_list").alias("source"))
    if limit is None:
        return slim.drop("_n").join(texts, "w_class").select("profile_id", *RESULT)
    upto = Window.partitionBy("profile_id").orderBy(F.col("match_score").desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    equal = Window.partitionBy("profile_id", "match_score")
    before = F.sum("_n").over(upto) - F.sum("_n").over(equal)
    kept = slim.withColumn("_before", before).where(F.col("_before") < limit).drop("_n")
    order = [F.col("matched_against"), F.col("row_id")]
    firsts = top_n(texts, ["w_class"], order, limit, "_at").groupBy("w_class").agg(
        F.array_sort(F.collect_list(F.struct("_at", "row_id", "matched_against", "candidate_name", "source"))).alias("_firsts"))
    met = kept.join(firsts, "w_class").withColumn("_first", F.explode(F.slice("_firsts", F.lit(1), (F.lit(limit) - F.col("_before")).cast("int"))))
    found = met.select("profile_id", "_first.*", "match_score", "classification", *[f"s_{p}" for p in PARTS]).select("profile_id", *RESULT)
    return top_n(found, ["profile_id"], [F.col("match_score").desc(), *order], limit)


def screen(queries: DataFrame, watchlist: DataFrame | PreparedList, limit: int | None = V.MATCH_LIMIT, **skew) -> DataFrame:
    """Best matches of every query, with component scores and the number of entries compared. A list that is screened often is prepared once (``prepared_list``)."""
    distinct, keyed = profiles(queries)
    # Prepared once and written down: they are read for the names, for the pairs and for the counts.
    # Few bytes make much work here, so the rows are dealt to all partitions of the session whatever their size.
    n = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asked = cut_lineage(_prepare(distinct.repartition(n, "profile_id"), "q"))
    kept = isinstance(watchlist, PreparedList)
    filed = watchlist.entries if kept else cut_lineage(_filed(watchlist))
    named = cut_lineage(name_pairs(asked, watchlist.names if kept else _listed(filed), **skew))
    classes = watchlist.classes if kept else cut_lineage(_classes(filed))
    found = _first_entries(possible_pairs(named, asked, classes, limit), filed, limit)
    counts = asked.select(F.col("q_profile_id").alias("profile_id"), "q_name").join(_counted(named, filed), "q_name").drop("q_name")
    return keyed.join(found.join(counts, "profile_id"), "profile_id").drop("profile_id")


def with_evidence_ids(matches: DataFrame) -> DataFrame:
    """An id per match that any number of writers can make: the caller's, else one derived from the pair."""
    made = F.concat(F.lit("EVD-"), F.substring(F.sha2(F.concat_ws("|", "entity_id", "row_id"), 256), 1, 16))
    return matches.withColumn("evidence_id", F.coalesce(S.known("evidence_id"), made))


def decision(score: Column, parts: dict[str, Column]) -> Column:
    """Confirmed only when something besides the name agrees."""
    other = F.greatest(parts["dob"], parts["nationality"], parts["company"], parts["context"])
    return (F.when((score >= V.CONFIRMED_THRESHOLD) & (other >= V.CORROBORATION_FLOOR), "confirmed_match")
            .when(score >= V.CONFIRMED_THRESHOLD, "needs_review")
            .when(score >= V.POSSIBLE_THRESHOLD, "likely_match").otherwise("likely_false_positive"))


def matched_attributes(parts: dict[str, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(parts[p] >= V.CORROBORATION_FLOOR, F.lit(p)) for p in PARTS]))


def source_type(source: Column) -> Column:
    text = F.lower(source)
    return F.when(F.contains(text, F.lit("ofac")) | F.contains(text, F.lit("sanction")), "sanctions").otherwise("watchlist")


def source_for_risk(source: Column) -> Column:
    """Source as the risk score names it; fixtures keep their mark and so earn no bonus."""
    text = F.lower(S.strip(source))
    return (F.when(F.contains(text, F.lit(V.FIXTURE_SUFFIX.strip().lower())), text).when(F.contains(text, F.lit("ofac")), "ofac sdn")
            .when(F.contains(text, F.lit("opensanction")), "opensanctions").otherwise(text))


def intelligence_results(matches: DataFrame) -> DataFrame:
    """Matches in the shared result shape; confidence is on the 0-100 scale here."""
    parts = {p: F.col(f"s_{p}") for p in PARTS}
    return matches.select(
        F.col("evidence_id").alias("result_id"), F.col("entity_id").alias("client_id"), source_type(F.col("source")).alias("source_type"),
        S.strip("source").alias("source_name"), F.col("candidate_name").alias("matched_entity_name"),
        S.half_even(F.col("match_score") * 100, 2).alias("match_confidence"), decision(F.col("match_score"), parts).alias("decision"),
        matched_attributes(parts).alias("matched_attributes"), F.array("evidence_id").alias("evidence_references"))


def sanctions_signal(matches: DataFrame, relationship: str | None = None) -> DataFrame:
    """Sanctions section of a risk payload, confidence on the 0-1 scale."""
    return matches.select("entity_id", F.struct(
        F.col("classification").isin("CONFIRMED_MATCH", "POSSIBLE_MATCH").alias("has_match"),
        F.lit(None).cast("boolean").alias("confirmed"), F.col("match_score").alias("match_confidence"),
        F.lit(relationship.strip().lower() if relationship else None).cast("string").alias("relationship"),
        source_for_risk(F.col("source")).alias("source"), "evidence_id", F.col("candidate_name").alias("matched_entity"),
        F.lit(None).cast("string").alias("kyc_evidence_id")).alias("screened"))


def enrich_payloads(payloads: DataFrame, best: DataFrame, preserve_confirmed: bool = False) -> DataFrame:
    """Replaces the sanctions section by the best match where there is one.

    The new section has no ``confirmed`` flag, so a flag the old one carried is lost with its score
    floor; ``preserve_confirmed`` keeps it. The old evidence id stays as ``kyc_evidence_id``.
    """
    signal = sanctions_signal(best)
    joined = payloads.join(signal.withColumnRenamed("entity_id", "customer_id"), "customer_id", "left")
    confirmed = F.col("sanctions.confirmed") if preserve_confirmed else F.lit(None).cast("boolean")
    merged = F.col("screened").withField("kyc_evidence_id", S.known(F.col("sanctions.evidence_id"))).withField("confirmed", confirmed)
    order = [f.name for f in payloads.schema["sanctions"].dataType.fields]
    fields = [merged[name].alias(name) for name in order]
    return joined.withColumn("sanctions", F.when(F.col("screened").isNotNull(), F.struct(*fields)).otherwise(F.col("sanctions"))).drop("screened")


def client_queries(clients: DataFrame) -> DataFrame:
    """Screening queries from customer rows of either naming."""
    def first(*names: str) -> Column:
        found = [F.nullif(F.col(n).cast("string"), F.lit("")) for n in names if n in clients.columns]
        return F.coalesce(*found) if found else F.lit(None).cast("string")
    name = F.coalesce(first("client_name", "display_name", "name"), F.lit(""))
    parts = [S.known(F.col(c)) for c in ("client_type", "sector", "country") if c in clients.columns]
    return clients.select(
        F.coalesce(first("client_id", "entity_id"), F.lit("UNKNOWN")).alias("entity_id"), name.alias("name"),
        first("country", "nationality").alias("nationality"),
        F.when(F.lower(F.coalesce(first("client_type"), F.lit(""))) != "individual", name).alias("company"),
        S.known(F.concat_ws(" ", *parts)).alias("context"))


def light_search(queries: DataFrame, entries: DataFrame, threshold: int = 40, limit: int = 10, **skew) -> DataFrame:
    """Exact, substring and shared-word search of names (``query_id``, ``name``) in ``light`` entries.

    Distinct names are matched once. Containment goes through letter pieces, shared words through
    the rarest words of the query: to share enough of its words an entry must hold one of them.
    """
    from probita.operators.skew import contains_join

    asked = queries.select("query_id", F.lower(S.strip("name")).alias("needle")).where("needle <> ''")
    names = asked.select("needle").distinct()
    lists = entries.select(F.col("row_id"), "name", F.lower("name").alias("_n"), F.lower("aliases").alias("_a"))
    texts = lists.select("_n", "_a").distinct()
    named, aliased = texts.withColumn("haystack", F.col("_n")), texts.withColumn("haystack", F.col("_a"))

    inside_names = contains_join(names, texts.select(F.col("_n").alias("haystack")).distinct(), **skew)
    inside_aliases = contains_join(names, texts.select(F.col("_a").alias("haystack")).where("haystack <> ''").distinct(), **skew)
    by_name = named.join(inside_names, "haystack").select(
        "needle", "_n", "_a", F.when(F.col("needle") == F.col("_n"), 100).otherwise(80).alias("score"))
    by_alias = aliased.join(inside_aliases, "haystack").select("needle", "_n", "_a", F.lit(80).alias("score"))

    words = names.withColumn("_tokens", S.alphanumeric_tokens("needle")).where(F.size("_tokens") > 0)
    filed = texts.withColumn("_words", F.array_union(S.alphanumeric_tokens("_n"), S.alphanumeric_tokens("_a")))
    postings = filed.select("_n", "_a", "_words", F.explode("_words").alias("_word"))
    frequency = postings.groupBy("_word").agg(F.count(F.lit(1)).alias("_f"))
    ranked = words.select("needle", F.explode("_tokens").alias("_word")).join(frequency, "_word", "left")
    ranked = ranked.groupBy("needle").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("_f", F.lit(0)).alias("_f"), "_word"))).alias("_rare"))
    n = F.size("_rare")
    enough = F.ceil(F.lit(float(threshold)) * n / 60.0 - 1e-9)
    probes = ranked.withColumn("_take", (n - enough + 1).cast("int")).where("_take > 0").select(
        "needle", F.transform("_rare", lambda r: r["_word"]).alias("_tokens"), F.explode(F.slice("_rare", F.lit(1), F.col("_take"))).alias("_probe"))
    shared = skew_join(postings, probes.select("needle", "_tokens", F.col("_probe._word").alias("_word")), ["_word"],
                       counts=frequency.withColumnRenamed("_f", "_rows"), **skew)
    overlap = F.size(F.array_intersect("_tokens", "_words")) / F.size("_tokens") * 60
    by_words = shared.select("needle", "_n", "_a", F.floor(overlap).cast("int").alias("score"))

    scored = by_name.unionByName(by_alias).unionByName(by_words).where(F.col("score") >= threshold)
    best = scored.groupBy("needle", "_n", "_a").agg(F.max("score").alias("score"))
    hits = best.join(lists, ["_n", "_a"]).select("needle", "row_id", "name", "score")
    kept = top_n(hits, ["needle"], [F.col("score").desc(), F.col("name"), F.col("row_id")], limit)
    return skew_join(asked, kept, ["needle"], **skew).select("query_id", "row_id", "name", "score", "rank")
