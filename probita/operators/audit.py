"""Audit events: validation, sanitising, hash chains and their verification.

Writing a chain is sequential within the chain and parallel across chains, so a chain should be
short: one per actor and day, say. Verifying needs no order at all: every row is compared with its
predecessor in an equi-join on chain and position.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from probita import fixed_values as V
from probita.functions.scalars import pad_number, pipe_hash
from probita.operators.skew import dense_position
from probita.session import cut_lineage

PIPE_FIELDS = ["event_id", "actor", "action", "resource", "reason", "timestamp"]


def validate_events(events: DataFrame) -> DataFrame:
    """Adds the list of rule violations of each event; an event without any is valid."""
    def bad(condition: Column, field: str) -> Column:
        return F.when(F.coalesce(condition, F.lit(True)), F.lit(field))

    def length_outside(name: str, most: int) -> Column:
        return (F.length(name) < 1) | (F.length(name) > most)

    def optional(name: str, condition: Column) -> Column:
        return F.when(F.col(name).isNotNull() & condition, F.lit(name))

    checks = [
        bad(~F.col("event_type").isin(V.EVENT_TYPES), "event_type"), bad(~F.col("action").rlike(V.ACTION_PATTERN), "action"),
        bad(~F.col("outcome").isin(V.OUTCOMES), "outcome"), bad(~F.col("severity").isin(V.SEVERITIES), "severity"),
        bad(length_outside("actor_id", V.MAX_ACTOR_ID), "actor_id"), bad(~F.col("actor_type").isin(V.ACTOR_TYPES), "actor_type"),
        optional("resource_type", ~F.col("resource_type").rlike(V.RESOURCE_PATTERN) | length_outside("resource_type", V.MAX_RESOURCE_TYPE)),
        optional("resource_id", F.length("resource_id") > V.MAX_RESOURCE_ID),
        optional("request_id", length_outside("request_id", V.MAX_REQUEST_ID)),
        bad(~F.col("timestamp").rlike(r"(Z|[+-]\d{2}:?\d{2})$"), "timestamp"),
        optional("duration_ms", F.col("duration_ms") < 0),
    ]
    return events.withColumn("violations", F.array_compact(F.array(*checks)))


def sensitive_key(key: Column) -> Column:
    lowered = F.lower(F.trim(key))
    hit = F.lit(False)
    for part in V.SENSITIVE_KEY_PARTS:
        hit = hit | F.contains(lowered, F.lit(part))
    return hit & ~lowered.isin(V.ALLOWED_KEYS)


def bounded(text: Column) -> Column:
    return F.when(F.length(text) > V.MAX_STRING, F.concat(F.substring(text, 1, V.MAX_STRING), F.lit(V.TRUNCATED_TEXT))).otherwise(text)


def sanitize_map(metadata: Column | str) -> Column:
    """Flat text metadata: sensitive keys redacted, long texts cut, at most thirty keys."""
    metadata = F.col(metadata) if isinstance(metadata, str) else metadata
    entries = F.map_entries(metadata)
    kept = F.transform(F.slice(entries, 1, V.MAX_KEYS), lambda e: F.struct(
        bounded(e["key"]).alias("key"), F.when(sensitive_key(e["key"]), F.lit(V.REDACTED)).otherwise(bounded(e["value"])).alias("value")))
    more = F.array(F.struct(F.lit("_truncated").alias("key"), F.lit(V.TRUNCATED_ITEMS).alias("value")))
    full = F.when(F.size(entries) > V.MAX_KEYS, F.concat(kept, more)).otherwise(kept)
    return F.coalesce(F.map_from_entries(full), F.create_map().cast("map<string,string>"))


def _quoted(text: Column) -> Column:
    """A text as a JSON string."""
    listed = F.to_json(F.array(text))
    return F.substring(listed, F.lit(2), F.length(listed) - 2)


def _part(typed: Column, raw: Column) -> Column:
    """JSON text of a part: its own text where it has parts itself (their order counts), else as typed."""
    shown = F.to_json(typed)
    return F.when(F.left(shown, F.lit(1)).isin("{", "["), raw).otherwise(shown)


def _members(value: Column, depth: int) -> Column:
    """A JSON object with its rules applied, as JSON text."""
    both = F.array(F.struct(F.from_json(value, "map<string,variant>").alias("typed"), F.from_json(value, "map<string,string>").alias("raw")))

    def of(m: Column) -> Column:
        shown = F.transform(F.slice(F.map_keys(m["raw"]), 1, V.MAX_KEYS), lambda k: F.concat(
            _quoted(bounded(k)), F.lit(":"), F.when(sensitive_key(k), _quoted(F.lit(V.REDACTED))).otherwise(
                F.transform(F.array(_part(m["typed"][k], m["raw"][k])), lambda part: _bounded_json(part, depth + 1))[0])))
        more = F.when(F.size(m["raw"]) > V.MAX_KEYS, F.array(F.lit(f'"_truncated":"{V.TRUNCATED_ITEMS}"'))).otherwise(F.array().cast("array<string>"))
        return F.concat(F.lit("{"), F.array_join(F.concat(shown, more), ","), F.lit("}"))

    return F.transform(both, of)[0]


def _elements(value: Column, depth: int) -> Column:
    """A JSON list with its rules applied, as JSON text."""
    parts = F.zip_with(F.from_json(value, "array<variant>"), F.from_json(value, "array<string>"), _part)

    def of(items: Column) -> Column:
        shown = F.transform(F.slice(items, 1, V.MAX_ITEMS), lambda part: _bounded_json(part, depth + 1))
        more = F.when(F.size(items) > V.MAX_ITEMS, F.array(F.lit(f'"{V.TRUNCATED_ITEMS}"'))).otherwise(F.array().cast("array<string>"))
        return F.concat(F.lit("["), F.array_join(F.concat(shown, more), ","), F.lit("]"))

    return F.transform(F.array(parts), of)[0]


def _bounded_json(value: Column, depth: int) -> Column:
    """One JSON value as text; the levels are written out, there are few."""
    if depth > V.MAX_DEPTH:
        return F.lit(f'"{V.TRUNCATED_DEPTH}"')
    plain = F.from_json(F.concat(F.lit("["), value, F.lit("]")), "array<string>")[0]
    first = F.left(value, F.lit(1))
    return F.when(value.isNull(), "null").when(first == "{", _members(value, depth)).when(first == "[", _elements(value, depth)).when(
        first == '"', _quoted(bounded(plain))).otherwise(value)


def sanitize_json(text: Column | str) -> Column:
    """The same rules for nested metadata in JSON, down to four levels and twenty items per list.

    Nothing and what is no object become an empty object; a text that is no JSON, or names a key twice, becomes an error mark.
    """
    text = F.trim(F.col(text) if isinstance(text, str) else text)
    return F.when(F.coalesce(text, F.lit("")) == "", "{}").when(F.try_parse_json(text).isNull(), '{"_sanitization_error": true}').when(
        F.left(text, F.lit(1)) == "{", _members(text, 0)).otherwise("{}")


def number_events(events: DataFrame, chain: list[str] | None = None) -> DataFrame:
    """Position of each event in its chain, by time and id; a long chain is counted hour by hour."""
    return dense_position(events, chain or ["chain_id"], F.date_trunc("hour", "ts"), [F.col("ts"), F.col("event_id")])


def _fold(batches: Iterator[pd.DataFrame], genesis: str, digest) -> Iterator[pd.DataFrame]:
    """Links rows that arrive sorted by chain and position; only the last hash is held."""
    chain, last = None, genesis
    for batch in batches:
        previous, hashes = [], []
        for row in batch.to_dict("records"):
            if row["chain_id"] != chain:
                chain = row["chain_id"]
                last = row.get("_tail") if isinstance(row.get("_tail"), str) else genesis
            previous.append(last)
            last = digest(row, last)
            hashes.append(last)
        yield batch.drop(columns=["_tail"]).assign(previous_hash=previous, hash=hashes)


def pipe_digest(row: dict, previous: str) -> str:
    parts = ["" if row[f] is None else str(row[f]) for f in PIPE_FIELDS]
    return hashlib.sha256("|".join([*parts, previous]).encode("utf-8")).hexdigest()


def canonical(body: dict) -> str:
    return json.dumps(body, sort_keys=True, separators=(",", ":"), ensure_ascii=True)


def json_digest(row: dict, previous: str) -> str:
    body = json.loads(row["body"])
    body["previous_hash"] = previous
    return hashlib.sha256(canonical(body).encode("utf-8")).hexdigest()


def write_chain(events: DataFrame, genesis: str = V.WORD_GENESIS, tails: DataFrame | None = None, kind: str = "pipe") -> DataFrame:
    """Adds ``previous_hash`` and ``hash``; a chain goes on from its stored tail (``chain_id``, ``hash``) where there is one.

    Each task walks its chains in sorted order, batch by batch, and keeps one hash in memory.
    """
    digest = {"pipe": pipe_digest, "json": json_digest}[kind]
    if tails is None:
        rows = events.withColumn("_tail", F.lit(None).cast("string"))
    else:
        rows = events.join(tails.select("chain_id", F.col("hash").alias("_tail")), "chain_id", "left")
    schema = T.StructType([*events.schema.fields, T.StructField("previous_hash", T.StringType()), T.StructField("hash", T.StringType())])
    ordered = rows.select(*events.columns, "_tail").repartition("chain_id").sortWithinPartitions("chain_id", "seq")
    return ordered.mapInPandas(lambda batches: _fold(batches, genesis, digest), schema)


def _continue(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Numbers and links rows that arrive sorted by chain; only the last link is held."""
    chain, seq, last = object(), 0, ""
    for batch in batches:
        numbers, previous, hashes = [], [], []
        for row in batch.to_dict("records"):
            if row["chain_id"] != chain:
                chain, seq, last = row["chain_id"], row["_seq"], row["_tail"]
            seq += 1
            numbers.append(seq)
            previous.append(last)
            last = pipe_digest(row, last)
            hashes.append(last)
        yield batch.drop(columns=["_seq", "_tail"]).assign(seq=numbers, previous_hash=previous, hash=hashes)


def continued_chain(events: DataFrame, tails: DataFrame | None = None) -> DataFrame:
    """Events numbered and linked by time and id, each chain going on from its tail (``chain_id``, ``seq``, ``hash``) where there is one.

    Rows without a chain are a chain of their own. The chains of a task are sorted by the engine and walked batch by batch.
    """
    rows = events.select("chain_id", *PIPE_FIELDS)
    seq, last = F.lit(0).cast("long"), F.lit(V.WORD_GENESIS)
    if tails is not None:
        known = tails.select(F.col("chain_id").alias("_chain"), F.col("seq").alias("_last_seq"), F.col("hash").alias("_last_hash"))
        rows = rows.join(known, F.col("chain_id").eqNullSafe(F.col("_chain")), "left")
        seq, last = F.coalesce("_last_seq", seq), F.coalesce("_last_hash", last)
    order = ["chain_id", F.col("timestamp").asc_nulls_last(), F.col("event_id").asc_nulls_last()]
    ordered = rows.select("chain_id", *PIPE_FIELDS, seq.alias("_seq"), last.alias("_tail")).repartition("chain_id").sortWithinPartitions(*order)
    fields = ", ".join(f"{f} string" for f in PIPE_FIELDS)
    linked = ordered.mapInPandas(_continue, f"chain_id string, {fields}, seq long, previous_hash string, hash string")
    return linked.select("chain_id", "seq", *PIPE_FIELDS, "previous_hash", "hash")


def last_links(chained: DataFrame) -> DataFrame:
    return chained.groupBy("chain_id").agg(F.max(F.struct("seq", "hash")).alias("_last")).select("chain_id", "_last.seq", "_last.hash")


def chain_tails(chained: DataFrame) -> DataFrame:
    return chained.groupBy("chain_id").agg(F.max_by("hash", "seq").alias("hash"))


def _first_breaks(chained: DataFrame, recomputed: Column, genesis: str, extra: Column | None = None) -> DataFrame:
    """First broken row of each chain with its reason, and how many rows were looked at."""
    before = chained.select("chain_id", (F.col("seq") + 1).alias("seq"), F.col("hash").alias("_before"))
    linked = chained.withColumn("_own", recomputed).join(before, ["chain_id", "seq"], "left")
    first = F.col("seq") == 1
    expected = F.when(first, F.lit(genesis)).otherwise(F.col("_before"))
    reason = F.when(~F.col("previous_hash").eqNullSafe(expected), "previous_hash mismatch").when(
        ~F.col("hash").eqNullSafe(F.col("_own")), "content altered")
    if extra is not None:
        reason = F.coalesce(extra, reason)
    judged = linked.withColumn("_reason", reason)
    broken = F.min(F.when(F.col("_reason").isNotNull(), F.struct("seq", "event_id", "_reason")))
    return judged.groupBy("chain_id").agg(broken.alias("b"), F.count(F.lit(1)).alias("n")).select(
        "chain_id", F.col("b").isNull().alias("valid"), F.coalesce("b.seq", "n").alias("events_checked"),
        F.col("b.event_id").alias("broken_at"), F.col("b._reason").alias("reason"))


def verify_pipe_chain(chained: DataFrame, genesis: str = V.WORD_GENESIS) -> DataFrame:
    return _first_breaks(chained, pipe_hash(*PIPE_FIELDS, "previous_hash"), genesis)


@F.pandas_udf(T.StringType())
def canonical_json(texts: pd.Series) -> pd.Series:
    """Canonical text of a stored event without its own hash; NULL where it is no JSON object."""
    def one(text: str | None) -> str | None:
        try:
            body = json.loads(text)
        except (TypeError, ValueError):
            return None
        return canonical({k: v for k, v in body.items() if k != "event_hash"}) if isinstance(body, dict) else None
    return texts.map(one)


def stored_events(chained: DataFrame) -> DataFrame:
    """Events as stored lines: the canonical JSON with both hashes."""
    @F.pandas_udf(T.StringType())
    def line(bodies: pd.Series, previous: pd.Series, hashes: pd.Series) -> pd.Series:
        return pd.Series([canonical({**json.loads(b), "previous_hash": p, "event_hash": h}) for b, p, h in zip(bodies, previous, hashes)])
    return chained.select("chain_id", "seq", "event_id", line("body", "previous_hash", "hash").alias("line"))


def _parsed(lines: DataFrame, *kept: str) -> DataFrame:
    """The hashes that a line names and what is wrong with it alone, written once: a line itself is never joined or sorted."""
    own = F.sha2(canonical_json("line"), 256).alias("_own")
    found = lines.select(*kept, F.get_json_object("line", "$.previous_hash").alias("previous_hash"), F.get_json_object("line", "$.event_hash").alias("hash"), own)
    fault = F.when(F.col("_own").isNull(), 1).when(F.col("previous_hash").isNull() | F.col("hash").isNull(), 2).when(F.col("hash") != F.col("_own"), 3).otherwise(0)
    return cut_lineage(found.withColumn("_fault", fault.cast("byte")).drop("_own"))


def verify_json_chain(stored: DataFrame, genesis: str = V.ZERO_GENESIS) -> DataFrame:
    """Verifies stored lines (``chain_id``, ``seq``, ``event_id``, ``line``).

    Where only the last rows of a chain are kept, the chain starts from the oldest of them. A row whose predecessor is
    missing breaks the chain there. Rows missing at the end can't be seen from the rows that are left.
    """
    return _verified(_parsed(stored, "chain_id", "seq", "event_id"), genesis)


def _verified(parsed: DataFrame, genesis: str) -> DataFrame:
    start = parsed.groupBy("chain_id").agg(F.min(F.struct("seq", "previous_hash")).alias("_start"))
    rows = parsed.join(start, "chain_id").withColumn("_complete", F.col("_start.seq") == 1)
    shifted = rows.withColumn("seq", F.col("seq") - F.col("_start.seq") + 1)
    before = shifted.select("chain_id", (F.col("seq") + 1).alias("seq"), F.col("hash").alias("_before"))
    linked = shifted.join(before, ["chain_id", "seq"], "left")
    expected = F.when(F.col("seq") > 1, F.col("_before")).when(F.col("_complete"), F.lit(genesis)).otherwise(F.col("_start.previous_hash"))
    reason = (
        F.when(F.col("_fault") == 1, "malformed JSON line")
        .when(F.col("_fault") == 2, "missing hash-chain fields")
        .when(~F.col("previous_hash").eqNullSafe(expected), "previous_hash mismatch")
        .when(F.col("_fault") == 3, "content altered"))
    judged = linked.select("chain_id", "seq", "event_id", "_complete", reason.alias("_reason"))
    broken = F.min(F.when(F.col("_reason").isNotNull(), F.struct("seq", "event_id", "_reason")))
    first = judged.groupBy("chain_id").agg(broken.alias("b"), F.bool_and("_complete").alias("c"))
    # Rows looked at: those there are up to the first broken one.
    seen = judged.select("chain_id", F.col("seq").alias("_at")).join(first, "chain_id").groupBy("chain_id").agg(
        F.count_if(F.col("b").isNull() | (F.col("_at") <= F.col("b.seq"))).alias("events_checked"), F.first("b").alias("b"), F.first("c").alias("c"))
    return seen.select("chain_id", F.col("b").isNull().alias("valid"), "events_checked", F.col("b.event_id").alias("broken_at"),
                       F.col("b._reason").alias("reason"), F.col("c").alias("verified_from_genesis"))


def verify_lines(lines: DataFrame, genesis: str = V.ZERO_GENESIS) -> DataFrame:
    """Verifies log files read as lines (``chain_id``, ``line_number``, ``line``); blank lines are skipped."""
    rows = _parsed(lines.where(F.trim("line") != ""), "chain_id", "line_number")
    numbered = dense_position(rows, ["chain_id"], F.floor(F.col("line_number") / 100_000), [F.col("line_number")])
    result = _verified(numbered.withColumn("event_id", F.col("line_number")), genesis)
    return result.select("chain_id", "valid", F.when(F.col("valid"), F.col("events_checked")).otherwise(F.col("events_checked") - 1).alias("lines_checked"),
                         F.col("broken_at").alias("failed_line"), "reason")


def newest(events: DataFrame, n: int) -> DataFrame:
    return events.orderBy(F.col("event_id").desc()).limit(n)


def retained(events: DataFrame, most: int) -> DataFrame:
    """What a log bounded to ``most`` events keeps, and how many it has dropped."""
    kept = newest(events, most).agg(F.count(F.lit(1)).alias("kept"), F.min("event_id").alias("oldest_kept"))
    return kept.withColumn("dropped", events.agg(F.count(F.lit(1))).scalar() - F.col("kept"))


def sequential_ids(df: DataFrame, order: list[Column], prefix: str = "EVD", width: int = 3) -> DataFrame:
    """Numbered ids in the order given; more digits than ``width`` are kept.

    Rows are sorted into ranges, written down, counted per range and numbered within it. Only a number per range reaches
    the driver. Rows that tie in the order are numbered in any order.
    """
    ranged = cut_lineage(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    sizes = sorted(tuple(r) for r in ranged.groupBy("_range").count().collect())
    starts, total = [], 0
    for number, size in sizes:
        starts.append((number, total))
        total += size
    offsets = df.sparkSession.createDataFrame(starts, "_range int, _start long")
    within = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    numbered = ranged.withColumn("_number", within).join(F.broadcast(offsets), "_range").withColumn("_number", F.col("_number") + F.col("_start"))
    return numbered.withColumn("evidence_id", F.concat(F.lit(prefix + "-"), pad_number("_number", width))).drop("_number", "_start", "_range")


def screening_events(matches: DataFrame) -> DataFrame:
    """One event per returned match."""
    return matches.select(
        F.lit(V.SCREENING_ACTION).alias("action"), F.col("entity_id").alias("resource"), F.col("classification").alias("reason"),
        F.col("match_score").cast("string").alias("new_value"),
        F.to_json(F.struct("evidence_id", "matched_against", "source", "candidates_scored")).alias("metadata"))


def media_events(findings: DataFrame) -> DataFrame:
    """One event per analysed article, and one more per suspected injection."""
    n = F.size("extracted_claims")
    run = F.struct(F.lit(V.MEDIA_ACTION).alias("action"), F.concat(F.lit("Analyzed article; "), n.cast("string"), F.lit(" claim(s) extracted")).alias("reason"),
                   F.to_json(F.struct("evidence_id", "source_url", n.alias("claims"), F.col("metadata")["extraction_method"].alias("extraction_method"))).alias("metadata"))
    caught = F.struct(F.lit(V.INJECTION_ACTION).alias("action"), F.col("injection_details").alias("reason"),
                      F.to_json(F.struct("evidence_id", "source_url", F.lit("article treated as data; no instruction followed").alias("action_taken"))).alias("metadata"))
    events = F.array_compact(F.array(run, F.when(F.col("injection_attempt_detected"), caught)))
    return findings.select(F.col("entity_id").alias("resource"), F.inline(events)).select(
        "action", "resource", "reason", F.lit(None).cast("string").alias("new_value"), "metadata")
