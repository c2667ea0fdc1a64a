"""Text operators: instruction injection, claims, identifiers, redaction."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from probita import fixed_values as V
from probita.functions.scalars import column, half_even, strip

# A text of letters only that compatibility folding leaves as they are; it is not sent to Python. The whole run is taken at once, which is
# several times faster than a search for a letter of another kind.
STABLE = r"\A[\x00-\x7FÀ-ÿА-я]*+\z"


@F.pandas_udf(T.StringType())
def _compatibility_form(texts: pd.Series) -> pd.Series:
    return texts.map(lambda text: unicodedata.normalize("NFKC", text), na_action="ignore")


def detection_form(text: Column | str) -> Column:
    """Copy of a text with the usual evasions undone; for matching only, never stored.

    Compatibility forms and look-alikes are folded, invisible characters dropped, spelled-out words
    rejoined and blanks collapsed (line breaks stay).
    """
    text = column(text)
    folded = F.coalesce(_compatibility_form(F.when(~text.rlike(STABLE), text)), text)
    # An array of one binds each step, so that it is worked out once and not once for each time that it is named.
    return F.transform(F.transform(F.array(folded), _plain_letters), _rejoined)[0]


def _plain_letters(folded: Column) -> Column:
    """Lower case without invisible letters and look-alikes; those are all beyond ASCII."""
    plain = F.translate(F.lower(F.translate(folded, V.ZERO_WIDTH, "")), V.LOOKALIKE_FROM, V.LOOKALIKE_TO)
    return F.when(F.octet_length(folded) == F.length(folded), F.lower(folded)).otherwise(plain)


def _rejoined(folded: Column) -> Column:
    # Three and more single letters with blanks between them are one word, however many blanks: what lies between such runs
    # and the runs without their spaces are put together again.
    run = r"(?U)\b(?:[a-z]\s+){2,}[a-z]\b"
    words = F.transform(F.regexp_extract_all(folded, F.lit(run), F.lit(0)), lambda found: F.translate(found, " ", ""))
    rejoined = F.array_join(F.zip_with(F.split(folded, run, -1), words, lambda between, word: F.concat(between, F.coalesce(word, F.lit("")))), "")
    joined = F.when(folded.rlike(run), rejoined).otherwise(folded)
    # Single spaces, which are most of the blanks, stay as they are.
    return F.regexp_replace(joined, r"(?U) [^\S\n]+|[^\S\n ]+[^\S\n]*", " ")


def _holds(name: str, groups: list[list[str]]) -> Column:
    """The column holds a word of every group (as one SQL text: call by call this would take seconds to build)."""
    def one(words: list[str]) -> str:
        return "(" + " OR ".join("contains({0}, '{1}')".format(name, w.replace("'", "\\'")) for w in words) + ")"
    return F.expr(" AND ".join(one(words) for words in groups))


def with_injection(df: DataFrame, text: str, name: str = "categories") -> DataFrame:
    """Adds the kinds of instruction a text tries to give, each once, in the order of the patterns.

    The folded form is a column of its own, so that it is made once and not once per pattern.
    """
    staged = df.withColumn("_form", detection_form(F.coalesce(F.col(text), F.lit(""))))
    staged = staged.withColumn("_bare", F.regexp_replace("_form", "[^a-z0-9]", ""))
    # A plain word search, many times faster than the pattern, decides whether the pattern runs at all.
    hits = [F.when(_holds("_form", words) & F.col("_form").rlike("(?U)" + pattern), F.lit(label))
            for (pattern, label), words in zip(V.INJECTION_PATTERNS, V.INJECTION_WORDS)]
    hits += [F.when(_holds("_bare", words) & F.col("_bare").rlike(pattern), F.lit(label))
             for (pattern, label), words in zip(V.DESPACED_PATTERNS, V.DESPACED_WORDS)]
    return staged.withColumn(name, F.array_distinct(F.array_compact(F.array(*hits)))).drop("_form", "_bare")


def injection_summary(categories: Column | str) -> Column:
    categories = column(categories)
    return F.when(F.size(categories) > 0, F.concat(
        F.lit("Suspected prompt injection ("), F.array_join(categories, ", "), F.lit("); treated as data, not instructions.")))


def sentences(text: Column | str) -> Column:
    parts = F.split(F.replace(column(text), F.lit("\n"), F.lit(" ")), r"(?U)(?<=[.!?])\s+")
    return F.filter(F.transform(parts, strip), lambda part: part != "")


def term_hits(text: Column, terms: list[str]) -> Column:
    """How many of the terms occur in the text; a term inside another counts for both."""
    total = F.lit(0)
    for term in terms:
        total = total + F.contains(text, F.lit(term)).cast("int")
    return total


def claims(text: Column | str, terms: list[str] | None = None) -> Column:
    """Sentences that hold at least one term, verbatim, with a confidence from the number of terms."""
    terms = terms or V.ALLEGATION_TERMS
    text = column(text)
    hits = lambda of: F.transform(F.array(F.lower(of)), lambda low: term_hits(low, terms))[0]  # noqa: E731  (bound, so that it is lowered once)
    some = F.when(hits(text) > 0, text).otherwise("")  # most texts hold none
    scored = F.transform(sentences(some), lambda s: F.struct(s.alias("claim"), hits(s).alias("hits")))
    found = F.filter(scored, lambda c: c["hits"] > 0)
    return F.transform(found, lambda c: F.struct(
        c["claim"].alias("claim"), F.lit(True).alias("supported"),
        half_even(F.least(F.lit(0.5) + F.lit(0.1) * c["hits"], F.lit(0.9)), 2).alias("confidence")))


def _may_hold(text: Column, kind: str) -> Column:
    """Whether a text can hold an identifier of the kind, from single letters and words."""
    test = F.lit(True)
    for word_group in [V.EGRESS_NEEDS_TEXT[kind]] if kind in V.EGRESS_NEEDS_TEXT else []:
        any_word = F.lit(False)
        for word in word_group:
            any_word = any_word | F.contains(text, F.lit(word))
        test = test & any_word
    if kind in V.EGRESS_NEEDS_DIGIT:
        test = test & text.rlike(r"\p{Nd}")
    return test


def identifiers(text: Column | str) -> Column:
    """Personal and internal identifiers of a text as (kind, match), kind by kind."""
    text = column(text)
    found = []
    for kind, pattern in V.EGRESS_PATTERNS:
        searched = F.when(_may_hold(text, kind), text).otherwise("")
        matches = F.regexp_extract_all(searched, F.lit("(?U)" + pattern), F.lit(0))
        found.append(F.transform(matches, _tagged(kind)))
    return F.concat(*found)


def _tagged(kind: str):
    return lambda match: F.struct(F.lit(kind).alias("kind"), match.alias("match"))


def _logged(replacement: str, article: str, category: str, description: str):
    return lambda match: F.struct(
        F.lit(replacement).alias("replacement"), F.lit(article).alias("article"), F.lit(category).alias("category"),
        F.lit(description).alias("description"), F.substring(match, 1, 80).alias("snippet"))


def redact_identifiers(text: Column | str) -> Column:
    out = column(text)
    for kind, pattern in V.EGRESS_PATTERNS:
        out = F.regexp_replace(out, "(?U)" + pattern, f"[REDACTED:{kind}]")
    return out


def egress(text: Column | str, policy: str = "block", local: bool = False) -> Column:
    """Struct of what may leave: text (NULL where blocked), status and kinds found."""
    if policy not in ("block", "redact", "allow"):
        raise ValueError(f"unknown policy: {policy}")
    text = column(text)
    if local:
        return F.struct(text.alias("text"), F.lit("sent").alias("status"), F.array().cast("array<string>").alias("kinds"))
    kinds = F.array_distinct(F.transform(identifiers(text), lambda f: f["kind"]))
    found = F.size(kinds) > 0
    if policy == "allow":
        return F.struct(text.alias("text"), F.lit("sent").alias("status"), kinds.alias("kinds"))
    if policy == "redact":
        return F.struct(F.when(found, redact_identifiers(text)).otherwise(text).alias("text"),
                        F.when(found, "redacted").otherwise("sent").alias("status"), kinds.alias("kinds"))
    return F.struct(F.when(~found, text).alias("text"), F.when(found, "blocked").otherwise("sent").alias("status"), kinds.alias("kinds"))


def _rule_pattern(rule: tuple) -> str:
    replacement, pattern = rule[0], rule[4]
    if replacement != "[DOB_REDACTED]":
        return "(?U)" + pattern
    # A date counts only when a birth word lies wholly within the characters before it.
    words = [rf"{word.replace('.', chr(92) + '.')}[\s\S]{{0,{V.BIRTH_WINDOW - len(word)}}}" for word in V.BIRTH_WORDS]
    return "(?U)(?i)(?<=(?:" + "|".join(words) + "))" + pattern.removeprefix("(?i)")


def redact_report(text: Column | str) -> tuple[Column, Column]:
    """Redacted text, and the log of (replacement, article, category, snippet), rule after rule."""
    out, log = F.coalesce(column(text), F.lit("")), []
    for rule in V.REPORT_RULES:
        replacement, article, category, description, _ = rule
        pattern = _rule_pattern(rule)
        matches = F.regexp_extract_all(out, F.lit(pattern), F.lit(0))
        log.append(F.transform(matches, _logged(replacement, article, category, description)))
        out = F.regexp_replace(out, pattern, replacement)
    return out, F.concat(*log)


def mask_accounts(items: Column | str) -> Column:
    return F.transform(column(items), lambda item: F.regexp_replace(item, "(?U)" + V.ACCOUNT_PATTERN, "[ACCT_REDACTED]"))


def merge_references(existing: Column, log: Column, titles: dict[str, Column]) -> Column:
    """The legal references of a report: the ones it has, then the new ones of the redactions in order."""
    cited = []
    for article in sorted({rule[1] for rule in V.REPORT_RULES}):
        title = titles.get(article, F.lit(None).cast("string"))
        reference = F.when(F.coalesce(title, F.lit("")) == "", F.lit(f"GDPR {article}")).otherwise(
            F.concat(F.lit(f"GDPR {article} ("), title, F.lit(")")))
        cited.append(F.when(F.exists(log, _cites(article)), reference))
    return F.concat(existing, F.sort_array(F.array_except(F.array_compact(F.array(*cited)), existing)))


def _cites(article: str):
    return lambda entry: entry["article"] == article
