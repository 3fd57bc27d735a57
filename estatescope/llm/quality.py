"""Quality rules (5): a table of thresholds compiled into one projection.

Every measure is a built-in expression over the words and lines of the whole text, every rule is a
row of ``RULES``; ``measured`` adds the measures and ``judged`` turns the table into one boolean per
rule and the verdict.  Nothing is shuffled and no user function runs.

Null and blank texts have no words and fail; repeated rows are judged alike, each by itself; an
empty table gives an empty table; columns of the input other than the text are kept by ``judged``
under their names, as all added names start with the given prefix.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from estatescope.llm.registry import query, read
from estatescope.llm.texts import SPACES, packed, spark_words


class Rule(NamedTuple):
    """A text passes if ``low <= share of / number of <= high``; ``of`` None: the plain number."""

    name: str
    measure: str
    of: str | None
    low: float | None
    high: float | None
    base: bool = False


RULES = [
    Rule("few_words", "n_words", None, 50, None, base=True),
    Rule("repeated_words", "n_repeat_words", "n_words", None, 0.5, base=True),
    Rule("word_length", "word_chars", "n_words", 2.5, 15),
    Rule("symbols", "n_symbols", "n_words", None, 0.1),
    Rule("punctuation", "n_punctuation", "word_chars", None, 0.25),
    Rule("stop_words", "n_stop_words", "n_words", 0.02, None),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", None, 0.5),
]

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in is that it was for on with as are be this have from or by "
    "der die das und ist von den mit zu ein eine nicht sich auf dem des im für auch als "
    "le la les de et des un une que est pour dans qui en du au par sur pas avec "
    "el los las del por para con se su lo como más no al y a"
).split()

SYMBOLS = "#*$%&|<>"
PUNCTUATION = "!\"'(),-./:;=?@[\\]^_`{}~" + SYMBOLS


def _chars_of(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def measured(docs: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """``docs`` with one long column per measure, counted over the whole text."""
    p, t = prefix, F.coalesce(F.col(text), F.lit(""))
    kept = [F.col(f"`{c}`") for c in docs.columns]
    words, ordered, spots = f"{p}_words", f"{p}_ordered", f"{p}_spots"
    w = lambda i: F.get(F.col(words), i)
    at = lambda k: F.get(F.col(ordered), k)["w"]
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(f"[^{SPACES}]"))

    # Equal windows of three words stand together once sorted; blank never occurs in a word.
    step = docs.select(*kept, spark_words(F.col(text)).alias(words))
    step = step.select("*", F.when(F.size(words) >= 3, F.sort_array(F.transform(
        F.sequence(F.lit(0), F.size(words) - 3),
        lambda i: F.struct(F.concat_ws(" ", w(i), w(i + 1), w(i + 2)).alias("w"), i.alias("i")))))
        .alias(ordered))
    step = step.select("*", F.sort_array(F.transform(
        F.filter(F.col(ordered), lambda x, k: (at(k - 1) == x["w"]) | (at(k + 1) == x["w"])),
        lambda x: x["i"])).alias(spots))
    covered = F.aggregate(
        F.col(spots), F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda a, i: F.struct((a["n"] + i + 3 - F.greatest(i, a["end"])).alias("n"),
                              (i + 3).alias("end")))["n"]
    measures = {
        # A condition on the verdict must stay above the measures: moved below, each would be computed anew
        # for every use in it.  The optimizer leaves conditions above columns that take a row number along.
        "n_words": F.when(F.monotonically_increasing_id() >= 0, F.size(words)),
        "word_chars": F.length(F.translate(t, " \t\n\x0b\x0c\r", "")),
        "n_symbols": _chars_of(t, SYMBOLS),
        "n_punctuation": _chars_of(t, PUNCTUATION),
        "n_lines": F.size(lines),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_repeat_words": F.coalesce(covered, F.lit(0)),
        "n_stop_words": F.size(F.filter(F.col(words), lambda x: F.lower(
            F.translate(x, ".,;:!?", "")).isin(STOP_WORDS))),
    }
    return step.select(*kept, *[v.cast("long").alias(p + k) for k, v in measures.items()])


def passes(rule: Rule, prefix: str = "") -> Column:
    """The rule as a column; shares are compared as products, so that nothing divides by zero."""
    value = F.col(prefix + rule.measure)
    unit = F.col(prefix + rule.of) if rule.of else F.lit(1)
    verdict = F.lit(True)
    if rule.low is not None:
        verdict &= value >= unit * F.lit(rule.low)
    if rule.high is not None:
        verdict &= value <= unit * F.lit(rule.high)
    return verdict


def judged(docs: DataFrame, text: str = "text", rules: list[Rule] | None = None,
           prefix: str = "") -> DataFrame:
    """``docs`` with measures, one boolean ``pass_<rule>`` per rule, ``base_failed`` and ``kept``."""
    rules = RULES if rules is None else rules
    flags = [passes(r, prefix).alias(f"{prefix}pass_{r.name}") for r in rules]
    out = measured(docs, text, prefix).select("*", *flags)
    every = lambda rs: F.expr(" AND ".join(
        ["true", *[f"`{prefix}pass_{r.name}`" for r in rs]]))
    return out.select("*", (~every([r for r in rules if r.base])).alias(f"{prefix}base_failed"),
                      every(rules).alias(f"{prefix}kept"))


def accepted(docs: DataFrame, text: str = "text", rules: list[Rule] | None = None) -> DataFrame:
    """The rows of ``docs`` that pass every rule."""
    return judged(packed(docs, text=F.col(text)), "text", rules).where("kept").select("row.*")


def _sql() -> str:
    """The same verdicts for DuckDB, from the same table of rules."""
    quoted = lambda s: s.replace("'", "''")
    def condition(r: Rule) -> str:
        unit = r.of or "1"
        return " AND ".join([f"{r.measure} >= {unit} * {r.low}"] * (r.low is not None)
                            + [f"{r.measure} <= {unit} * {r.high}"] * (r.high is not None))
    stops = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
    return f"""
WITH t AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
    list_filter(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)),
                lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l
  FROM documents),
windows AS (
  SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM t WHERE len(w) >= 3)),
repeated AS (SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
covered AS (
  SELECT r, count(DISTINCT j) AS n
  FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM repeated) GROUP BY r),
m AS (
  SELECT doc_id, len(w) AS n_words,
    length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')) AS word_chars,
    length(text) - length(translate(text, '{quoted(SYMBOLS)}', '')) AS n_symbols,
    length(text) - length(translate(text, '{quoted(PUNCTUATION)}', '')) AS n_punctuation,
    len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines,
    coalesce(n, 0) AS n_repeat_words,
    len(list_filter(w, lambda x: lower(translate(x, '.,;:!?', '')) IN ({stops}))) AS n_stop_words
  FROM t LEFT JOIN covered USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  NOT ({' AND '.join(condition(r) for r in RULES if r.base)}) AS base_failed,
  {' AND '.join(condition(r) for r in RULES)} AS kept
FROM m"""


@query("op5_quality_rules", _sql())
def op5_quality_rules(spark: SparkSession, path: str) -> DataFrame:
    docs = read(spark, path, "documents").select("doc_id", "text")
    return judged(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                               "n_repeat_words", "base_failed", "kept")
