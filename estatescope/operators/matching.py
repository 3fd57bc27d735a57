"""Which terms occur in which texts.

"Text contains term" is not an equality, and comparing every text with every
term costs their product.  Here it is turned into an equality.  The usual search has
suffixes (``name.`` and ``name].``): only stretches in front of a suffix can match, a
handful per text.  Terms are indexed by their end: the last ``KEY`` characters, or all of a shorter one.  A stretch
asks for its last 1 to ``KEY`` characters, so it is a few rows however many lengths the terms have, and whether
the whole term stands there is then seen in the stretch.

Without a suffix a term can stand anywhere.  Then a part of it is looked for, piece by piece of the text:
the ``ANCHOR`` characters after its first blank, which only the blanks of a text can be in front of; of a
term without them its first ``ANCHOR`` characters, or all of a shorter one.  The whole term is then checked
in the few texts that hold that part.  The work grows with the text and with at most ``ANCHOR`` different
lengths, not with the number of terms.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

SUFFIXES = (".", "].")
#: Characters of a key, and of the stretch that goes with it; names of catalog objects have at most 128.
KEY, REACH = 8, 128
#: Characters of a term that are looked for everywhere in a text, and the pieces a text is cut into.
ANCHOR, PIECE = 8, 4096


def _split_at(text: Column, mark: str) -> Column:
    # An escaped single character spares the split the regex engine.
    pattern = "\\" + mark if len(mark) == 1 and not mark.isalnum() else f"\\Q{mark}\\E"
    return F.split(text, pattern, -1)


def _marks(suffixes: Sequence[str]) -> dict[str, list[str]]:
    """Shortest suffixes, each with what longer suffixes have in front of it.

    ``.`` and ``].`` give ``{".": ["", "]"]}``: the text is split at dots only.
    """
    marks: dict[str, list[str]] = {}
    for s in sorted({s for s in suffixes if s}, key=len):
        if any(s[:n] == s[-n:] for n in range(1, len(s))):
            raise ValueError(f"suffix {s!r} can overlap itself")
        mark = next((m for m in marks if s.endswith(m)), s)
        marks.setdefault(mark, []).append(s[:len(s) - len(mark)])
    return marks


def _with_keys(texts: DataFrame, keys: Sequence[str], mark: str, fronts: Sequence[str]) -> DataFrame:
    """The index side of the texts: per suffix that ends with ``mark`` and stretch in front of it one row for each key
    that a term there can have, at most ``KEY`` of them; repeats are possible.

    Only the longest key carries its stretch, ``REACH`` characters of it: the shorter ones are whole terms.
    """
    pieces, tail, n = F.col("_pieces"), F.col("_tail"), F.length("_stem")
    reach = REACH + max(len(f) for f in fronts)
    tails = F.array_distinct(F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), lambda p: F.right(p, F.lit(reach))))
    # In front of "]." stands what is in front of the dot, less the bracket.
    stems = [F.struct(
        (F.when(tail.endswith(f), F.left(tail, F.length(tail) - len(f))) if f else tail).alias("_stem"),
        F.lit(f + mark).alias("_suffix")) for f in fronts]
    # Nothing in front of the mark is what a term that ends with the mark has there.
    sizes = F.sequence(F.least(n, F.lit(1)), F.least(n, F.lit(KEY)))
    return (texts.select(*keys, _split_at(F.col("_text"), mark).alias("_pieces"))
            .select(*keys, F.explode(tails).alias("_tail"))
            .select(*keys, F.inline(F.array(*stems))).filter("_stem IS NOT NULL")
            .select(*keys, "_stem", "_suffix", F.explode(sizes).alias("_n"))
            .select(*keys, F.right("_stem", F.col("_n")).alias("_key"), "_suffix",
                    F.when(F.col("_n") == KEY, F.right("_stem", F.lit(REACH))).alias("_stem")))


def _key(term: Column, mark: str) -> Column:
    """The last ``KEY`` characters of what stands behind a term's last mark."""
    return F.right(F.substring_index(term, mark, -1), F.lit(KEY))


def _is_odd(term: Column, mark: str) -> Column:
    """Terms that their stretch cannot show: those that hold the mark (host.domain) and very long ones."""
    return F.contains(term, F.lit(mark)) | (F.length(term) > REACH)


def _hits_before(texts: DataFrame, distinct_terms: DataFrame, keys: Sequence[str], scope: Sequence[str],
                 mark: str, fronts: Sequence[str]) -> DataFrame:
    """Texts and terms of the same scope of which the text holds the term and a suffix.

    Terms are indexed by their last characters, so a term of any length is one row with one key.  What the key
    leaves open the stretch answers; odd terms are looked up in the whole texts that hold their key.
    """
    term, odd = F.col("_term"), F.col("_odd")
    indexed = distinct_terms.withColumns({"_key": _key(term, mark), "_odd": _is_odd(term, mark)})
    found = (_with_keys(texts, keys, mark, fronts).join(indexed, [*scope, "_key"])
             .filter(odd | (F.length("_key") < KEY) | F.endswith("_stem", term)))
    # Without odd terms no text is read again.
    any_odd = distinct_terms.agg(F.coalesce(F.bool_or(_is_odd(term, mark)), F.lit(False))).scalar()
    return _in_whole(found, texts.filter(any_odd), keys, odd, F.concat("_term", "_suffix"))


def _in_whole(candidates: DataFrame, texts: DataFrame, keys: Sequence[str], open_: Column, searched: Column) -> DataFrame:
    """Candidates that are not open, and those whose text holds ``searched``; only the open ones look for theirs."""
    own = [f"_own_{k}" for k in keys]
    whole = texts.select(*[F.col(k).alias(o) for k, o in zip(keys, own, strict=True)], "_text",
                         F.lit(0).cast("long").alias("_own_scatter"))
    nowhere = F.pmod(F.xxhash64(*keys), F.lit(1_000_003)) + 1
    scattered = candidates.withColumn("_scatter", F.when(open_, F.lit(0)).otherwise(nowhere))
    same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(o)) for k, o in zip(keys, own, strict=True)],
                  F.col("_scatter") == F.col("_own_scatter"))
    return scattered.join(whole, same, "left").filter(~open_ | F.contains("_text", searched))


def _anywhere(texts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per text and stretch that a term's part can equal (``_n``, ``_start``), repeats within a piece
    left out.  A piece goes on into the next one, so that no stretch is cut."""
    cut = F.lit(r"(?s)(.{1,%d})(?=(.{0,%d}))" % (PIECE, ANCHOR))
    pieces = F.zip_with(F.regexp_extract_all("_text", cut, F.lit(1)),
                        F.regexp_extract_all("_text", cut, F.lit(2)), lambda a, b: F.concat(a, b))
    # The lookahead takes _n characters from the position, the final dot moves on by one.
    pattern = F.when(F.col("_n") == 0, F.lit(r"(?s) (?=(.{%d}))" % ANCHOR)).otherwise(
        F.concat(F.lit("(?s)(?=(.{"), F.col("_n").cast("string"), F.lit("})).")))
    return (texts.select(*keys, "_parts", F.explode(pieces).alias("_piece"))
            .select(*keys, "_piece", F.explode("_parts").alias("_n"))
            .select(*keys, "_n", F.explode(F.array_distinct(F.regexp_extract_all("_piece", pattern, F.lit(1))))
                    .alias("_start")))


def _part_kind(term: Column) -> Column:
    """0: the part after the first blank, else how many of the first characters."""
    after = F.length(term) - F.instr(term, " ")
    return F.when((F.instr(term, " ") > 0) & (after >= ANCHOR), F.lit(0)).otherwise(
        F.least(F.length(term), F.lit(ANCHOR)))


def _part(term: Column) -> Column:
    """What of a term is looked for."""
    begin = F.when(_part_kind(term) == 0, F.instr(term, " ") + 1).otherwise(F.lit(1))
    return F.substring(term, begin, F.lit(ANCHOR))


def _hits_anywhere(texts: DataFrame, distinct_terms: DataFrame, keys: Sequence[str],
                   scope: Sequence[str]) -> DataFrame:
    """Texts and terms of the same scope of which the text holds the whole term."""
    parts = distinct_terms.withColumns({"_n": _part_kind(F.col("_term")), "_start": _part(F.col("_term"))})
    begun = _anywhere(texts, keys).join(parts, [*scope, "_n", "_start"]).drop("_n", "_start").distinct()
    return _in_whole(begun, texts.filter("_any_long"), keys, F.length("_term") > ANCHOR, F.col("_term"))


def _distinct_terms(terms: DataFrame, term_col: str, by: Sequence[str]) -> DataFrame:
    return (terms.filter(F.length(term_col) > 0)
            .groupBy(*by, F.lower(term_col).alias("_term"))
            .agg(F.min(term_col).alias(term_col)))


def _hits(texts: DataFrame, terms: DataFrame, keys: Sequence[str], text_col: str,
          term_col: str, suffixes: Sequence[str], scope: Sequence[str],
          kinds: Sequence[str]) -> DataFrame:
    columns = list(dict.fromkeys([*keys, *scope]))
    prepared = texts.filter(F.col(text_col).isNotNull()).select(*columns, F.lower(text_col).alias("_text"))
    distinct_terms = _distinct_terms(terms, term_col, [*scope, *kinds])
    found = [_hits_before(prepared, distinct_terms, columns, scope, mark, fronts).select(*keys, *kinds, term_col)
             for mark, fronts in _marks(suffixes).items()]
    if "" in suffixes:
        # What the tasks must know of all terms is a few small numbers: which lengths of parts occur.
        term = F.lower(term_col)
        shape = (terms.filter(F.length(term_col) > 0)
                 .agg(F.struct(F.bool_or(F.length(term) > ANCHOR).alias("long"),
                               F.collect_set(_part_kind(term)).alias("parts"))).scalar())
        anywhere = prepared.select(*columns, "_text", shape.alias("_shape")).select(
            *columns, "_text", F.col("_shape.parts").alias("_parts"), F.col("_shape.long").alias("_any_long"))
        found.append(_hits_anywhere(anywhere, distinct_terms, columns, scope)
                     .select(*keys, *kinds, term_col))
    return reduce(DataFrame.unionByName, found)


def all_matches(texts: DataFrame, terms: DataFrame, keys: Sequence[str], text_col: str,
                term_col: str, suffixes: Sequence[str] = SUFFIXES,
                scope: Sequence[str] = (), kinds: Sequence[str] = ()) -> DataFrame:
    """One row per text and term found in it: ``keys``, ``kinds`` and ``term_col``.

    ``keys`` identify a text.  Comparison is without case.  ``scope`` names columns
    that must be equal on both sides (a server's texts against its own terms), ``kinds``
    columns of the terms that tell several sets of terms apart, searched in one pass.
    Empty and NULL terms never match.  Terms that differ only in case are one term,
    reported in their first spelling.
    """
    return _hits(texts, terms, keys, text_col, term_col, suffixes, scope, kinds).distinct()


def first_match(texts: DataFrame, terms: DataFrame, keys: Sequence[str], text_col: str,
                term_col: str, suffixes: Sequence[str] = SUFFIXES,
                scope: Sequence[str] = (), kinds: Sequence[str] = ()) -> DataFrame:
    """One row per text (and kind) that holds any term, with the smallest such term.

    The minimum is taken inside the task that reads the text before anything moves.
    """
    return (_hits(texts, terms, keys, text_col, term_col, suffixes, scope, kinds)
            .groupBy(*keys, *kinds).agg(F.min(term_col).alias(term_col)))


def reference_tokens(texts: DataFrame, terms: DataFrame, keys: Sequence[str], text_col: str,
                     term_col: str, scope: Sequence[str] = ()) -> DataFrame:
    """Like ``all_matches`` for whole identifiers only: ``MyDb.`` is no match for ``Db``.

    In brackets any name counts: ``[SRV-01].``"""
    columns = list(dict.fromkeys([*keys, *scope]))
    # A name is tried once, from its first character: neither its rest nor less of it is tried again.
    bare, bracketed = (F.regexp_extract_all(text_col, F.lit(p), F.lit(1)) for p in (
        r"(?<![\p{L}\p{N}_@#$])([\p{L}\p{N}_@#$]++)\.", r"\[([^\[\]]++)\]\."))
    names = F.array_distinct(F.transform(F.concat(bare, bracketed), F.lower))
    found = (texts.filter(F.col(text_col).isNotNull())
             .select(*columns, F.explode(names).alias("_term")))
    return (found.join(_distinct_terms(terms, term_col, scope), [*scope, "_term"])
            .select(*keys, term_col))
