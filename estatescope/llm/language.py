"""Language identification (10): error-correcting output codes over n-grams.

Each language has a codeword of bits that differs from every other one in many places.  For each bit
one binary classifier tells from the n-grams of a text whether the language is among those with a
one: a naive Bayes margin per n-gram, from counts over *all* labelled texts.  Decoding adds for
each language the logistic losses of its bits, weighted by how surely each classifier tells its
two sides apart in training, and takes the nearest codeword; a small lead over the next one flags the text as ambiguous.

Training is one pass and one sum over (language, n-gram); the model has a fixed number of n-gram
buckets times the number of languages and is the only thing that reaches the driver.

Null texts and texts without a letter are ``und`` with score 0, as is everything if no labelled text is
there; equal texts get equal answers (ties go to the language first in code point order); an empty
table gives an empty table; only named columns are read, so others may have any name.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from estatescope.llm.registry import query, read
from estatescope.llm.texts import flat, mixed, pieces

#: Buckets for n-grams, as a power of two; n-gram lengths in bytes of letters.
BUCKET_BITS, LENGTHS = 12, (1, 2, 3, 4)
#: Bytes of a text that are counted at once.
CHUNK = 1 << 20
UNKNOWN = "und"
#: Below this score a text is flagged as ambiguous.
SURE = 0.6


class Model(NamedTuple):
    languages: list[str]
    codes: np.ndarray  # languages x bits, +1 or -1
    weights: np.ndarray  # buckets x bits, log odds
    trust: np.ndarray  # bits, weight of each classifier's loss


def codewords(n: int) -> np.ndarray:
    """n rows of +1 and -1.  The exhaustive code (every split of the languages once) up to 7 of
    them, beyond that the rows of a binary code of at least 4 log2 n random columns, whose rows are distinct."""
    if n <= 7:
        splits = range(1, 2 ** max(n - 1, 1))
        return np.array([[1 if i == 0 or not s >> (i - 1) & 1 else -1 for s in splits]
                         for i in range(n)], dtype=np.float64)
    bits = max(16, 4 * int(np.ceil(np.log2(n))))
    seed = np.random.default_rng(n)
    best = max((seed.choice([-1.0, 1.0], (n, bits)) for _ in range(50)),
               key=lambda c: -np.max(c @ c.T - np.eye(n) * 2 * bits))
    return best


def _letter_table() -> np.ndarray:
    """Bytes to lower-case letters; anything else below 128 becomes a blank."""
    table = np.full(256, 0x20, np.uint8)
    for i in range(26):
        table[0x41 + i] = table[0x61 + i] = 0x61 + i
    table[128:] = np.arange(128, 256)
    return table


LETTERS = _letter_table()


def gram_counts_of(data: np.ndarray, bits: int = BUCKET_BITS, chunk: int = CHUNK) -> np.ndarray:
    """How many n-grams of one text fall to each bucket; runs of other characters than letters count as one blank.

    Texts are counted a chunk at a time, so a long one costs a few bytes for each of its own."""
    x = LETTERS[data]
    blank = np.array([0x20], np.uint8)
    x = np.concatenate([blank, x[(x != 0x20) | np.roll(x != 0x20, 1)], blank])
    out = np.zeros(1 << bits, np.int64)
    for start in range(0, len(x), chunk):
        part = x[start:start + chunk + max(LENGTHS) - 1].astype(np.uint64)
        code = np.zeros(len(part), np.uint64)
        for n in range(1, max(LENGTHS) + 1):
            code = (code[:len(part) - n + 1] << np.uint64(8)) | part[n - 1:]
            if n in LENGTHS:
                out += np.bincount((mixed(code[:chunk], n) >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    return out


def _has_letter(text: str | None) -> bool:
    return text is not None and any(c.isalpha() for c in text)


def gram_counts(labelled: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, bucket, n): how often each n-gram bucket occurs in the texts of each language."""
    rows = labelled.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"))
    rows = rows.where("lang IS NOT NULL AND text IS NOT NULL")

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for piece in pieces(batches, "text"):
            data, at = flat(piece.column("text"))
            for i, name in enumerate(piece.column("lang").to_pylist()):
                found = gram_counts_of(data[at[i]:at[i + 1]])
                totals[name] = totals.get(name, 0) + found
        for name, found in totals.items():
            buckets = np.flatnonzero(found)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(buckets), pa.string()), pa.array(buckets, pa.int32()),
                 pa.array(found[buckets], pa.int64())], ["lang", "bucket", "n"])

    return rows.mapInArrow(count, "lang string, bucket int, n bigint").groupBy("lang", "bucket") \
        .agg(F.sum("n").alias("n"))


def trained(labelled: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """The model of all labelled rows.  What is collected: at most languages x buckets counts."""
    counted = gram_counts(labelled, text, lang).toPandas()
    languages = sorted(counted["lang"].unique())
    if not languages:
        return Model([], np.zeros((0, 0)), np.zeros((1 << BUCKET_BITS, 0)), np.zeros(0))
    table = np.zeros((len(languages), 1 << BUCKET_BITS))
    row = counted["lang"].map({x: i for i, x in enumerate(languages)})
    table[row, counted["bucket"]] = counted["n"]
    codes = codewords(len(languages))
    share = (table + 0.5) / (table + 0.5).sum(axis=1, keepdims=True)
    weights = np.zeros((table.shape[1], codes.shape[1]))
    trust = np.ones(codes.shape[1])
    for bit, column in enumerate(codes.T):
        if (column > 0).all() or (column < 0).all():
            continue
        one, other = share[column > 0].mean(axis=0), share[column < 0].mean(axis=0)
        weights[:, bit] = np.log(one / other)
        # How far apart the mean margins of the two sides are: the classifier's own certainty.
        trust[bit] = np.sum((one - other) * weights[:, bit])
    return Model(languages, codes, weights, trust / max(trust.sum(), 1e-9))


def decoded(model: Model, margins: np.ndarray, scale: float) -> np.ndarray:
    """Share of each language (rows add up to 1) from the weighted losses of its bits."""
    loss = np.logaddexp(0, -scale * margins[:, None, :] * model.codes[None])
    total = (loss * model.trust).sum(axis=2) * len(model.trust)
    share = np.exp(total.min(axis=1, keepdims=True) - total)
    return share / share.sum(axis=1, keepdims=True)


def identify(docs: DataFrame, model: Model, *keep: str, text: str = "text", scale: float = 12.0,
             sure: float = SURE) -> DataFrame:
    """The kept columns of ``docs`` with ``lang_pred``, ``score`` and ``ambiguous``.

    Only the text is looked at.  The model is sent to the tasks: fixed buckets x code bits."""
    rows = docs.select(*keep, F.col(text).cast("string").alias("_text_"))
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]]
                       + ["lang_pred string", "score double", "ambiguous boolean"])

    def predict(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for piece in pieces(batches, "_text_"):
            column = piece.column("_text_")
            data, at = flat(column)
            known = np.array([bool(m.languages) and _has_letter(t) for t in column.to_pylist()], bool)
            margins = np.zeros((piece.num_rows, m.codes.shape[1]))
            for i in np.flatnonzero(known):
                found = gram_counts_of(data[at[i]:at[i + 1]])
                margins[i] = found / found.sum() @ m.weights
            best, score = np.zeros(piece.num_rows, int), np.zeros(piece.num_rows)
            if m.languages:
                share = decoded(m, margins, scale)
                best, score = share.argmax(axis=1), np.where(known, share.max(axis=1), 0.0)
            names = [m.languages[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)]
            arrays = [piece.column(i) for i in range(len(keep))]
            arrays += [pa.array(names, pa.string()), pa.array(score, pa.float64()), pa.array(score < sure)]
            yield pa.RecordBatch.from_arrays(arrays, [*keep, "lang_pred", "score", "ambiguous"])

    return rows.mapInArrow(predict, schema)


def fold(doc_id: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4))


@query("op10_language_id")
def op10_language_id(spark: SparkSession, path: str) -> DataFrame:
    docs = read(spark, path, "documents")
    held_out = F.coalesce(fold() == 2, F.lit(False))
    model = trained(docs.where(~held_out))
    rows = docs.select("doc_id", held_out.alias("held_out"), "text")
    return identify(rows, model, "doc_id", "held_out")
