"""BPE, ranked search and vector codes against plain versions."""

from __future__ import annotations

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from estatescope.llm import bpe, ranked_search, vector_codes
from estatescope.llm.registry import QUERIES
from test_llm import awkward_texts, by_id, table


# BPE

@pytest.fixture(scope="module")
def coder():
    return bpe.Encoder(bpe.Vocabulary(bpe.vocabulary_file(None)), bpe.newer_characters()), \
        Tokenizer.from_file(bpe.VOCABULARY)


def numbers(packed: bytes) -> list[int]:
    return np.frombuffer(packed, "<u4").tolist()


def test_bpe_of_characters_in_every_neighbourhood(coder):
    """All up to U+2FFF, from there on those at the borders of newer ranges and every 31st."""
    encoder, library = coder
    newer = set(map(ord, bpe.newer_characters()))
    border = {c + d for c in newer if c - 1 not in newer or c + 1 not in newer for d in (-1, 0, 1)}
    codes = [c for c in range(0x110000) if (c < 0x3000 or c % 31 == 0 or c in border) and not 0xD800 <= c < 0xE000]
    for at in range(0, len(codes), 5000):
        text = "".join(f"a{c}1{c}!{c}  {c} x" for c in map(chr, codes[at:at + 5000]))
        assert numbers(encoder.encode(text)) == library.encode(text, add_special_tokens=False).ids, hex(codes[at])


def test_bpe_of_random_texts_and_ids(coder):
    encoder, library = coder
    rng = random.Random(1)
    parts = ["a", "b", "the", " ", "  ", "\n", " ", "　", "'s", "'LL", "1", "٣", "é", "é", "<|endoftext|>",
             "<|endoftext", "|>", "\x1c", "\x85", "​", "😀", "\x00", "!", "-", "中", "ſ", "\U00033479", "՘", "ing"]
    for _ in range(4000):
        text = "".join(rng.choices(parts, k=rng.randint(0, 30)))
        packed, ids = encoder.encode(text), library.encode(text, add_special_tokens=False).ids
        assert numbers(packed) == ids, text
        assert bpe.decode(packed, encoder.vocabulary.strings) == library.decode(ids, skip_special_tokens=False)
    for _ in range(1000):  # ill-formed bytes and ids that nothing has
        ids = rng.choices([*range(50257), 60000], k=rng.randint(0, 12))
        got = bpe.decode(np.array(ids, "<u4").tobytes(), encoder.vocabulary.strings)
        assert got == library.decode(ids, skip_special_tokens=False)


def test_bpe_of_long_words_and_of_stretches(coder, monkeypatch):
    encoder, library = coder
    rng = random.Random(2)
    for text in ("a" * 50_000, "".join(rng.choices("abcdefgh", k=50_000)), "é" * 9_999):
        assert numbers(encoder.encode(text)) == library.encode(text, add_special_tokens=False).ids
    monkeypatch.setattr(bpe, "STRETCH", 7)
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    for _ in range(300):
        text = "".join(rng.choices(["ab", " ", "  ", "\n\n", "'s", "12", "!!", "x" * 20, "<|endoftext|>", "é"], k=40))
        assert numbers(encoder.encode(text)) == library.encode(text, add_special_tokens=False).ids


def test_bpe_merges_lowest_rank_first_and_skips_stale_entries():
    ranks, results = {(1, 2): 0, (2, 1): 1, (12, 12): 2, (1, 1): 3}, [12, 21, 99, 11]
    assert bpe.merged([1, 2, 1, 2, 1], ranks, results) == [99, 1]
    assert bpe.merged([1, 1, 1], ranks, results) == [11, 1]
    assert bpe.merged([], {}, []) == [] and bpe.merged([7], ranks, results) == [7]


def test_bpe_rows(spark, coder):
    library = coder[1]
    rows = [*enumerate([*awkward_texts(), "a<|endoftext|>b"]), (3, "again"), (None, "no id")]
    docs = table(spark, rows, clashing=True).withColumn("ids", F.lit("clash")).repartition(3)
    both = bpe.decoded(bpe.encode(docs))
    got = Counter((r.doc_id, tuple(numbers(bytes(r.ids))), r.text) for r in both.collect())
    want = Counter((i, tuple(x := library.encode(t or "", add_special_tokens=False).ids),
                    library.decode(x, skip_special_tokens=False)) for i, t in rows)
    assert got == want
    lists = by_id(bpe.token_ids(bpe.encode(table(spark, [(1, "one two"), (2, None)]))), "ids")
    assert lists == {1: (library.encode("one two").ids,), 2: ([],)}
    assert bpe.decoded(bpe.encode(table(spark, []))).collect() == []


def test_bpe_refuses_other_kinds_of_vocabularies(spark):
    with open(bpe.VOCABULARY.replace("byte_bpe_50k", "word_bpe_49k"), "rb") as file, pytest.raises(ValueError):
        bpe.Vocabulary(file.read())
    with pytest.raises(FileNotFoundError, match="vocabulary="):
        bpe.vocabulary_file("/nowhere.json")


def test_op11_digests(spark, coder, tmp_path):
    texts = [*awkward_texts(), "x<|endoftext|>"]
    table(spark, enumerate(texts)).write.parquet(f"{tmp_path}/documents.parquet")
    got = by_id(QUERIES["op11_bpe"](spark, str(tmp_path)), "n_tokens", "ids_sha256", "decoded_sha256")
    for i, text in enumerate(texts):
        ids = coder[1].encode(text or "", add_special_tokens=False).ids
        back = coder[1].decode(ids, skip_special_tokens=False)
        assert got[i] == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                          hashlib.sha256(back.encode()).hexdigest())


# Ranked search

def terms_of(text):
    out, word = [], ""
    for c in (text or "") + " ":
        if c >= "\x80" or c.isalnum():
            word += c.lower() if c < "\x80" else c
        elif word:
            out.append(word)
            word = ""
    return out


def brute_search(docs, items, top):
    counts = [(d, Counter(terms_of(t))) for d, t in docs]
    counts = [(d, c, sum(c.values())) for d, c in counts if c]
    n, length = len(counts), sum(x for *_, x in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    out = Counter()
    for item, text in items:
        asked, found = Counter(terms_of(text)), []
        for d, c, size in counts:
            m = 100 - 25 + (25 * size * n) // length
            score = sum(q * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))
                        * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t, q in asked.items() if t in c)
            if score > 0:
                found.append((-score, d is None, d or 0))
        for rank, (score, none, d) in enumerate(sorted(found)[:top], 1):
            out[item, rank, None if none else d, -score] += 1
    return out


def searched(spark, docs, items, top=20):
    df = table(spark, items, clashing=True).withColumnRenamed("doc_id", "item_id")
    found = ranked_search.ranked(table(spark, docs, clashing=True).repartition(4), df, top)
    return Counter((r.item_id, r["rank"], r.doc_id, r.score) for r in found.collect())


def corpus(rng, n):
    words = [f"w{i}" for i in range(300)] + ["Ä", "the", "THE"]
    topic = [rng.sample(words, 25) for _ in range(12)]
    return [(i, " ".join(rng.choice(rng.choice([topic[i % 12], words])) for _ in range(rng.randint(1, 60))))
            for i in range(n)]


def test_search_equals_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    docs = corpus(rng, 700) + list(enumerate(awkward_texts(), 700))
    docs += [(2000 + i, docs[5][1]) for i in range(60)] + [(5, docs[5][1]), (None, docs[5][1]), (9000, None)]
    items = [(i, " ".join(docs[rng.randrange(700)][1].split()[:20])) for i in range(40)]
    items += [(90, None), (91, ""), (92, "unknown terms only"), (93, docs[5][1]), (93, docs[5][1]), (94, "the THE the"),
              (95, docs[5][1].upper()), (None, "Ä w1")]
    want = brute_search(docs, items, 20)
    assert searched(spark, docs, items) == want
    monkeypatch.setattr(ranked_search, "CELLS", 2000)  # several blocks of items, several walks in a task
    monkeypatch.setattr(ranked_search, "SORTED", 100)
    monkeypatch.setattr(ranked_search, "STRETCH", 5)
    assert searched(spark, docs, items) == want


def test_search_of_empty_tables(spark):
    assert not searched(spark, [], [(1, "a")])
    assert not searched(spark, [(1, "a")], [])
    assert not searched(spark, [(1, None), (2, "..")], [(1, "a")])
    assert searched(spark, [(1, "b"), (2, "A")], [(7, "a")], 1) == brute_search([(1, "b"), (2, "A")], [(7, "a")], 1)


def _batch(rng, documents, terms):
    """Leaves as the table holds them, of documents that share topics."""
    import pyarrow as pa
    rows, values = [], np.zeros((documents, terms), np.int64)
    for d in range(documents):
        own = rng.sample(range(d * 8 // documents * terms // 8, (d * 8 // documents + 1) * terms // 8), 10)
        values[d, own] = [rng.randint(1, 9 * 10**5) for _ in own]
    for leaf in range(0, documents, ranked_search.LEAF):
        block = values[leaf:leaf + ranked_search.LEAF]
        term = [np.flatnonzero(v) for v in block]
        top = np.flatnonzero(block.max(axis=0))
        rows.append({"leaf": leaf, "doc_ids": [leaf + i for i in range(len(block))], "sizes": [len(t) for t in term],
                     "terms": np.concatenate(term).tolist(), "impacts": np.concatenate([v[t] for v, t in zip(block, term)]).tolist(),
                     "top_terms": top.tolist(), "top_impacts": block.max(axis=0)[top].tolist()})
    return values, pa.RecordBatch.from_pylist(rows)


@pytest.mark.parametrize("factor", [1, 10**8])
def test_walk_prunes_and_is_exact(factor):
    """With ``factor`` the scores leave the range that doubles hold exactly."""
    rng = random.Random(4)
    values, batch = _batch(rng, 2048, 400)
    items = ranked_search.Items(
        {str(i).encode(): i for i in range(400)}, np.repeat(np.arange(64), 12),
        np.array([t for i in range(64) for t in rng.sample(range(i // 8 * 50, i // 8 * 50 + 50), 12)]),
        np.array([rng.randint(1, 3) for _ in range(64 * 12)]), [str(i) for i in range(64)])
    tree = ranked_search.ItemTree(items, np.array([rng.randint(0, 9000) for _ in range(400)]) * factor)
    assert tree.exact == (factor == 1)
    best = ranked_search.Best(np.zeros(64, np.int64), 20)
    walk = ranked_search.Walk(tree, batch, best)
    walk.run()
    best.cut()
    scores = tree.dense @ values.T
    want = {(i, d, s) for i in range(64) for s, d in sorted((-s, d) for d, s in enumerate(scores[i].tolist()) if s)[:20]}
    assert {(i, d, -s) for a, b, ids in best.rows for i, s, d in zip(a.tolist(), b.tolist(), ids)} == want
    assert walk.pairs < 64 * batch.num_rows // 2 and walk.scored < 64 * batch.num_rows // 4
    again = ranked_search.Walk(tree, batch, ranked_search.Best(best.bounds, 20))  # with bounds from elsewhere
    again.run()
    assert again.pairs <= walk.pairs
    again.best.cut()
    assert {(i, d, -s) for a, b, ids in again.best.rows for i, s, d in zip(a.tolist(), b.tolist(), ids)} == want


# Vector codes

def brute_codes(rows, positions=4, entries=256, rounds=4):
    rows = [(i, v, label) for i, v, label in rows
            if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    rows = sorted(((i, [math.floor(1024 * c) for c in v], label) for i, v, label in rows),
                  key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    rows = [r for r in rows if len(r[1]) == len(rows[0][1])]
    if not rows:
        return Counter()
    width = -(-len(rows[0][1]) // positions)
    data = np.array([r[1] + [0] * (positions * width - len(r[1])) for r in rows], np.int64).reshape(len(rows), positions, width)
    books = [data[:entries, p].copy() for p in range(positions)]

    def assign():
        every = [((data[:, p, None] - books[p]) ** 2).sum(axis=2) for p in range(positions)]
        return [d.argmin(axis=1) for d in every], sum(d.min(axis=1) for d in every)

    for _ in range(rounds):
        codes, _ = assign()
        for p in range(positions):
            for e in range(len(books[p])):
                mine = data[codes[p] == e, p]
                if len(mine):
                    books[p][e] = [int(s) // len(mine) for s in mine.sum(axis=0)]
    codes, error = assign()
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e.tolist()).encode()).hexdigest()
    labels = Counter()
    for r, e in zip(rows, error.tolist()):
        labels[r[2]] += e
    return Counter((r[0], "".join(f"{codes[p][i]:02x}" for p in range(positions)), int(error[i]), labels[r[2]], digest)
                   for i, r in enumerate(rows))


def vectors(spark, rows, kind="float"):
    df = spark.createDataFrame([(i, v, label, "clash") for i, v, label in rows],
                               f"vec_id bigint, embedding array<{kind}>, label int, own string")
    for name in ("x", "parts", "error", "code", "n", "slot", "_label", "sums"):
        df = df.withColumn(name, F.lit("clash"))
    return df


def coded(df, **options):
    codes, books = vector_codes.compressed(df, **options)
    return Counter((r.vec_id, bytes(r.own).hex(), r.error, r.label_error, books.digest())
                   for r in vector_codes.with_label_error(codes).collect())


@pytest.mark.parametrize("spread", [0.3, 0.004])
def test_codes_equal_brute_force(spark, spread):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 16))
    data = (centres[rng.integers(0, 40, 1500)] + rng.normal(size=(1500, 16)) * spread).astype(np.float32)
    rows = [(int(i), [float(x) for x in v], int(rng.integers(0, 3)) or None) for i, v in enumerate(data)]
    rows += [(5, rows[7][1], 1), (None, rows[9][1], 2), (None, rows[3][1], None)]
    rows += [(2000 + i, rows[3][1], 1) for i in range(300)]
    rows += [(3000, None, 1), (3001, [None] * 16, 1), (-5, [float("nan")] + [0.0] * 15, 1), (-6, [float("inf")] * 16, 1),
             (3002, [0.0] * 7, 1), (3003, [], None)]
    rng.shuffle(rows)
    assert coded(vectors(spark, rows).repartition(5)) == brute_codes(rows)


def test_codes_of_ties_short_tables_and_uneven_lengths(spark):
    rng = random.Random(6)
    grid = [(i, [rng.randint(-2, 2) / 1024 for _ in range(8)], i % 2) for i in range(900)]
    assert coded(vectors(spark, grid, "double").repartition(3)) == brute_codes(grid)
    few = [(i, [rng.random() for _ in range(10)], None) for i in range(5)]
    assert coded(vectors(spark, few, "double")) == brute_codes(few)
    assert not coded(vectors(spark, []))
    assert not coded(vectors(spark, [(1, None, 1)]))
    assert coded(vectors(spark, [(1, [], 1), (2, [], 1)])) == Counter(
        (i, "00000000", 0, 0, hashlib.sha256(b"").hexdigest()) for i in (1, 2))
    large = [(i, [1e30 if i == 3 else float(i), -2000.0 * i, 0.5, 2.0], i) for i in range(9)]
    assert len(coded(vectors(spark, large, "double"))) == 9
    assert coded(vectors(spark, grid, "double"), positions=2, entries=16, rounds=2) == brute_codes(grid, 2, 16, 2)


def test_ball_steps_are_exact_and_save_work():
    rng = np.random.default_rng(7)
    for spread, high in ((3, 1 << 10), (200, 1 << 10), (5, 1 << 24)):
        centres = rng.integers(-high, high, (64, 4))
        parts = centres[rng.integers(0, 64, 3000)] + rng.integers(-spread, spread + 1, (3000, 4))
        entries = parts[:64].copy()
        entries[9] = entries[3]  # twins
        own = rng.integers(0, 64, 3000)
        for turn in range(4):
            chosen, best, counts = vector_codes.ball_step(parts, entries, vector_codes.squared(entries, entries), own)
            want, least = vector_codes.nearest(parts, entries)
            slow = ((parts[:, None] - entries) ** 2).sum(axis=2)
            assert (want == slow.argmin(axis=1)).all() and (least == slow.min(axis=1)).all()
            assert (chosen == want).all() and (best == least).all()
            own = chosen
        assert counts["compared"] < 0.6 * 64 * 3000
        assert spread > 5 or counts["stable"] > 300
