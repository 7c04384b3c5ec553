"""Language identification, vector codes and periodic runs against brute force."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

from conftest import SMALL
from logloom.llm import language_id, periodic_runs, pii, queries, similar, vector_codes

SCHEMA = "doc_id long, text string, lang string, n_runs int, start string, code long, score string"


def rows_of(df) -> Counter:
    return Counter(tuple(r) for r in df.collect())


# --- periodic runs ------------------------------------------------------------


def brute_runs(words: list) -> list[tuple[int, int, int]]:
    found = []
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            if length >= max(6, 4 * q) and not any(words[i : i + length - r] == words[i + r : i + length] for r in range(1, q)):
                found.append((i, length, q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def brute_collapse(doc_id, text) -> tuple:
    words = (text or "").encode().split()
    n = len(words)
    if doc_id is not None and n and (h := zlib.crc32(str(doc_id).encode())) % 10 == 0:
        a = (h // 10) % n
        p = 1 + (n - a) // (3 + (h // 10) % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    power = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *power, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def periodic_texts(rng: random.Random) -> list[str | None]:
    texts = [None, "", " \n\t", "a", "a " * 5, "a " * 6, "a b " * 4, "a b a b a b a", "x " * 300 + "y " * 300]
    texts += ["a a a a a a b a a a a a a b a a a a a a b a a a a a a b", "é漢 \x85x é漢 \x85x " * 9, "a\x1cb " * 8]
    for _ in range(120):
        words = [rng.choice("abc"[: rng.randint(1, 3)]) for _ in range(rng.randint(0, 80))]
        at, p = rng.randint(0, len(words)), rng.randint(1, 12)
        words = words[:at] + [words[at + (i - at) % p] if at + (i - at) % p < len(words) else "z" for i in range(at, len(words))]
        texts.append(" ".join(words))
    return texts


def test_periodic_runs(spark, monkeypatch):
    for batch, step in ((1 << 17, 1 << 21), (50, 16)):
        monkeypatch.setattr(periodic_runs, "_BATCH", batch)
        monkeypatch.setattr(periodic_runs, "_STEP", step)
        texts = periodic_texts(random.Random(batch))
        rows = [(i, t, None, 1, "s", 2, "x") for i, t in enumerate(texts)] + [(None, "a " * 9, None, None, None, None, None)] * 2
        docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
        assert rows_of(periodic_runs.collapse_runs(docs)) == Counter(brute_collapse(r[0], r[1]) for r in rows)
        assert periodic_runs.collapse_runs(docs.limit(0)).count() == 0


def test_periodic_runs_of_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    short = {r.doc_id: r.text for r in docs if r.text is None or len(r.text) < 3000}
    got = {r.doc_id: tuple(r) for r in queries.QUERIES["op13_periodic_runs"](spark, SMALL).collect()}
    assert len(got) == len(docs) and len(short) > 100
    assert all(got[i] == brute_collapse(i, t) for i, t in short.items())


# --- vector codes -------------------------------------------------------------


def brute_codes(rows: list[tuple]) -> Counter:
    kept = [(i, label, [int(1024 * x // 1) for x in v]) for i, v, label in rows if v is not None and all(x is not None and abs(x) < float("inf") for x in v)]
    width = -(-max((len(v) for _, _, v in kept), default=0) // 4) * 4
    kept = [(i, label, v + [0] * (width - len(v))) for i, label, v in kept]
    d = width // 4
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[2]))[:256]
    books = [[v[p * d : p * d + d] for _, _, v in first] for p in range(4)]
    near = lambda p, v: min(
        (sum((a - b) ** 2 for a, b in zip(v[p * d : p * d + d], entry)), k) for k, entry in enumerate(books[p])
    )
    for _ in range(4):
        for p in range(4):
            own = defaultdict(list)
            for _, _, v in kept:
                own[near(p, v)[1]].append(v[p * d : p * d + d])
            books[p] = [[sum(c) // len(own[k]) for c in zip(*own[k])] if k in own else e for k, e in enumerate(books[p])]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    found = [(i, label, [near(p, v) for p in range(4)]) for i, label, v in kept]
    total = Counter()
    for _, label, parts in found:
        total[label] += sum(e for e, _ in parts)
    return Counter((i, "".join(f"{k:02x}" for _, k in ps), sum(e for e, _ in ps), total[label], digest) for i, label, ps in found)


def test_vector_codes(spark, monkeypatch):
    monkeypatch.setattr(vector_codes, "_SHARD", 64)
    monkeypatch.setattr(vector_codes, "_LEAF", 4)
    rng = random.Random(6)
    rows = [(i, [rng.choice([-0.5, 0.25, 0.001 * rng.randint(-400, 400)]) for _ in range(8)], i % 3 or None) for i in range(300)]
    rows += [(1000 + i, rows[7][1], 5) for i in range(200)] + [rows[3]] * 2  # a hot vector, repeated rows
    rows += [(None, [0.5] * 8, None), (2000, None, 1), (2001, [None] * 8, 1), (2002, [float("nan")] * 8, 1)]
    rows += [(2003, [float("inf")] + [0.0] * 7, 1), (2004, [0.5], 2), (-5, [], 2), (-6, [-0.001] * 8, None)]
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, label int, code string, n int")
    assert rows_of(vector_codes.compress_vectors(table.repartition(4))) == brute_codes(rows)
    assert vector_codes.compress_vectors(table.limit(0)).count() == 0
    odd = [(i, [0.1 * i] * 3, None) for i in range(5)] + [(9, [3e30, -3e30, 1.0], 1)]
    got = vector_codes.compress_vectors(spark.createDataFrame(odd, "vec_id long, embedding array<float>, label int"))
    assert got.count() == 6


def test_vector_codes_of_the_table(spark):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    assert rows_of(queries.QUERIES["op12_vector_codes"](spark, SMALL)) == brute_codes(rows)


# --- languages ----------------------------------------------------------------


def test_languages_of_documents(spark):
    """Held-out documents get their language, and what is learned hangs on nothing held out."""
    folder = SMALL.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    langs = {r.doc_id: r.lang for r in docs.collect()}
    got = queries.QUERIES["op11_language_id"](spark, folder).collect()
    assert Counter(r.doc_id for r in got) == Counter(list(langs))
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in got)
    for name in {"de", "en", "es", "fr"}:
        own = [r for r in got if r.held_out and langs[r.doc_id] == name]
        assert sum(r.lang_pred == name for r in own) >= 0.97 * len(own) > 20
    hidden = docs.withColumn("lang", language_id.F.when(language_id.held_out(), "xx").otherwise(language_id.F.col("lang")))
    again = language_id.identify_languages(hidden.withColumn("source", language_id.F.lit("s")))
    assert rows_of(again) == Counter(tuple(r) for r in got)


def test_languages_odd_rows(spark):
    rows = [(i, f"{'ouch le la' if i % 2 else 'the and of'} {i}", "fr" if i % 2 else "en", 1, "s", 1, "1") for i in range(90)]
    rows += [(1000, None, "en", 1, None, 1, None), (1001, "", "en", 1, None, 1, None), (1002, "12 ²½ _!", None, 1, None, 1, None)]
    rows += [(None, "the of and", "zz", 1, None, 1, None)] * 2 + [(1003, "le la " * 60000, None, 1, None, 1, None), (1004, "THE AND", None, 1, None, 1, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = language_id.identify_languages(docs).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert all(by[i].lang_pred == ("fr" if i % 2 else "en") for i in range(90))
    assert all(tuple(by[i])[2:] == ("und", 0.0, False) for i in (1000, 1001, 1002))
    assert by[1003].lang_pred == "fr" and by[1004].lang_pred == "en" and by[None].lang_pred == "en" and not by[None].held_out
    assert language_id.identify_languages(docs.limit(0)).count() == 0
    unlabelled = docs.withColumn("lang", language_id.F.lit(None).cast("string"))
    assert {r.lang_pred for r in language_id.identify_languages(unlabelled).collect()} == {"und"}
    one = language_id.identify_languages(docs.filter("lang = 'en'")).collect()
    assert {(r.lang_pred, r.score) for r in one} == {("en", 1.0), ("und", 0.0)}


@pytest.mark.parametrize("languages", [0, 1, 2, 4, 6, 7, 40])
def test_codewords_are_apart(languages):
    code = language_id.codewords(languages)
    assert len(code) == languages
    apart = [int((code[a] != code[b]).sum()) for a in range(languages) for b in range(a)]
    assert min(apart, default=1) >= {0: 1, 1: 1, 2: 1}.get(languages, 2)
    if languages > 2:  # one wrong bit at least is corrected
        assert min(apart) >= 2 and np.abs(code.sum(0, dtype=int)).max() < languages


def test_wrong_bits_are_corrected():
    code = language_id.codewords(6)
    model = language_id.Model(list("abcdef"), code, np.zeros((language_id.CELLS, code.shape[1]), np.float32), np.ones(code.shape[1]))
    for row, word in enumerate(code):
        bits = word.astype(np.float32).copy()
        bits[:5] *= -1
        model.odds[:] = bits
        assert model.predict("some text")[0] == "abcdef"[row]


# --- personal data ------------------------------------------------------------


def test_personal_data_counts_each_kind(spark):
    """The numbers per kind are those of the kind, wherever its spans stand among the others."""
    email, ip, card, phone = "ann@example.org", "10.1.2.3", "4111 1111 1111 1111", "+49 (30) 123-4567"
    texts = ["none", f"{phone}, {phone}, {email}", f"{ip}; {email}; {ip}; {email}; {email}", f"{card}, {ip}", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_email, r.n_ip, r.n_card, r.n_phone) for r in pii.personal_data(docs).collect()}
    assert got == {0: (0, 0, 0, 0), 1: (1, 0, 0, 2), 2: (3, 2, 0, 0), 3: (0, 1, 1, 0), 4: (0, 0, 0, 0)}


# --- near duplicates ----------------------------------------------------------


def test_fingerprints_find_what_no_band_does(spark):
    """Two texts of 80 % that share no MinHash band but whose fingerprints differ in 4 bits at most."""
    head = " ".join(f"w693x{i}" for i in range(12))
    one, other = f"{head} e9", f"{head} e5"
    sets = [similar.shingle_set(text, 5) for text in (one, other)]
    assert len(np.intersect1d(*sets)) == 8 and len(np.union1d(*sets)) == 10
    assert not set(similar.bands(sets[0])) & set(similar.bands(sets[1]))
    texts = [one, other, "far from both of them", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in similar.drop_similar(docs).collect()) == [0, 2, 3]
