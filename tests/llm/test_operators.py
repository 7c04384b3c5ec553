"""The training-data operators against brute force on small tables, odd rows included."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from conftest import SMALL
from logloom.llm import (
    arc_warc,
    line_dedup,
    mixing,
    packing,
    pii,
    quality_rules,
    queries,
    simhash,
    similar,
    substring_suffix,
    token_counts,
    topk,
)
from oracle import compare, connect

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, anchor string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def odd_texts() -> list[str | None]:
    """Missing, empty, long, repeated and strange texts."""
    rng = random.Random(7)
    words = ["".join(rng.choices("abcdeé漢", k=rng.randint(1, 8))) for _ in range(400)]
    prose = [" ".join(rng.choices(words, k=n)) + "." for n in (3, 12, 60, 300)]
    passage = " ".join(rng.choices(words, k=90))
    return [
        None, "", " \t\n", "x", "x", *prose, prose[2], f"{prose[1]} {passage} {prose[2]}", f"{passage} tail",
        "a" * 3000, " ".join(rng.choices(words, k=9000)), "A b c\x85d e\x1cf  g \n", "<|endoftext|> <s> ▁▁x ▁",
        "call +1 (778) 555-8933 or me@ex.org. 4111 1111 1111 1111 at 10.0.0.255, 10.0.0.256",
        "1" * 5000 + " a@b" * 50 + " x@y.z" + ".z" * 3000, f"{prose[3]}\n{prose[3]}\n",
    ]


@pytest.fixture(scope="module")
def odd(spark):
    """The odd texts with clashing columns, missing keys, and one row three times."""
    texts = odd_texts()
    rows = [(i, t, "en" if i % 2 else None, ["a", "b", None][i % 3], 0, 1, "z") for i, t in enumerate(texts)]
    rows += [rows[8]] * 2 + [(None, "no id at all", None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def texts_of(docs) -> list[tuple]:
    return [(r.doc_id, r.text or "") for r in docs.collect()]


def rows_of(df) -> Counter:
    return Counter(tuple(r) for r in df.collect())


# --- counts and packing -------------------------------------------------------


def brute_measure(text: str) -> tuple[int, ...]:
    words, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if seen[g] > 1 for k in range(5)}
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered)


def test_quality_counts(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, None)], "doc_id long, quality int")
    got = quality_rules.quality_rules(odd, labels).collect()
    assert Counter((r.doc_id, *r[2:7]) for r in got) == Counter((i, *brute_measure(t)) for i, t in texts_of(odd))
    for r in got:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert r.kept == (not r.base_failed)  # so few labels certify nothing
    assert quality_rules.quality_rules(empty, labels).count() == 0
    kept = quality_rules.quality_filter(odd, labels)
    assert kept.columns == odd.columns and kept.count() == sum(r.kept for r in got)


def test_bound_is_exact():
    # With no rejections the bound is a closed form: (1 - alpha)^n <= delta.
    assert quality_rules.holds(0, 299, 0.01, 0.05) and not quality_rules.holds(0, 298, 0.01, 0.05)
    assert quality_rules.holds(1, 473, 0.01, 0.05) and not quality_rules.holds(1, 472, 0.01, 0.05)
    assert not quality_rules.holds(0, 0, 0.5, 0.5)


def test_certified_cutoffs_reject_few_good_ones(spark):
    rows = [(i, "word " * 5 + " ".join(f"w{i}x{k}" for k in range(20)), "en") for i in range(2000)]
    rows += [(5000 + i, " ".join(f"b{i}x{k}###" for k in range(20)), "en") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = docs.select("doc_id", (F.col("doc_id") < 5000).cast("int").alias("quality"))
    got = quality_rules.quality_rules(docs, labels).filter("NOT kept").select("doc_id").collect()
    assert {r.doc_id for r in got} == set(range(5000, 5200))


def test_small_strata_are_certified(spark):
    """A few hundred good labels do for a stratum, and every one of 36 has a bound of its own."""
    names = [f"l{i:02d}" for i in range(36)]
    prose = lambda i: " ".join(f"w{i}x{k}" for k in range(20))
    rows, labels = [], []
    for at, name in enumerate(names):
        for i in range(205):
            key, good = 1000 * at + i, i < 190
            # Good documents of the last stratum look like bad ones of the others.
            marked = not good or name == "l35"
            rows.append((key, " ".join(f"{w}###" for w in prose(key).split()) if marked else prose(key), name))
            labels.append((key, int(good)))
    rows += [(10**6, prose(-1), "none"), (10**6 + 1, prose(-2), None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = quality_rules.quality_rules(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    assert {r.lang for r in got if r.certified} == set(names[:-1])
    gone = {key for key, good in labels if not good and key < 35000}
    assert {r.doc_id for r in got if not r.kept} == gone


def test_shares_of_delta_add_up():
    sizes = Counter(n.bit_count() for n in range(1, 1 << len(quality_rules.RULES)))
    assert abs(sum(n * quality_rules._share(k) for k, n in sizes.items()) - 1) < 1e-12


def test_token_counts(odd, empty):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    pieces = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    fast = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for name, count in (
        ("piece_bpe_32k.model", lambda t: len(pieces.encode(t))),
        ("byte_bpe_50k.json", lambda t: len(fast.encode(t, add_special_tokens=False).ids)),
    ):
        got = token_counts.count_tokens(odd, public_tokenizers.path(name), limit=20, batch_bytes=500, chunk_bytes=40)
        want = [(i, len(t.encode()), n := count(t), n > 20) for i, t in texts_of(odd)]
        assert rows_of(got) == Counter(want)
    assert token_counts.count_tokens(empty, public_tokenizers.path("piece_bpe_32k.model")).count() == 0


def test_packing(odd, empty):
    from tokenizers import Tokenizer

    fast = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = packing.pack_documents(odd, RANKS, public_tokenizers.PATTERN, 256).collect()
    want = Counter()
    for i, text in texts_of(odd):
        ids = [*fast.encode(text, add_special_tokens=False).ids, 2]
        first = (len(ids) - 1) % 256 + 1
        cuts = [0, *range(first, len(ids) + 1, 256)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            raw = b"".join(x.to_bytes(4, "little") for x in ids[a:b])
            want[i, k, a, b - a, zlib.crc32(raw)] += 1
    assert Counter(tuple(r)[:5] for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 256
    assert packing.pack_documents(empty, RANKS, public_tokenizers.PATTERN).count() == 0


def test_best_two_fit():
    rng = random.Random(3)
    for _ in range(50):
        lengths = [rng.randint(1, 100) for _ in range(rng.randint(0, 200))]
        bins = packing.best_two_fit(lengths, 100)
        assert sorted(x for b in bins for x in b) == list(range(len(lengths)))
        assert all(sum(lengths[x] for x in b) <= 100 for b in bins)
    # Greedy fills 60 + 30; 30 is replaced by 20 + 20, which fills the bin.
    assert [sorted(b) for b in packing.best_two_fit([60, 30, 20, 20], 100)] == [[0, 2, 3], [1]]


# --- duplicates ---------------------------------------------------------------


def brute_fingerprint(text: str) -> int:
    words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(text)]
    grams = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(values: list[int], near: int = 4) -> dict[int, int]:
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a in root:
        for b in root:
            if (a ^ b).bit_count() <= near and find(a) != find(b):
                root[find(a)] = find(b)
    return {v: find(v) for v in root}


def test_simhash(odd, empty):
    docs = texts_of(odd)
    marks = [(i, brute_fingerprint(t)) for i, t in docs]
    root = roots([m for _, m in marks])
    least = defaultdict(list)
    for i, m in marks:
        least[root[m]] += [i] if i is not None else []
    want = Counter((i, f"{m:016x}", min(least[root[m]], default=None)) for i, m in marks)
    assert rows_of(simhash.near_duplicates(odd)) == want
    kept = simhash.drop_near_duplicates(odd)
    assert kept.columns == odd.columns and kept.count() == len({w[2] for w in want})
    assert simhash.near_duplicates(empty).count() == 0


def test_simhash_links_random_balls(spark):
    """Chains and dense balls of fingerprints: every link's component is found."""
    rng = random.Random(5)
    values = set()
    for _ in range(12):
        value = rng.getrandbits(64)
        for _ in range(30):
            values.add(value)
            flips = rng.sample(range(64), rng.randint(1, 5))
            value ^= sum(1 << b for b in flips)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    table = spark.createDataFrame([(v,) for v in signed], "bits long")
    found = {r.a % 2**64: r.b % 2**64 for r in simhash.links(table).collect()}
    assert all((a ^ b).bit_count() <= 4 for a, b in found.items())
    from logloom.llm.components import components

    got = {r.node % 2**64: r.root % 2**64 for r in components(simhash.links(table)).collect()}
    want = roots(list(values))
    groups, own = defaultdict(set), defaultdict(set)
    for v in values:
        groups[want[v]].add(v)
        own[got.get(v, v)].add(v)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, own.values()))


def brute_groups(texts: list[str]) -> list[set[int]]:
    """Places of texts that pairs of 0.8 or more in their 5-word shingles join."""
    sets = []
    for text in texts:
        words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(text)]
        sets.append({tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set()))
    groups: list[set[int]] = []
    for i, own in enumerate(sets):
        near = [g for g in groups if any(sets[j] == own or 5 * len(own & sets[j]) >= 4 * len(own | sets[j]) > 0 for j in g)]
        groups = [g for g in groups if g not in near] + [set().union({i}, *near)]
    return groups


def test_similar_documents(spark, odd, empty):
    """Against exact similarity: pairs that are far apart in bits, groups around one text, chains."""
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(10**6)}"
    texts = []
    for changes in (0, 1, 2, 3, 4, 5, 6):
        for _ in range(6):
            base = [word() for _ in range(120)]
            texts.append(" ".join(base))
            for _ in range(3):
                base = list(base) if changes < 4 else base
                for at in rng.sample(range(120), changes):
                    base[at] = word()
                texts.append(" ".join(base))
    base = [word() for _ in range(100)]
    texts += [" ".join(base[:k] + [word()] + base[k + 1 :]) for k in range(0, 100, 2) for _ in range(2)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    want = sorted(min(g) for g in brute_groups(texts))
    assert [r.doc_id for r in similar.drop_similar(docs).orderBy("doc_id").collect()] == want
    marks = roots([brute_fingerprint(t) for t in texts])
    assert len(want) < len(set(marks.values()))
    kept = similar.drop_similar(odd)
    assert kept.columns == odd.columns and kept.count() == len(brute_groups([t for _, t in texts_of(odd)]))
    assert similar.drop_similar(empty).count() == 0


@pytest.mark.parametrize("drop", [simhash.drop_near_duplicates, similar.drop_similar])
def test_rows_without_an_id_of_their_own(spark, drop):
    """Missing and shared ids: every text stays once."""
    texts = [" ".join(f"t{i}w{k}" for k in range(30)) for i in range(7)]
    rows = [(None, texts[0], "a"), (None, texts[1], "a"), (None, texts[1], "b"), (1, texts[2], "a"), (1, texts[3], "a"),
            (1, texts[4], "a"), (0, texts[4], "a"), (2, texts[5], "a"), (2, texts[5], "a"), (None, texts[5], "a"),
            (None, texts[6], None), (None, texts[6], None)]
    got = drop(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert Counter(r.text for r in got) == Counter(texts)
    assert {(r.doc_id, texts.index(r.text)) for r in got} == {(None, 0), (None, 1), (1, 2), (1, 3), (0, 4), (2, 5), (None, 6)}


@pytest.mark.parametrize("most", [10**9, 40, 1])
def test_covered_bytes(spark, odd, most, monkeypatch):
    monkeypatch.setattr(substring_suffix, "_BATCH", 2048)
    # A passage that many texts hold, whole or cut, between words of their own or of a few kinds.
    rng = random.Random(12)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(2, 9)))
    passage, sides = " ".join(word() for _ in range(60)), [" ".join(word() for _ in range(30)) for _ in range(3)]
    rows = []
    for i in range(120):
        own = [rng.choice([*sides, " ".join(word() for _ in range(30))]) for _ in range(2)]
        cut = passage[rng.choice([0, 0, 40]) : rng.choice([None, None, 260])]
        rows.append((1000 + i, f"{own[0]} {cut} {own[1]}", None, None, None, None, None))
    odd = odd.unionAll(spark.createDataFrame(rows, SCHEMA)).repartition(3)
    docs = [(i, t.encode()) for i, t in texts_of(odd)]
    seen = Counter(t[p : p + 200] for _, t in docs for p in range(len(t) - 199))
    read = odd.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    read = read.select("doc_id", F.xxhash64("text").alias("copy"), F.col("text").cast("binary").alias("text"))
    got = defaultdict(set)
    for r in substring_suffix.covered(read, most).collect():
        for s in r.spans:
            got[r.doc_id].update(range(s.start, s.end))
    want = defaultdict(set)
    for i, t in docs:
        for p in range(len(t) - 199):
            if seen[t[p : p + 200]] > 1:
                want[i].update(range(p, p + 200))
    assert got == want


def test_suffix_rows(odd, empty):
    got = substring_suffix.remove_repeats(odd, keep_text=True).collect()
    assert Counter((r.doc_id, r.n_bytes) for r in got) == Counter((i, len(t.encode())) for i, t in texts_of(odd))
    for r in got:
        assert r.n_bytes - r.n_removed == len(r.kept) and hashlib.sha256(r.kept).hexdigest() == r.kept_sha256
    assert substring_suffix.remove_repeats(empty).count() == 0


def test_line_dedup_odd_rows(odd, empty):
    got = line_dedup.dedup_units(odd).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in texts_of(odd))
    for r in got:
        spans = [tuple(map(int, s.split(":"))) for s in r.removed.split(",") if s]
        assert len(spans) == r.n_removed and sum(b - a for a, b in spans) == r.n_chars_removed
    # The passage stays where it came first.
    removed = {r.doc_id: r.n_removed for r in got}
    assert removed[7] == 0 and removed[9] == 1
    assert line_dedup.dedup_units(empty).count() == 0


def test_line_dedup_by_hand(spark):
    """Short lines, paragraphs, sentences in other lines, one text twice, missing ids."""
    rng = random.Random(11)
    said = [" ".join(rng.choices("abcdé", k=n)) + rng.choice([".", "!", ""]) for n in (1, 2, 4, 5, 6, 9)]
    lines = [rng.choice([" ", "  "]).join(rng.choices(said, k=rng.randint(1, 3))) for _ in range(14)]
    rows = [(i, "\n".join(rng.choices([*lines, "", "\t"], k=rng.randint(0, 8)))) for i in range(60)]
    rows += [(100, "Total: four words here"), (101, "x y\nTotal:  four words here\n\n"), (None, lines[0]), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    seen, want = set(), {}
    for i, text in rows:
        at, spans, units = 0, [], 0
        for line in (text or "").splitlines(keepends=True):
            words = WORD.findall(line)
            whole = (0, *words)
            if words and whole in seen:
                spans.append((at, at + len(line)))
            start = at
            for part in re.split(r"(?<=[.!?] )", line):
                own = (1, *WORD.findall(part))
                if len(own) > 5:
                    if own in seen and not (words and whole in seen):
                        spans.append((start, start + len(part)))
                    seen.add(own)
                start += len(part)
            units += bool(words)
            if words:
                seen.add(whole)
            at += len(line)
        want.setdefault(i, []).append((units, ",".join(f"{a}:{b}" for a, b in spans)))
    got = defaultdict(list)
    for r in line_dedup.dedup_units(docs).collect():
        got[r.doc_id].append((r.n_units, r.removed))
    assert {i: sorted(v) for i, v in got.items()} == {i: sorted(v) for i, v in want.items()}
    assert got[101] == [(2, "4:28")]


# --- search, personal data, archives, mixing ----------------------------------


def test_top_k_odd_vectors(spark):
    rng = random.Random(2)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(6)]) for i in range(0, 300, 5)]
    rows += [(200, [float("nan")] * 6), (300, None), (400, [None] * 6), (1, rows[0][1]), (2, rows[0][1]), (500, [1.0]),
             (None, rows[0][1]), (600, [1e12] * 2), (700, [-1e12, 1e3]), (800, []), (900, [])]
    # Rows that share an id, with another vector and with the same one, and many copies of one vector.
    rows += [(100, rows[3][1]), rows[40], rows[40]] + [(1000 + i, rows[7][1]) for i in range(60)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = [(i, [int(1024 * x // 1) for x in v]) for i, v in rows if i is not None and v is not None and None not in v and all(x == x for x in v)]
    want = Counter()
    for at, (i, q) in enumerate(whole):
        if i % 100 == 0:
            score = lambda v: min(max(sum(a * b for a, b in zip(q, v)), 1 - 2**63), 2**63 - 1)  # noqa: B023, E731
            scored = sorted((-score(v), j) for n, (j, v) in enumerate(whole) if n != at and len(v) == len(q))
            want.update((i, n, j, -s) for n, (s, j) in enumerate(scored[:4], 1))
    for shard_rows, block_rows, first in ((8192, 8192, 4), (7, 3, 1)):
        got = topk.top_k(table, k=4, least_shards=5, shard_rows=shard_rows, block_rows=block_rows, first_shards=first)
        got = Counter(map(tuple, got.collect()))
        assert (got - want, want - got) == ({}, {})
    assert topk.top_k(table.limit(0)).count() == 0


def luhn(digits: str) -> bool:
    return sum((2 * d - 9 * (d > 4)) if i % 2 else d for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def brute_base(text: str) -> list[tuple[int, int, int]]:
    patterns = (
        r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]",
    )
    found = []
    for kind, pattern in enumerate(patterns):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = (
                True,
                kind == 1 and all(int(p) <= 255 for p in m[0].split(".")),
                12 <= len(digits) <= 19 and luhn(digits),
                9 <= len(digits) <= 15,
            )[kind]
            found += [(m.start(), kind, m.end())] if good else []
    return sorted(found)


def test_personal_data(spark, odd, empty):
    rng = random.Random(4)
    bits = ["a@b.c", "_d@e.f.g", "@", ".", "1.2.3.4", "5.6", "+1", "(22) 3", "33-44 5", "4111111111111111", " ", "x", "é😀"]
    rows = [(i, "".join(rng.choices(bits, k=rng.randint(0, 14)))) for i in range(400)]
    extra = spark.createDataFrame(rows, "doc_id long, text string")
    for docs in (extra, odd):
        got = pii.find_personal_data(docs, "doc_id", "text").collect()
        assert Counter(r.doc_id for r in got) == Counter(i for i, _ in texts_of(docs))
        for r in got:
            assert [tuple(s) for s in r.base] == brute_base(r.text or ""), r.text
            assert set(r.base) <= set(r.spans)
    assert pii.personal_data(empty).count() == 0
    masked = {r.doc_id: r.text for r in pii.mask_documents(odd).collect()}
    assert "me@ex.org" not in masked[17] and "555-8933" not in masked[17] and masked[3] == "x"


def test_personal_data_by_context(spark):
    """Words before known entities find identifiers of another form."""
    rows = [(i, f"contact: user{i}@mail.org and more") for i in range(40)]
    rows += [(100, "contact: ZX-99-88-ABQ today"), (101, "version: 2024-build-77 today")]
    got = {r.doc_id: r.spans for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[100] == "found:9:21" and got[101] == ""


def test_arc_and_warc(spark, tmp_path):
    pages = [(1, "http://a b/ü", "<p>"), (2, None, "<p>"), (3, "u", None), (4, "u", ""), (5, "u", "x\r\n\r\ny" * 9)]
    pages += [(5, "u", "x\r\n\r\ny" * 9), (6, "u", "漢\n" * 40000)]
    table = spark.createDataFrame(pages, "page_id long, url string, html string")
    first = {}
    for key, _, html in sorted(pages, key=lambda p: p[0]):
        first.setdefault(html or "", key)
    want = Counter()
    for key, _, html in pages:
        raw = (html or "").encode()
        other = first[html or ""] if first[html or ""] != key else None
        want[key, len(raw), arc_warc.digest(raw), "revisit" if other else "response", other] += 1
    for version in (1, 2):
        arc, warc = f"{tmp_path}/arc{version}", f"{tmp_path}/warc{version}"
        arc_warc.write_arc(table, arc, version)
        arc_warc.arc_to_warc(spark, arc, warc)
        assert rows_of(arc_warc.read_pages(spark, warc)) == want


def test_mixing(odd, empty):
    docs = odd.collect()
    size = lambda t: len(WORD.findall(t or ""))
    got = mixing.mix(odd, block=16).collect()
    assert Counter((r.doc_id, r.source, r.size) for r in got) == Counter((d.doc_id, d.source, size(d.text)) for d in docs)
    totals = defaultdict(int)
    for d in docs:
        totals[d.source] += size(d.text)
    names = sorted(totals, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    full: set = set()
    while True:
        rest = 1.5 * sum(totals.values()) - sum(2 * totals[s] for s in full)
        even = rest / max(1, sum(weight[s] for s in names if s not in full))
        over = {s for s in names if s not in full and even * weight[s] > 2 * totals[s]}
        if not over:
            break
        full |= over
    taken = defaultdict(int)
    for r in got:
        want = 2 * totals[r.source] if r.source in full else even * weight[r.source]
        assert abs(r.target - want) < 1e-6 and r.source_size == totals[r.source] and 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
        target = {r.source: r.target for r in got}
    assert all(abs(taken[s] - target[s]) <= 64 + 0.02 * target[s] for s in names)
    assert rows_of(mixing.mix(odd, block=16)) == Counter(map(tuple, got))
    mixed = mixing.mix_documents(odd, block=16)
    assert mixed.columns == odd.columns
    assert sum(size(r.text) for r in mixed.collect()) == sum(taken.values())
    assert mixing.mix(empty).count() == 0 and mixing.mix_documents(empty).count() == 0


def test_mixing_small_sources(spark):
    """At the block of the query each source has its target to the word."""
    rows = [(i, " ".join(["w"] * 20), f"s{i:04d}") for i in range(300)] + [(300, " ".join(["w"] * 130), "t")]
    rows += [(1000 + i, " ".join(["w"] * 500), "z") for i in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs).collect()
    taken = Counter()
    for r in got:
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 2 * r.size
    assert all(abs(taken[r.source] - r.target) <= 0.5 for r in got) and min(taken.values()) > 0


def brute_takes(docs: list[tuple], shares: dict, block: int, golden: float, order: list[int]) -> dict[int, int]:
    """Words taken per row number: the slots dealt one after another, word by word."""
    words = sum(s["goal"] for s in shares.values())
    places, count, taken = {}, Counter(), Counter()
    for slot in range(-(-words // block)):
        point = (slot + 0.5) * golden % 1.0
        for key, s in shares.items():
            if s["low"] <= point < s["high"]:
                places.setdefault(key, (point - s["low"]) / (s["high"] - s["low"]))
                count[key] += 1
    for key, s in shares.items():
        stream = [(i, w) for i in order if docs[i][0] == key for w in range(docs[i][1])]
        if not stream:
            continue
        at = int(places.get(key, 0.0) * len(stream))
        first = next(k for k in range(at, -1, -1) if stream[k][1] == 0)
        for k in range(s["goal"]):  # dealt slots, cut or followed by what settles the rest
            taken[stream[(first + k) % len(stream)][0]] += 1
    return taken


@pytest.mark.parametrize("golden", [0.6180339887498949, 0.41421356237309515])
def test_mixing_takes_what_its_slots_take(spark, golden, monkeypatch):
    """Per document against the schedule dealt word by word; other points, another mix."""
    monkeypatch.setattr(mixing, "_GOLDEN", golden)
    rng = random.Random(11)
    rows = [(i, " ".join(["w"] * rng.randint(0, 60)), rng.choice("aabcd")) for i in range(300)]
    rows += [(400 + i, "x y", f"s{i}") for i in range(12)] + [(500, "w " * 3000, "a"), (501, None, "e"), (502, "w", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sized = mixing._sized(docs, 42)
    shares = mixing.sources(sized)
    share = {r["key"]: r.asDict() | {"goal": round(r["target"])} for r in shares.withColumn("target", mixing.goal()).collect()}
    placed = mixing._placed(sized, shares).collect()
    table = [(r["key"], r["size"]) for r in placed]
    order = sorted(range(len(table)), key=lambda i: (placed[i]["start"], -placed[i]["size"]))
    want = brute_takes(table, share, 16, golden, order)
    got = {r.doc_id: r for r in mixing.mix(docs, block=16).collect()}
    assert {placed[i]["doc_id"]: want[i] for i in range(len(table))} == {i: r.taken for i, r in got.items()}
    monkeypatch.setattr(mixing, "_GOLDEN", 0.7320508075688772)
    other = {r.doc_id: r.taken for r in mixing.mix(docs, block=16).collect()}
    assert other != {i: r.taken for i, r in got.items()} and sum(other.values()) == sum(r.taken for r in got.values())


def test_mixed_documents_stand_in_the_order_of_slots(spark):
    rows = [(i, " ".join([f"w{i}"] * 40), "ab"[i % 2]) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    slot = {r.doc_id: r.slot for r in mixing.mix(docs).collect()}
    seen: dict[int, int] = {}
    for place, r in enumerate(mixing.mix_documents(docs).collect()):
        seen.setdefault(r.doc_id, place)
    order = [slot[i] for i in sorted(seen, key=seen.get)]
    assert order == sorted(order) and set(seen) == {i for i, s in slot.items() if s is not None}
    # Both sources run through the whole mix.
    half = [i % 2 for i in sorted(seen, key=seen.get)[: len(seen) // 2]]
    assert 0.25 < sum(half) / len(half) < 0.75


def test_stages_keep_columns_of_any_name(spark):
    """Values of columns that operators use themselves come out as they came in."""
    names = ["spans", "base", "copy", "kept", "n_words", "size", "taken", "_row", "_id", "_number", "row", "_stratum",
             "_cutoffs", "base_failed", "doc", "slot", "number", "order", "key", "n", "_of", "_doc", "_kept", "more"]
    rows = [(i, f"t{i} " + " ".join(f"w{i}x{k}" for k in range(30)) + (f" me{i}@ex.org" if i % 2 else ""), "en", "s",
             *(f"{n}{i}" for n in names)) for i in range(40)]
    schema = ", ".join(["doc_id long", "text string", "lang string", "source string", *(f"{n} string" for n in names)])
    docs = spark.createDataFrame(rows, schema)
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    for stage in (
        lambda d: quality_rules.quality_filter(d, labels), similar.drop_similar, simhash.drop_near_duplicates,
        pii.mask_documents, mixing.mix_documents,
    ):
        after = stage(docs)
        assert after.columns == docs.columns
        got = after.collect()
        assert len({r.doc_id for r in got}) >= 38
        assert all(r[n] == f"{n}{r.doc_id}" for r in got for n in names)


@pytest.mark.parametrize("tile", [1 << 17, 600])
def test_groups_without_all_pairs(spark, tile, monkeypatch):
    """Many texts near one text and far from each other, in several tiles."""
    monkeypatch.setattr(similar, "_TILE", tile)
    rng = random.Random(9)
    base = [f"b{k}" for k in range(100)]
    texts = [" ".join(base)]
    for _ in range(150):
        own = list(base)
        at = rng.randrange(2, 94)
        own[at : at + 4] = [f"x{rng.randrange(10**6)}" for _ in range(4)]
        texts.append(" ".join(own))
    texts += [" ".join(base[:50] + [f"y{i}z{k}" for k in range(50)]) for i in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    want = sorted(min(g) for g in brute_groups(texts))
    assert len(want) == 41
    assert [r.doc_id for r in similar.drop_similar(docs).orderBy("doc_id").collect()] == want


# --- registered queries -------------------------------------------------------


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query(spark, name):
    assert compare(spark, connect(SMALL), name, queries.QUERIES[name], queries.ORACLES[name], SMALL) == ""


def test_pipeline(spark):
    """Stage by stage, what each has to leave of what it gets."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = corpus_pipeline.saved(stage(spark, docs, SMALL), name)
        assert after.columns == columns
        if name == "quality":
            words = F.size(F.regexp_extract_all("text", F.lit(WORD.pattern), F.lit(0)))
            assert after.count() < docs.count() and after.filter(words < 10).count() == 0
        if name == "near_dedup":
            before = texts_of(docs)
            least = [min(before[j][0] for j in group) for group in brute_groups([t for _, t in before])]
            assert Counter(r.doc_id for r in after.collect()) == Counter(least)
        if name == "personal_data":
            assert after.count() == docs.count()
            assert not any(brute_base(t) for _, t in texts_of(after))
        docs = after
    assert corpus_pipeline.run(spark, SMALL).count() == corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).count()
