"""Each operator against a brute-force version, a library or held-out labels, on small tables."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from sieveline.llm import conversations, decontamination, fingerprints, line_dedup, mixing, ngram_join, quality, sharding, token_counts, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
BLANK = re.compile(r"[\x20\x09-\x0D]+")


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def words(s):
    return [w for w in BLANK.split(lower(s or "")) if w]


def shingles(s, k):
    w = words(s)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def table(spark, texts, first=0):
    return spark.createDataFrame([(first + i, t, "en" if i % 3 else "de", f"src{i % 4}", len(t or "")) for i, t in enumerate(texts)], SCHEMA)


@pytest.fixture(scope="module")
def varied():
    """Copies, near copies, shared passages, short, empty, null, blank and long texts, in many sizes."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 6))) for _ in range(300)]
    passage = " ".join(rng.choices(vocabulary, k=40))
    out = [None, "", " \t\n", "one", "One", "one two", "ONE  two", "a b c", "A\tb\nc"]
    for size in (3, 5, 9, 11, 20, 40, 41, 80, 150, 400):
        base = rng.choices(vocabulary, k=size)
        out += [" ".join(base)] * 3
        for edits in (1, 1, 2, 3, 5, 8):
            near = list(base)
            for _ in range(edits):
                near[rng.randrange(len(near))] = rng.choice(vocabulary)
            out.append(" ".join(near))
        out.append(passage + "\n" + " ".join(rng.choices(vocabulary, k=size)))
    group = rng.choices(vocabulary, k=120)
    for _ in range(60):  # more than a small bucket
        near = list(group)
        for _ in range(rng.randint(0, 4)):
            near[rng.randrange(len(near))] = rng.choice(vocabulary)
        out.append(" ".join(near))
    out.append(" ".join(rng.choices(vocabulary, k=30_000)))
    return out


def brute_components(texts, k, tn, td):
    sets = [shingles(t, k) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        a, b = sets[i], sets[j]
        if a and b and min(len(a), len(b)) * td >= tn * max(len(a), len(b)):
            x = len(a & b)
            if td * x >= tn * (len(a) + len(b) - x):
                p, q = sorted((find(i), find(j)))
                root[q] = p
    return {i: (len(s), find(i)) for i, s in enumerate(sets)}


def brute_links(texts, k, tn, td):
    sets, links = [shingles(t, k) for t in texts], [0] * len(texts)
    for i, j in itertools.combinations(range(len(texts)), 2):
        x = len(sets[i] & sets[j])
        if x and td * x >= tn * (len(sets[i]) + len(sets[j]) - x):
            links[i] += 1
            links[j] += 1
    return links


@pytest.mark.parametrize("k,tn,td", [(3, 90, 100), (5, 80, 100), (1, 50, 100)])
def test_ngram_join_equals_brute_force(spark, varied, k, tn, td):
    rows = ngram_join.near_duplicates(table(spark, varied), k, tn, td).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == brute_components(varied, k, tn, td)
    assert {r.doc_id: r.n_links for r in rows} == dict(enumerate(brute_links(varied, k, tn, td)))


@pytest.mark.parametrize("k,tn,td", [(3, 90, 100), (5, 80, 100)])
def test_ngram_join_in_small_blocks_and_salted_keys(spark, varied, k, tn, td, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 7)
    monkeypatch.setattr(ngram_join, "KEY_CLASSES", 1)
    monkeypatch.setattr(ngram_join, "SAMPLE", 2)
    monkeypatch.setattr(ngram_join, "BROADCAST_IDS", 0)
    rows = ngram_join.near_duplicates(table(spark, varied), k, tn, td).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == brute_components(varied, k, tn, td)
    assert {r.doc_id: r.n_links for r in rows} == dict(enumerate(brute_links(varied, k, tn, td)))
    rows = ngram_join.near_duplicates(table(spark, varied), k, tn, td, count=False).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == brute_components(varied, k, tn, td) and {r.n_links for r in rows} == {None}


def test_ngram_join_links_texts_without_an_id(spark):
    words_ = [f"w{i}" for i in range(100)]
    near = " ".join(words_[:-1] + ["other"])
    rows = [(None, " ".join(words_)), (None, " ".join(words_)), (4, near), (None, near + " x"), (None, "quite alone here"), (None, None)]
    got = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90, 100).collect()
    assert sorted(((r.doc_id or 0, r.component_id or 0, r.n_links) for r in got)) == [(0, 0, 0), (0, 0, 0), (0, 4, 3), (0, 4, 3), (0, 4, 3), (4, 4, 3)]

def test_tiles_lose_no_pair():
    rng = np.random.default_rng(0)
    for tn, td in ((90, 100), (80, 100)):
        for n in (1, 2, 5, 10, 18, 19, 30, 57, 120, 500):
            for _ in range(20):
                x = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
                most = int(len(x) * (td - tn) / (td + tn))
                drop = rng.integers(0, most + 1)
                y = np.unique(np.concatenate([x[drop:], rng.integers(0, 2**64, rng.integers(0, most - drop + 1), dtype=np.uint64)]))
                h = np.sort(rng.choice(np.union1d(x, y), int(rng.integers(0, len(x) + 1)), replace=False))
                hot = (h, rng.integers(1, 5, len(h)))
                both = len(np.intersect1d(x, y))
                if not np.array_equal(x, y) and td * both >= tn * (len(x) + len(y) - both):
                    assert len(np.intersect1d(ngram_join.tile_keys(x, hot, tn, td)[0], ngram_join.tile_keys(y, hot, tn, td)[0]))


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(1)
    lines = ["Common Line", " common line\t", "Ünïcode ÀB", "ünïcode Àb", "", "  ", "x", "rare one", "HELLO"] + [f"l{i}" for i in range(12)]
    texts = [None, "", "\n", "x"] + ["\n".join(rng.choices(lines, k=rng.randint(1, 9))) for _ in range(60)]
    key = lambda s: lower(s.strip(" \t\n\v\f\r"))
    found = {}
    for i, t in enumerate(texts):
        for s in (t or "").split("\n"):
            found.setdefault(key(s), set()).add(i)
    want = {}
    for i, t in enumerate(texts):
        all_lines = (t or "").split("\n")
        kept = [s for s in all_lines if not (key(s) and len(found[key(s)]) >= 10)]
        want[i] = (len(all_lines), len(all_lines) - len(kept), "\n".join(kept))
    for batches, fanout in ((4, 2), (1, 2), (5, 3)):
        got = line_dedup.drop_frequent_lines(table(spark, texts), 10, batches, fanout)
        assert {r.doc_id: (r.n_lines, r.n_dropped, r.kept) for r in got.collect()} == want


def test_line_dedup_counts_documents_not_rows(spark):
    rows = table(spark, ["same line"] * 9).union(table(spark, ["same line"] * 3))
    assert {r.n_dropped for r in line_dedup.drop_frequent_lines(rows).collect()} == {0}


def test_line_dedup_counts_rows_without_an_id_as_one_document(spark):
    for ids, dropped in (([None, -1, *range(8)], 1), ([None, None, *range(8)], 0)):
        rows = spark.createDataFrame([(i, "same line") for i in ids], "doc_id long, text string")
        assert {r.n_dropped for r in line_dedup.drop_frequent_lines(rows).collect()} == {dropped}


def test_line_runs_are_joined_as_they_are_sorted(spark):
    runs = line_dedup.LineRuns(spark, 2, 3)
    lines = spark.createDataFrame([(i, i % 7 + 1, i % 5 + 1) for i in range(100)], "doc_id long, a long, b int")
    with line_dedup.sorted_buckets(spark):
        runs.add(lines)
        plan = runs.undecided(runs.counts(lines))._jdf.queryExecution().sparkPlan().toString() + runs.undecided(runs.counts(lines))._jdf.queryExecution().executedPlan().toString()
        side = plan[plan.rindex("SortMergeJoin") :]
        side = side[side.rindex("Project") :] if "Project" in side else side
        assert "Bucketed: true" in side and "Exchange" not in side and "Sort [" not in side
        runs.add(lines.where("a > 3").withColumn("doc_id", lines["doc_id"] + 1000))
        assert {(r.a, r.b) for r in runs.frequent().collect()} == {(i % 7 + 1, i % 5 + 1) for i in range(100)}
    runs.close()


@pytest.mark.parametrize("digits,finer", [(4, 2), (1, 1)])
def test_sharding_is_minimax(spark, monkeypatch, digits, finer):
    monkeypatch.setattr(sharding, "DIGITS", digits)
    monkeypatch.setattr(sharding, "FINER", finer)
    rng = random.Random(2)
    texts = ["".join(rng.choices("ab", k=rng.randint(0, 60))) for _ in range(150)] + ["big copy"] * 40 + [None, "", "é" * 30]
    got = sharding.shard(table(spark, texts), 5).collect()
    assert sorted(r.doc_id for r in got) == list(range(len(texts)))
    groups = {}
    for r in got:
        groups.setdefault(r.g, set()).add(r.shard)
        t = texts[r.doc_id] or ""
        assert r.size == len(t.encode()) + 1
    assert all(len(s) == 1 for s in groups.values())
    loads = {}
    for r in got:
        loads[r.shard] = loads.get(r.shard, 0) + r.size
        assert 0 <= r.shard < 5
    sizes = {}
    for r in got:
        sizes[r.g] = sizes.get(r.g, 0) + r.size
    ordered = [sizes[g] for g in sorted(sizes)]

    def feasible(c):
        n, at = 1, 0
        for s in ordered:
            if s > c:
                return False
            if at + s > c:
                n, at = n + 1, 0
            at += s
        return n <= 5

    best = next(c for c in range(sum(ordered) + 1) if feasible(c))
    assert max(loads.values()) == best
    for s in loads:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))


def test_snapshot_collapse(spark):
    base = [("user", "hi"), ("assistant", "hello"), ("user", "more"), ("assistant", "fine")]
    logged = {1: base[:2], 2: base, 3: base, 4: base[:1], 5: [("user", "hi"), ("assistant", "other")], 6: base[:2], 7: [("user", None)], 8: [("user", "")]}
    rows = [(c, i, r, t) for c, turns in logged.items() for i, (r, t) in enumerate(turns)]
    rows += [(2, 0, "user", "hi")]  # a repeated row
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in conversations.render_maximal(df).collect()}
    assert set(got) == {2, 5, 7, 8}
    assert got[2].n_logged == 2 and got[2].n_turns == 4 and got[2].chat == "<|user|>\nhi\n<|assistant|>\nhello\n<|user|>\nmore\n<|assistant|>\nfine\n"


def test_snapshot_collapse_across_blocks(spark):
    long = [(1, i, "user", f"t{i}") for i in range(2500)]
    part = [(2, i, "user", f"t{i}") for i in range(2100)]
    other = [(3, i, "user", f"t{i}" if i != 1500 else "changed") for i in range(2100)]
    df = spark.createDataFrame(long + part + other, "conv_id long, turn long, role string, text string")
    assert {r.conv_id for r in conversations.collapse(df).collect()} == {1, 3}


def test_token_counts_equal_the_library(spark):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    rng = random.Random(3)
    signs = list("abRrVvLlEeSsTtDdMm''' !?.,12é́éİΣσςß\u0085½Ⅷ漢字<|>\n\t\x1c") + ["<|endoftext|>", "'re", "'ll", "'ve", "'s", "'RE"]
    texts = [None, "", " "] + ["".join(rng.choice(signs) for _ in range(rng.randint(0, 60))) for _ in range(1500)] + ["don't stop " * 30_000, "x" * 5000]
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    want = [len(e.ids) for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]
    got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in token_counts.token_counts(table(spark, texts), P.path("word_bpe_49k.json")).collect()}
    assert got == {i: (len((x or "").encode()), n) for i, (x, n) in enumerate(zip(texts, want))}


def test_token_counts_of_all_code_points_and_in_parts(monkeypatch):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    machine, t = token_counts.Transducer(path), Tokenizer.from_file(path)
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for near in ("a{}b", "e{}\u0301", "\u0301{0}'s {0}{0}"):
        texts = ["\n".join(near.format(c) for c in points[i : i + 64]) for i in range(0, len(points), 64)]
        assert machine.count(list(texts)).tolist() == [len(e.ids) for e in t.encode_batch(texts, add_special_tokens=False)]
    rng = random.Random(13)
    texts = ["".join(rng.choices("abcdefgh", k=rng.randint(1, 30))) for _ in range(3000)] + ["ab" * 700, "a" * 701, "aab" * 300, "<|endoftext|>" * 3]
    long = " ".join(texts[:400]) + "\n'll 're don't" * 50
    monkeypatch.setattr(token_counts, "PART", 50)
    for group in ([x] for x in (*texts[-6:], long)):
        assert machine.count(list(group)).tolist() == [len(t.encode(x, add_special_tokens=False).ids) for x in group]
    assert machine.count(list(texts)).tolist() == [len(e.ids) for e in t.encode_batch(texts, add_special_tokens=False)]


def test_containment_equals_brute_force(spark):
    rng = random.Random(4)
    vocabulary = ["".join(rng.choices("abcdef", k=3)) for _ in range(200)]
    items = [" ".join(rng.choices(vocabulary, k=n)) for n in (1, 3, 4, 5, 6, 10, 25, 60)] + [None, "", "  "]
    texts = [None, "", "zz"]
    for it in items[:8]:
        w = it.split()
        for cut in (0, len(w) // 10, len(w) // 3):
            texts.append(" ".join(rng.choices(vocabulary, k=300) + w[cut:] + rng.choices(vocabulary, k=2000)).upper())
    want = {}
    for i, t in enumerate(texts):
        for j, it in enumerate(items):
            k = min(5, len(words(it)))
            if k and words(t):
                a, b = shingles(it, k), shingles(t, k) if len(words(t)) >= k else set()
                if 100 * len(a & b) >= 80 * len(a):
                    want[i, j] = (len(a), len(a & b))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = decontamination.contained(table(spark, texts), bench).collect()
    assert {(r.doc_id, r.item_id): (r.n_item, r.n_found) for r in got} == want and len(want) > 15


def test_fingerprints(spark):
    rng = random.Random(6)
    text = lambda n: "".join(rng.choices("abcdefghij klmnop", k=n))
    texts = [text(n) for n in (0, 3, 30, 300, 3000, 30_000, 500, 501)] + [text(800)] * 2 + [None, "é" * 200, "é" * 200]
    got = sorted(fingerprints.fingerprints(table(spark, texts)).collect(), key=lambda r: r.doc_id)
    assert [r.doc_id for r in got] == list(range(len(texts)))
    full = [t or "" for t in texts]
    of = {}
    for i, r in enumerate(got):
        t, nxt = full[i], full[(i + 1) % len(full)]
        cut = len(t) // 4
        edited = t[: len(t) - cut] + nxt[:cut]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert of.setdefault(t, r.fingerprint) == r.fingerprint
        assert r.edited_fingerprint == plain_fingerprint(edited) and r.fingerprint == plain_fingerprint(t)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        if len(t) >= 300 and t != nxt:
            assert r.near_edited > 0.5 > r.near_next
    assert got[8].near_next == 1


def plain_fingerprint(text):
    """The same fingerprint byte by byte, in whole numbers."""
    data, wide, word = text.encode(), 2**64 - 1, 2**32 - 1
    if not data:
        return "3::"
    powers = {}
    for i in range(len(data)):
        roll = sum((data[i - j] + 1) * pow(0x01000193, j + 1, 2**32) for j in range(7) if i >= j) & word
        roll ^= roll >> 15
        roll = roll * 0x85EBCA6B & word
        roll ^= roll >> 13
        if roll % 3 == 2:
            third = (roll + 1) // 3
            powers[i] = (third & -third).bit_length() - 1
    k = 0
    while 3 * 64 * 2**k < len(data):
        k += 1
    while k and sum(p >= k for p in powers.values()) < 32:
        k -= 1

    def mix(x):
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & wide
        x = (x ^ x >> 27) * 0x94D049BB133111EB & wide
        return x ^ x >> 31

    def signature(p):
        ends = [i + 1 for i, q in powers.items() if q >= p][:63]
        ends += [len(data)] if not ends or ends[-1] < len(data) else []
        out, start = "", 0
        for e in ends:
            out += "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"[mix(sum((c + 1) * pow(0x9E3779B97F4A7C15, j, 2**64) for j, c in enumerate(data[start:e])) & wide) >> 58]
            start = e
        return out

    return f"{3 << k}:{signature(k)}:{signature(k + 1)}"


def test_fingerprint_equals_a_plain_one(monkeypatch):
    rng = random.Random(14)
    texts = ["", "a", "é", "aaaaaaaaaa" * 40] + ["".join(rng.choices("abcdé fgh\n", k=n)) for n in (2, 7, 50, 191, 193, 700, 3000, 9000)]
    for part in (fingerprints.PART, 100, 7):
        monkeypatch.setattr(fingerprints, "PART", part)
        for t in texts[: 20 if part > 50 else 9]:
            assert fingerprints.spelled(fingerprints.of_text(t)) == plain_fingerprint(t)


def test_likeness_is_an_edit_distance():
    rng = random.Random(7)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] if x == y else 10**9))
            row = new
        return row[-1]

    for _ in range(300):
        a = bytes(rng.choices(b"ABCD", k=rng.randint(1, 64)))
        b = bytes(rng.choices(b"ABCD", k=rng.randint(1, 64)))
        got = fingerprints.likeness([(a, b)])[0]
        assert not got or abs(got - (1 - distance(a, b) / (len(a) + len(b)))) < 1e-12


def test_raking_meets_its_targets():
    rng = np.random.default_rng(8)
    codes = [rng.integers(0, n, 200) for n in (5, 3, 4)]
    tokens = rng.integers(1, 1000, 200).astype(float)
    wanted = [(lambda x: x / x.sum())(rng.uniform(0.5, 1, n)) for n in (5, 3, 4)]
    w = mixing.rake(tokens, codes, wanted)
    for c, want in zip(codes, wanted):
        assert np.allclose(np.bincount(c, w, len(want)), want, atol=1e-6)
    p = mixing.calibrate(w, tokens, 0.4)
    assert abs((p * tokens).sum() / tokens.sum() - 0.4) < 1e-6 and p.max() <= 1


def test_mixing_equals_plain_raking_and_meets_its_budget(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    targets = {"lang": {"en": 0.4, "de": 0.2}}
    got = mixing.mix(docs, targets).collect()
    cells = {}
    for r in docs.collect():
        n, t = len([w for w in BLANK.split(r.text or "") if w]), r.text or ""
        kind = "tabular" if t.count("|") * 100 >= len(t) + 1 else "listing" if t.count("\n") * 50 >= len(t) + 1 else "short" if n < 100 else "long" if n >= 1000 else "prose"
        cells[r.source, r.lang, kind] = cells.get((r.source, r.lang, kind), 0) + n
    total, weight = sum(cells.values()), {}
    sums = lambda w, d: {v: sum(x for c, x in w.items() if c[d] == v) for v in {c[d] for c in w}}
    want = []
    for d, name in enumerate(("source", "lang", "topic")):
        seen = sums(cells, d)
        free = [v for v in seen if v not in targets.get(name, {})]
        raw = {v: targets[name].get(v, (1 - sum(targets[name].values())) / len(free)) for v in seen} if name in targets else {v: x**0.7 for v, x in seen.items()}
        want.append({v: x / sum(raw.values()) for v, x in raw.items()})
    weight = {c: x / total for c, x in cells.items()}
    for _ in range(200):
        for d in range(3):
            have = sums(weight, d)
            weight = {c: x * want[d][c[d]] / have[c[d]] if have[c[d]] else x for c, x in weight.items()}
    lo, hi = 0.0, 1e18
    for _ in range(300):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(min(1, mid * weight[c] / x) * x for c, x in cells.items() if x) < 0.6 * total else (lo, mid)
    for r in got:
        c = r.source, r.lang, r.topic
        assert abs(r.weight - weight[c]) < 1e-6 and abs(r.probability - (min(1, hi * weight[c] / cells[c]) if cells[c] else 1)) < 1e-5
    kept = sum(r.n_tokens for r in got if r.sampled)
    spread = sum(r.n_tokens**2 * r.probability * (1 - r.probability) for r in got) ** 0.5
    assert abs(kept - 0.6 * total) < 4 * spread
    for d, name in enumerate(("source", "lang", "topic")):  # realised marginals, within what the draw allows
        for v in want[d]:
            expected = sum(r.n_tokens * r.probability for r in got if r[name] == v)
            spread = sum(r.n_tokens**2 * r.probability * (1 - r.probability) for r in got if r[name] == v) ** 0.5
            assert abs(sum(r.n_tokens for r in got if r.sampled and r[name] == v) - expected) <= 4 * spread
    monkeypatch.setattr(mixing, "CELLS", 0)
    other = {r.doc_id: r for r in mixing.mix(docs, targets).collect()}
    assert all(abs(other[r.doc_id].probability - r.probability) < 1e-6 and other[r.doc_id].sampled == r.sampled for r in got)


def test_mixing_both_ways_agree_on_partial_targets(spark, monkeypatch):
    rows = [(i, "word " * (1 + i % 7 * 40), ("en", "de", "fr", None)[i % 4], f"s{i // 4 % 3}", 0) for i in range(84)]
    docs = spark.createDataFrame(rows, SCHEMA)
    targets = {"lang": {"en": 0.5, "de": 0.2}, "source": {"s0": 0.3}}
    a = {r.doc_id: r for r in mixing.mix(docs, targets).collect()}
    monkeypatch.setattr(mixing, "CELLS", 0)
    b = {r.doc_id: r for r in mixing.mix(docs, targets).collect()}
    assert set(a) == set(b) and min(r.probability for r in b.values()) > 0
    assert max(abs(a[i].probability - b[i].probability) for i in a) < 1e-6 and max(abs(a[i].weight - b[i].weight) for i in a) < 1e-6


def auc(y, s):
    order = np.argsort(s, kind="stable")
    y, s = np.asarray(y)[order], np.asarray(s)[order]
    _, back, n = np.unique(s, return_inverse=True, return_counts=True)
    rank = (np.cumsum(n) - (n - 1) / 2)[back]
    return (rank[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (len(y) - y.sum()))


def test_quality_agrees_with_labels_it_never_saw(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = quality.score(docs).join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet").withColumnRenamed("quality", "label"), "doc_id").collect()
    assert auc([r.label for r in got], [r.quality for r in got]) > 0.97
    assert np.mean([r.keep for r in got if r.label == 1]) > 0.99


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = toxicity.tag(docs, labels).join(labels.drop("quality"), "doc_id").where(toxicity.held_out(labels["doc_id"])).collect()
    assert auc([r.toxic for r in got], [r.score for r in got]) > 0.95
    assert np.mean([r.score >= 0.7 for r in got if r.toxic]) >= 0.9 and np.mean([r.toxic for r in got if r.score >= 0.7]) >= 0.9
    text = {r.doc_id: r.text for r in docs.collect()}
    spans = [text[r.doc_id][s.begin : s.end] for r in got for s in r.spans]
    assert spans and not any(BLANK.match(s[0]) or BLANK.match(s[-1]) for s in spans)


def test_forward_backward_equals_enumeration(monkeypatch):
    rng = np.random.default_rng(9)
    f = toxicity.Field()
    f.jump, f.start, f.bias = rng.normal(size=(2, 2)), rng.normal(size=2), 0.0
    lengths = [1, 4, 0, 6, 2]
    first = np.r_[0, np.cumsum(lengths)]
    e = rng.normal(size=first[-1])
    p, pair = f.pairs(e, first)
    assert np.allclose(f.marginals(e, first), p)
    monkeypatch.setattr(toxicity, "AT_ONCE", 3)
    assert np.allclose(f.marginals(e, first), p)
    for a, b in zip(first[:-1], first[1:]):
        if a == b:
            continue
        total, on = 0.0, np.zeros(b - a)
        for y in itertools.product((0, 1), repeat=b - a):
            s = f.start[y[0]] + sum(e[a + i] for i in range(b - a) if y[i]) + sum(f.jump[y[i - 1], y[i]] for i in range(1, b - a))
            total += np.exp(s)
            on += np.exp(s) * np.array(y)
        assert np.allclose(p[a:b], on / total)


def test_words_lose_all_signs_at_their_ends_and_features_do_not_depend_on_parts(monkeypatch):
    import pyarrow as pa

    texts = ["plain (((((((((((word)))))))))))!!!!!!!!!!! ++++ éa-b.", None, "", "...", "Ünïcode " * 20]
    w = toxicity.Words(pa.array(texts, pa.string()))
    assert [w.data[s:e].tobytes().decode() for s, e in zip(w.s, w.e)][:6] == ["plain", "word", "+", "éa-b", ".", "Ünïcode"]
    whole = w.features(0, len(w.hashes))
    assert np.array_equal(whole, np.concatenate([w.features(i, i + 1) for i in range(len(w.hashes))], axis=1))
    assert (whole[0] != 0).all() and whole[-2][0] == 0 and whole[-1][3] == 0 and whole[-2][5] == 0 and whole[-1][-1] == 0
    units = w.units(3, 4)[:, 0]
    alone = toxicity.Words(pa.array(["éa-b", "éa-bc"], pa.string()))
    assert np.array_equal(alone.units(0, 1)[:, 0], units) and alone.units(1, 2)[1, 0] == units[1] and units[2] == 0


def test_scores_follow_from_marginals_by_plain_sums(spark):
    rows = [(i, f"some plain words number {i} here" + (" vile" if i % 2 else ""), "en", "s", 0) for i in range(60)]
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(60)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, labels)
    field, got = model.field(), toxicity.tag(docs, labels).collect()
    import pyarrow as pa

    for r in got:
        w = toxicity.Words(pa.array([rows[r.doc_id][1]], pa.string()))
        e = np.zeros(len(w.hashes))
        known = dict(zip(model.keys.tolist(), model.weights.tolist()))
        for i in range(len(e)):
            e[i] = sum(known.get(int(x), 0.0) for x in w.features(i, i + 1)[:, 0])
        psi, t, s = np.exp(np.clip(e + field.bias, -30, 30)), np.exp(field.jump), np.exp(field.start)
        f = [np.array([s[0], s[1] * psi[0]])]
        for x in psi[1:]:
            f.append(np.array([f[-1] @ t[:, 0], f[-1] @ t[:, 1] * x]))
        b = [np.ones(2)]
        for x in psi[:0:-1]:
            b.append(np.array([t[0, 0] * b[-1][0] + t[0, 1] * x * b[-1][1], t[1, 0] * b[-1][0] + t[1, 1] * x * b[-1][1]]))
        p = [float(x[1] * y[1] / (x @ y)) for x, y in zip(f, b[::-1])]
        odds = sum(q / max(1 - q, 1e-6) for q in p if q / max(1 - q, 1e-6) >= toxicity.ODDS)
        want = 1 / (1 + np.exp(-(model.slope * np.log(odds + toxicity.ODDS) + model.intercept)))
        assert abs(r.score - want) < 1e-5 and (r.score >= 0.7) == bool(r.doc_id % 2)
    assert [rows[r.doc_id][1][s.begin : s.end] for r in got for s in r.spans] == ["vile"] * 30


def test_labellers_are_estimated_without_bounds():
    rng = np.random.default_rng(15)
    n, m = 20_000, 5
    fault = np.where(rng.random(n) < 0.25, rng.integers(0, m, n), -1)  # each bad text has one labeller's fault
    false, votes = np.array([0.004, 0.01, 0.02, 0.004, 0.03]), np.full((n, m), quality.GOOD)
    votes[rng.random((n, m)) < 0.1] = quality.ABSTAIN
    votes[(fault < 0)[:, None] & (rng.random((n, m)) < false)] = quality.BAD
    votes[np.flatnonzero(fault >= 0), fault[fault >= 0]] = quality.BAD
    votes[(fault >= 0)[:, None] & (rng.random((n, m)) < 0.15)] = quality.BAD
    patterns, back, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    post, theta = quality.em(patterns, counts.astype(float))
    assert auc((fault >= 0).astype(int), post[back.ravel()]) > 0.98
    assert np.allclose(theta.sum(axis=2), 1) and (theta[:, 0, quality.BAD] < 0.06).all() and (theta[:, 1, quality.BAD] > 0.2).all()

    # the same rounds in plain sums
    fired = [j for j in range(m) if (patterns[:, j] == quality.BAD).any()]
    table = [[list(quality.BEGIN_GOOD) for _ in range(m)]] + [[[0.0, 0.0, 1.0] if i == j else list(quality.BEGIN_OTHER) for i in range(m)] for j in fired]
    begin = [[list(x) for x in c] for c in table]
    share = [1 - quality.BEGIN_BAD] + [quality.BEGIN_BAD / len(fired)] * len(fired)
    for _ in range(30):
        weights = []
        for p, c in zip(patterns.tolist(), counts.tolist()):
            like = []
            for k, t in enumerate(table):
                x = share[k] if k == 0 or p[fired[k - 1]] == quality.BAD else 0.0
                for i in range(m):
                    x *= t[i][p[i]]
                like.append(x)
            weights.append([c * x / sum(like) for x in like])
        plain = [1 - w[0] / sum(w) for w in weights]
        share = [(sum(w[k] for w in weights) + 1) / (n + len(table)) for k in range(len(table))]
        table = [[[sum(w[k] for w, p in zip(weights, patterns.tolist()) if p[i] == v) + begin[k][i][v] for v in range(3)] for i in range(m)] for k in range(len(table))]
        table = [[[x / sum(row) for x in row] for row in c] for c in table]
    assert np.allclose(quality.em(patterns, counts.astype(float), 30)[0], plain, atol=1e-9)


def test_quality_scores_follow_from_shapes_by_plain_sums(spark):
    import pyarrow as pa

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    w, b, _, _ = quality.train(docs)
    got = {r.doc_id: r for r in quality.score(docs).collect()}
    wide, base = 2**64 - 1, 0x9E3779B97F4A7C15

    def mix(x):
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & wide
        x = (x ^ x >> 27) * 0x94D049BB133111EB & wide
        return x ^ x >> 31

    def code(word):
        return mix((sum((c + 1) * pow(base, i, 2**64) for i, c in enumerate(word)) + len(word)) & wide)

    def shape(c):
        return 65 if 65 <= c < 91 else 97 if 97 <= c < 123 or c >= 128 else 57 if 48 <= c < 58 else c

    for r in docs.limit(40).collect():
        spans = [x.encode() for x in BLANK.split(r.text) if x]
        shapes = [code([c for i, c in enumerate(map(shape, x)) if i == 0 or c != shape(x[i - 1])]) for x in spans]
        low = [lower(x.decode()) for x in spans]
        bag = shapes + [mix((q * 0xBF58476D1CE4E5B9 + p) & wide) for p, q in zip(shapes, shapes[1:])] + [mix(77) for p, q in zip(low, low[1:]) if p == q]
        total = {}
        for x in bag:
            total[x >> 52] = total.get(x >> 52, 0) + 1
        z = b + sum(w[i] * np.sqrt(c / max(1, len(spans))) for i, c in total.items())
        assert abs(got[r.doc_id].quality - 1 / (1 + np.exp(z))) < 2e-6 and got[r.doc_id].keep == (z <= 0)


def test_words_shapes_and_measures_do_not_depend_on_parts(monkeypatch):
    import pyarrow as pa

    from sieveline.llm import kernels as kn

    rng = random.Random(11)
    texts = [None, "", " \t\n", "!!", "x" * 700 + " Y" * 30] + [" ".join("".join(rng.choices("aB9!é| \n日", k=rng.randint(1, 12))) for _ in range(rng.randint(1, 90))) for _ in range(40)]
    col = pa.array(texts, pa.string())

    def everything():
        words, first = kn.word_hashes(col)
        measures, n = quality.measures(col)
        return [words, first, measures, n, kn.shingles(words, 3), *(x for pair in quality.features(col) for x in pair)]

    whole = everything()
    assert [len([w for w in BLANK.split(t or "") if w]) for t in texts] == np.diff(whole[1]).tolist()
    monkeypatch.setattr(kn, "PART", 37)
    monkeypatch.setattr(kn, "PIECE", 23)
    monkeypatch.setattr(quality, "AT_ONCE", 5)
    for x, y in zip(whole, everything(), strict=True):
        assert x.dtype == y.dtype and np.array_equal(x, y)
