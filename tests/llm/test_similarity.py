"""Jaccard join, substring dedup and fingerprints against brute force."""

import hashlib
import random

import pytest
import xxhash

from ledgerlake.llm import components, fingerprints, similarity_join, substring_dedup


def shingles(words, k):
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else ({tuple(words)} if words else set())


def brute_components(docs, words, k, percent, lower):
    fold = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t) if lower else t
    sets = [(d, shingles(words(fold(t or "")), k)) for d, t in docs]
    parent = {d: d for d, _ in sets if d is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, r in sets[:i]:
            if a is not None and b is not None and s and r and 100 * len(s & r) >= percent * len(s | r):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return sorted((d, len(s), find(d) if d is not None else None) for d, s in sets if d is not None)


def run_join(df, **how):
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in similarity_join.link(df, **how).collect() if r.doc_id is not None)


@pytest.mark.parametrize(("k", "percent", "lower"), [(3, 90, True), (5, 80, False)])
def test_join_finds_families_chains_and_copies(spark, words, monkeypatch, k, percent, lower):
    monkeypatch.setattr(similarity_join, "FREQUENT", 3)
    r = random.Random(7)
    vocabulary = [f"{c}{i}" for c in "AbcD" for i in range(400)]
    say = lambda n: [r.choice(vocabulary) for _ in range(n)]
    docs, line = [], say(12)
    base = say(90)
    for _ in range(60):  # a family of near copies, some out of reach
        t = base[:]
        for _ in range(r.randint(0, 4)):
            t[r.randrange(len(t))] = r.choice(vocabulary)
        docs.append(" ".join(t))
    chain = say(120)
    for _ in range(12):  # each near the last, the first far from the last
        chain = chain[3:] + say(3)
        docs.append(" ".join(chain))
    docs += [" ".join(line + say(r.randint(15, 60))) for _ in range(80)]  # one line in common
    docs += [docs[0]] * 5 + ["", " ", "one", "one", "One", "a b", "a b c d"]
    rows = list(enumerate(docs))
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert run_join(df, shingle=k, percent=percent, lower=lower) == brute_components(rows, words, k, percent, lower)


def test_join_awkward_rows(odd, empty, words):
    assert run_join(odd, shingle=3, percent=90, lower=True) == brute_components([(r.doc_id, r.text) for r in odd.collect()], words, 3, 90, True)
    assert [r.component_id for r in similarity_join.link(odd).where("doc_id is null").collect()] == [None]
    assert similarity_join.link(empty).count() == 0


def test_components_of_a_long_path(spark):
    ids = list(range(100, 0, -1))
    random.Random(1).shuffle(ids)
    links = spark.createDataFrame([*zip(ids, ids[1:], strict=False), (200, 201), (201, 200), (300, 300)], "a long, b long")
    got = {r.node: r.label for r in components.components(links).collect()}
    assert got == {**dict.fromkeys(range(1, 101), 1), 200: 200, 201: 200}


def brute_removed(docs, words, window):
    first = {}
    for d, t in sorted(((d, t) for d, t in docs if d is not None), key=lambda x: x[0]):
        w = words(t or "")
        for i in range(len(w) - window + 1):
            first.setdefault(tuple(w[i : i + window]), d)
    out = []
    for d, t in docs:
        w = words(t or "")
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if d is not None and first[tuple(w[i : i + window])] < d:
                gone[i : i + window] = [True] * window
        out.append((d if d is not None else -1, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return sorted(out)


def run_removal(df, words, window):
    return sorted((r.doc_id if r.doc_id is not None else -1, r.n_words, r.n_removed, " ".join(words(r.text))) for r in substring_dedup.remove_repeats(df, window=window).collect())


@pytest.mark.parametrize("window", [50, 20])
def test_repeats_match_brute_force(spark, words, window):
    r = random.Random(window)
    say = lambda n: [f"w{r.randrange(3000)}" for _ in range(n)]
    shared, loop = [say(window + r.randint(-1, 30)) for _ in range(6)], ["again", "and"] * window
    docs = []
    for i in range(70):
        t = say(r.randint(0, 80))
        for _ in range(r.randint(0, 3)):
            p = r.choice(shared)
            a = r.randrange(0, len(p))
            t = t + (p if r.random() < 0.6 else p[a:]) + say(r.randint(0, 5))
        if i % 9 == 0:
            t += loop[: r.randint(window, 2 * window)]
        docs.append((i * 3 % 71, " ".join(t).replace(" w1", "\n w1")))
    docs += [(100, docs[3][1]), (101, docs[3][1] + " more")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert run_removal(df, words, window) == brute_removed(docs, words, window)


def test_repeats_awkward_rows(odd, empty, words):
    assert run_removal(odd, words, 50) == brute_removed([(r.doc_id, r.text) for r in odd.collect()], words, 50)
    assert substring_dedup.remove_repeats(empty).count() == 0
    kept = substring_dedup.remove_repeats(odd, keep=("lang", "source")).where("doc_id = 4").first()
    assert (kept.kept.lang, kept.kept.source) == ("en", "s")


def test_text_around_what_is_cut_is_unchanged(spark, words):
    passage = " ".join(f"p{i}" for i in range(60))
    df = spark.createDataFrame([(1, passage), (2, f"before\n\n{passage}\nafter  it")], "doc_id long, text string")
    assert substring_dedup.remove_repeats(df).where("doc_id = 2").first().text == "before\n\nafter  it"


def test_fingerprints_estimate_similarity(spark, sf, words):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    docs = {r.doc_id: r.text for r in df.collect()}
    got = {r.doc_id: r for r in fingerprints.fingerprint_documents(df).collect()}
    order, errors = sorted(docs, reverse=True), []
    for i, d in enumerate(order):
        text, following = docs[d], docs[order[(i + 1) % len(order)]]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        assert got[d].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and got[d].n_chars == len(text)
        a, b, c = (shingles(words(t), 5) for t in (text, edited, following))
        errors += [got[d].near_edited - len(a & b) / len(a | b), got[d].near_next - len(a & c) / len(a | c)]
    assert max(map(abs, errors)) < 0.2 and abs(sum(errors) / len(errors)) < 0.01
    assert len({len(r.fingerprint) for r in got.values()}) == 1


def test_fingerprints_awkward_rows(spark, odd, empty):
    got = fingerprints.fingerprint_documents(odd).collect()
    assert len(got) == odd.count() and fingerprints.fingerprint_documents(empty).count() == 0
    by = {r.doc_id: r for r in got}
    assert by[5].fingerprint == by[6].fingerprint and by[2].fingerprint == by[3].fingerprint == by[1].fingerprint == ""
    alone = fingerprints.fingerprint_documents(spark.createDataFrame([(1, "a b c d")], "doc_id long, text string")).first()
    assert alone.near_next == 1.0 and 0 <= alone.near_edited <= 1


def as_signed(x):
    return x - (1 << 64) if x >> 63 else x


def chained(values, size):
    """Spark's xxhash64 of several integers of ``size`` bytes: each one's hash seeds the next."""
    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest((v % (1 << 8 * size)).to_bytes(size, "little"), seed)
    return seed


def plain_fingerprint(ws):
    """The fingerprint of a text's words, bin by bin."""
    h = [xxhash.xxh64_intdigest(w.encode(), 42) for w in ws]
    if not h:
        return ""
    bins = {}
    for x in [chained(h[i : i + 5], 8) for i in range(len(h) - 4)] if len(h) >= 5 else [chained(h, 8)]:
        bins[x >> 56] = min(x, bins.get(x >> 56, x))

    def value(b):
        if b in bins:
            return bins[b]
        walk = (as_signed(chained((b, t), 4)) % 256 for t in range(1, 9))
        return next((bins[x] for x in walk if x in bins), None) or bins[min(bins, key=lambda v: as_signed(chained((b, v, 8), 4)))]

    return "".join(f"{value(b) & 15:x}" for b in [*range(128, 256), *range(128)])


def plain_likeness(a, b):
    if not a or not b:
        return float(a == b)
    same = sum(x == y for x, y in zip(a, b, strict=True)) / 256
    return max((same - 1 / 16) / (1 - 1 / 16), 0.0)


def plain_documents(rows, words):
    """Fingerprints of (id, text) rows: descending id, then the hash of the text."""
    order = sorted(((d, t or "") for d, t in rows), key=lambda r: (-(1 << 63) if r[0] is None else r[0], as_signed(xxhash.xxh64_intdigest(r[1].encode(), 42))), reverse=True)
    known = {}
    mark = lambda t: known.setdefault(t, plain_fingerprint(words(t)))
    for i, (d, text) in enumerate(order):
        following = order[(i + 1) % len(order)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        f = [mark(t) for t in (text, edited, following)]
        yield d, len(text), hashlib.sha256(edited.encode()).hexdigest(), f[0], f[1], round(plain_likeness(f[0], f[1]), 9), round(plain_likeness(f[0], f[2]), 9)


def fingerprint_rows(df):
    got = fingerprints.fingerprint_documents(df).collect()
    return sorted(((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in got), key=str)


def test_fingerprints_match_brute_force(spark, sf, words, odd):
    for df in (spark.read.parquet(f"{sf}/documents.parquet"), odd):
        rows = [(r.doc_id, r.text) for r in df.collect()]
        assert fingerprint_rows(df) == sorted(plain_documents(rows, words), key=str)


def test_fingerprints_of_hot_ids(spark, words, monkeypatch):
    """A third of all rows without an id, a third with one id (some of them equal in all), ids beyond 2**53."""
    r = random.Random(3)
    text = lambda: " ".join(r.choice("abcdefgh") * r.randint(1, 3) for _ in range(r.randint(0, 14)))
    rows = [(None, text()) for _ in range(700)] + [(None, "all of these are the same") for _ in range(800)]
    rows += [(7, text()) for _ in range(500)] + [(7, None) for _ in range(900)] + [((1 << 60) + i // 3, text()) for i in range(600)]
    rows += [((1 << 60) + 5, text()) for _ in range(500)] + [((1 << 60) + 9, text()) for _ in range(500)] + [(i, text()) for i in range(-100, 500)]
    monkeypatch.setattr(fingerprints._copies, "__defaults__", (100,))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    tasks = []
    plain = fingerprints.materialize
    monkeypatch.setattr(fingerprints, "materialize", lambda df, name: tasks.append(name) or plain(df, name))
    assert fingerprint_rows(df) == sorted(plain_documents(rows, words), key=str)
    assert tasks == ["repeated"]


def test_texts_without_repeats_are_kept_from_the_shuffle(spark):
    rng = random.Random(5)
    text = lambda: " ".join(str(rng.randrange(10**9)) for _ in range(60))
    shared = text()
    docs = [(1, shared), (2, f"{text()} {shared}"), *((i, text()) for i in range(3, 200)), (None, shared)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    maybe, others = substring_dedup._split(d.where("doc_id is not null"), spark.createDataFrame([(2,)], "doc_id long"))
    assert 2 in {r.doc_id for r in maybe.collect()} and maybe.count() < 10 and maybe.count() + others.count() == 199
    got = {r.doc_id: (r.n_removed, r.text) for r in substring_dedup.remove_repeats(d).collect()}
    assert len(got) == 200 and got[2][0] == 60 and not any(n for i, (n, _) in got.items() if i != 2) and all(got[i][1] == t for i, t in docs if i != 2)
