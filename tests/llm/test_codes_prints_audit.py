"""Vector codes, fingerprints and the filter audit against brute force, with nulls, ties, repeats, empty tables and extra columns."""

import hashlib
import itertools
import random

import numpy as np
import pytest

from permuta.llm import filteraudit, fingerprints, veccodes
from permuta.llm.shared import LOWER_TABLE

from .test_operators import WORD, corpus, docs, empty

# 11


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, ints string, near int, code string, n int")


def coded(rows, parts=4, entries=8, rounds=4):
    """Brute force over (vec_id, vector, label) without bad ones: rows' code and error, and the codebooks."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, np.floor(1024 * np.float32(r[1]).astype(float)).astype("<i4").tobytes()))
    x = np.floor(1024 * np.stack([np.float32(r[1]) for r in rows]).astype(float)).astype(int).reshape(len(rows), parts, -1)
    books = [x[:entries, p].copy() for p in range(parts)]
    for r in range(rounds + 1):
        far = [((x[:, p][:, None] - books[p][None]) ** 2).sum(axis=2) for p in range(parts)]
        at = [f.argmin(axis=1) for f in far]
        for p in range(parts if r < rounds else 0):
            for k in set(at[p]):
                books[p][k] = x[at[p] == k, p].sum(axis=0) // (at[p] == k).sum()
    codes = ["".join(f"{at[p][i]:02x}" for p in range(parts)) for i in range(len(rows))]
    errors = [sum(int(far[p][i].min()) for p in range(parts)) for i in range(len(rows))]
    return rows, codes, errors, np.stack(books)


def vector_corpus(n=300, width=16, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, width)) / 4
    found = [(i, (centres[i % 12] + rng.normal(size=width) / 20).tolist(), [None, 1, 2, 3, 3, 3][i % 6]) for i in range(n)]
    found += [(7, found[9][1], 1), (7, found[9][1], 1), (None, found[3][1], None), (n + 1, [0.0] * width, 1), (n + 2, found[0][1], 2)]
    return found


@pytest.mark.parametrize("entries", [1, 8, 64, 400])
def test_vector_codes_equal_comparing_with_all_entries(spark, entries):
    good = vector_corpus()
    bad = [(900, None, 1), (901, [None] + [0.5] * 15, 1), (902, [float("nan")] * 16, None), (903, [float("inf")] + [0.0] * 15, 2), (904, [], 1)]
    found = veccodes.fit_codes(vectors(spark, [(*r, "x", 1, "y", 2) for r in good + bad]), entries=entries)
    rows, codes, errors, books = coded(good, entries=entries)
    assert np.array_equal(found.codebooks, books)
    digits = 2 if entries <= 256 else 8
    if digits == 2:
        assert sorted((repr(r["vec_id"]), r["code"], r["error"]) for r in found.rows.collect()) == sorted((repr(r[0]), c, e) for r, c, e in zip(rows, codes, errors))
    assert all(t["settled"] + t["compared"] + t["searched"] == 4 * len(rows) for t in found.rounds)
    if entries == 64:
        assert found.rounds[-1]["settled"] > 0 and len({t["b"] for t in found.rounds}) > 1


def test_vector_codes_query_columns(spark):
    good = vector_corpus()
    found = {(r["vec_id"], r["code"]): r for r in veccodes.vector_codes(vectors(spark, [(*r, "x", 1, "y", 2) for r in good]), entries=16).collect()}
    rows, codes, errors, books = coded(good, entries=16)
    by_label = {}
    for r, e in zip(rows, errors):
        by_label[r[2]] = by_label.get(r[2], 0) + e
    digest = hashlib.sha256(",".join(str(int(v)) for v in books.ravel()).encode()).hexdigest()
    for r, c, e in zip(rows, codes, errors):
        got = found[r[0], c]
        assert (got["error"], got["label_error"] in by_label.values(), got["codebooks_sha256"]) == (e, True, digest)
    assert {r["label_error"] for r in found.values() if r["vec_id"] in (0, 6)} == {by_label[None]}


def test_vector_codes_bounds_never_miss_a_nearer_entry():
    rng = np.random.default_rng(3)
    x, entries = rng.integers(-300, 300, (400, 4)), rng.integers(-300, 300, (40, 4))
    part = veccodes.Bounds(x, np.zeros((400, 6), np.int64), np.zeros((400, 6), np.float32))
    part.search_all(entries, np.arange(400), 6)
    for b, step in ((6, 1), (3, 5), (9, 2), (9, 40), (2, 0), (5, 3), (5, 300)):
        new = entries + rng.integers(-step, step + 1, entries.shape)
        own = part.assign(new, np.sqrt(((new - entries) ** 2).sum(axis=1)), b)
        entries = new
        far = ((x[:, None] - entries[None]) ** 2).sum(axis=2)
        assert np.array_equal(part.near[:, 0], far.argmin(axis=1)) and np.array_equal(own, far.min(axis=1))


def test_vector_codes_squares_stay_exact_beyond_floating_point():
    x = np.array([[veccodes.LARGEST, -veccodes.LARGEST, 1, 0]])
    entries = np.array([[-veccodes.LARGEST, veccodes.LARGEST, 0, 3]])
    assert veccodes.squares(x, entries)[0, 0] == 2 * (2 * veccodes.LARGEST) ** 2 + 1 + 9


def test_vector_codes_edges(spark):
    assert veccodes.vector_codes(vectors(spark, [])).collect() == []
    assert veccodes.vector_codes(vectors(spark, [(1, None, 1, "x", 1, "y", 2)])).collect() == []
    one = veccodes.vector_codes(vectors(spark, [(None, [1.0, 2.0, 3.0, 4.0], None, "x", 1, "y", 2)])).collect()
    assert [(r["vec_id"], r["code"], r["error"], r["label_error"]) for r in one] == [(None, "00000000", 0, 0)]
    with pytest.raises(Exception, match="multiple of 4"):
        veccodes.vector_codes(vectors(spark, [(1, [1.0] * 8, 1, "x", 1, "y", 2), (2, [1.0] * 9, 1, "x", 1, "y", 2)])).collect()
    with pytest.raises(Exception, match="64 bits"):
        veccodes.vector_codes(vectors(spark, [(1, [1e30] * 8, 1, "x", 1, "y", 2)])).collect()


def test_vector_codes_decode_near_their_vectors(spark):
    good = vector_corpus()
    found = veccodes.fit_codes(vectors(spark, [(*r, "x", 1, "y", 2) for r in good]), entries=64)
    near = {r["vec_id"]: r["vector"] for r in veccodes.decode(found.rows, found.codebooks).collect()}
    gap = np.mean([np.abs(np.array(near[r[0]]) - r[1]).mean() for r in good if r[0] not in (None, 7)])
    assert gap < 0.06


# 12


def shingles(text):
    w = text.encode().translate(LOWER_TABLE).split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def share(a, b):
    return len(a & b) / max(1, len(a | b))


def test_fingerprints_against_brute_force(spark):
    rows = [r for r in corpus(3) if r[0] is not None]
    rows = list({r[0]: r for r in rows}.values()) + [(500, "naïve café \U0001f600 " * 40), (501, "\U0001f600é"), (None, "of no one " * 9)]
    found = {r["doc_id"]: r for r in fingerprints.fingerprints(docs(spark, rows).repartition(7)).collect()}
    assert len(found) == len(rows)
    ordered = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    gaps, by_text = [], {}
    for (i, t), (_, following) in zip(ordered, ordered[1:] + ordered[:1]):
        t, following, got = t or "", following or "", found[i]
        half = len(t) // 2
        changed = t[: len(t) - half] + following[:half]
        assert (got["n_chars"], got["edited_sha256"]) == (len(t), hashlib.sha256(changed.encode()).hexdigest())
        true = share(shingles(t), shingles(changed)), share(shingles(t), shingles(following))
        gaps += [got["near_edited"] - true[0], got["near_next"] - true[1]] if shingles(t) else []
        for exact, wanted in zip((got["jaccard_edited"], got["jaccard_next"]), true):
            assert (exact is None and wanted < 0.8) or exact == pytest.approx(wanted) or not shingles(t)
        assert by_text.setdefault(t, got["fingerprint"]) == got["fingerprint"]
        if t == changed:
            assert got["fingerprint"] == got["edited_fingerprint"] and got["near_edited"] == 1
    assert abs(np.mean(gaps)) < 0.02 and np.abs(gaps).max() < 0.2


@pytest.mark.parametrize("rows", [[(1, "only one text of some words")], [(2, None), (2, ""), (1, None)], [(3, "a b c d e f")] * 40 + [(3, "z"), (2, "x y")], [(None, "p q r"), (None, "s t u")]])
def test_fingerprints_repeats_ties_and_lone_rows(spark, rows):
    found = fingerprints.fingerprints(docs(spark, rows).repartition(5)).collect()
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    assert sorted(map(repr, ((r["doc_id"], r["n_chars"]) for r in found))) == sorted(map(repr, ((i, len(t or "")) for i, t in rows)))
    assert fingerprints.fingerprints(empty(spark)).collect() == []
    if len(rows) == 1:
        assert found[0]["near_next"] == 1 and found[0]["edited_sha256"] == hashlib.sha256(fingerprints.edited(rows[0][1], rows[0][1]).encode()).hexdigest()
    if len(rows) == 42:  # each of the equal rows but one is followed by its like
        same = fingerprints.edited("a b c d e f", "a b c d e f")
        assert sum(r["edited_sha256"] == hashlib.sha256(same.encode()).hexdigest() for r in found if r["doc_id"] == 3) >= 38
    assert order


def test_fingerprint_functions_are_minima_and_parts_of_long_texts_agree(monkeypatch):
    rng = random.Random(5)
    texts = [" ".join(rng.choice("abcdefghij") * rng.randrange(1, 9) for _ in range(n)).encode() for n in (0, 1, 4, 5, 6, 40, 900)]
    whole = fingerprints.signatures(texts)
    monkeypatch.setattr(fingerprints, "CHUNK", 7)
    assert np.array_equal(fingerprints.signatures(texts), whole)
    monkeypatch.setattr(fingerprints, "MIX_BYTES", 100)
    monkeypatch.setattr("permuta.llm.shared.binary_parts.__defaults__", (100,))
    monkeypatch.setattr("permuta.llm.shared.segments.__defaults__", (100,))
    assert np.array_equal(fingerprints.signatures(texts), whole)
    a, b = fingerprints.hash_functions(4)
    x = np.array([5 << 33, 9 << 33, 77 << 33], np.uint64)
    least = fingerprints.smallest(x, np.array([0, 3]), (a, b))[0]
    assert least.tolist() == [min((int(p) * v + int(q)) % (2**31 - 1) for v in (5, 9, 77)) for p, q in zip(a, b)]


def test_near_documents_equal_all_pairs(spark):
    rows = corpus(9)
    sets = [(i, shingles(t or "")) for i, t in rows if i is not None]
    group = {i: i for i, _ in sets}

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    texts = {}
    for i, t in ((i, t) for i, t in rows if i is not None):
        texts.setdefault((t or "").encode().translate(LOWER_TABLE), []).append(i)
    pairs = [(i, j) for (i, a), (j, b) in itertools.combinations(sets, 2) if a and 5 * len(a & b) >= 4 * len(a | b)] + [(ids[0], j) for ids in texts.values() for j in ids]
    for i, j in pairs:
        a, b = sorted((root(i), root(j)))
        group[b] = a
    found = fingerprints.near_documents(docs(spark, rows)).collect()
    assert len(found) == len(rows)
    assert {(r["doc_id"], r["near_id"]) for r in found if r["doc_id"] is not None} == {(i, root(i)) for i in group}
    assert [r["near_id"] for r in found if r["doc_id"] is None] == [None]
    assert fingerprints.near_documents(empty(spark)).collect() == []


# 13


def audited(rows, labels):
    """Brute force: apply every order's filters to the documents one after the other."""
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)

    def failing(i, t):
        t = t or ""
        w = WORD.findall(t)
        checks = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t), "D": any(c in "#$%&*|" for c in t), "E": i is not None and first[t] < i}
        return {k for k, v in checks.items() if v}

    out = {}
    for part in {p or "" for _, _, p in rows}:
        own = [(i, failing(i, t)) for i, t, p in rows if (p or "") == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone, stay = [x for x in left if f in x[1]], [x for x in left if f not in x[1]]
                lab = lambda k: sum(max((r[k] or 0 for r in labels if r[0] == i and i is not None), default=0) == 1 for i, _ in gone)  # noqa: B023, E731
                shapley[f] += len(gone)
                out[part, "".join(order), step] = [len(stay), len(gone), sum(f in x[1] for x in own) - len(gone), sum(x[1] == {f} for x in own), lab(1), lab(2), f]
                left = stay
        for (p, order, step), v in out.items():
            if p == part:
                v[6] = shapley[order[step - 1]]
    return out


def test_filter_audit_against_every_order(spark):
    rng = random.Random(2)
    words = [f"w{k}" for k in range(400)]
    rows = []
    for i in range(120):
        t = " ".join(rng.choice(words[: rng.choice([30, 400])]) for _ in range(rng.choice([20, 99, 100, 101, 150])))
        t = t.upper() if rng.random() < 0.3 else t
        rows.append((i, t + rng.choice(["", "", " #", "|"]), rng.choice(["en", "de", None, ""])))
    rows += [(200 + k, rows[k][1], rng.choice(["en", "fr", None])) for k in range(0, 60, 2)]
    rows += [(300, None, "en"), (301, "", None), (None, rows[3][1], "de"), (None, None, None), rows[5], (5, "another text", "en")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 300, 2)] + [(2, 1, 1), (None, 1, 1), (999, 1, 1)]
    table = spark.createDataFrame([(i, t, p, 1, "x", True, 5) for i, t, p in rows], "doc_id long, text string, lang string, mask int, part string, good boolean, docs int").repartition(5)
    found = filteraudit.audit(table, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    got = {(r["part"], r["filter_order"], r["step"]): [r[n] for n in names] for r in found}
    assert len(got) == len(found) == 600 * 4
    assert got == audited(rows, labels)


def test_filter_audit_walk_and_edges(spark):
    rng = np.random.default_rng(1)
    masks, counts = np.arange(16), rng.integers(0, 9, (16, 2))
    states = filteraudit.gray_walk(masks, counts, 4)
    assert all(np.array_equal(states[s], counts[(masks & s) == 0].sum(axis=0)) for s in range(16))
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filteraudit.audit(empty(spark), none).collect() == []
    two = {"A": filteraudit.few_words, "D": filteraudit.odd_signs}
    rows = filteraudit.audit(docs(spark, [(1, "a #"), (2, "a #"), (3, None)]), none, filters=two, copies=None).collect()
    assert {(r["filter_order"], r["step"], r["removed"], r["kept"]) for r in rows} == {("AD", 1, 3, 0), ("AD", 2, 0, 0), ("DA", 1, 2, 1), ("DA", 2, 1, 0)}
    with pytest.raises(ValueError):
        filteraudit.audit(empty(spark), none, filters={}, copies=None)
    with pytest.raises(ValueError):
        filteraudit.audit(empty(spark), none, filters=two, copies="A")


# the sample of 5 and 10


def test_labelled_sample_is_bounded_in_rows_and_bytes(spark):
    from pyspark.sql import functions as F

    from permuta.llm.sampling import labelled_sample

    rows = [(i, "x" * (i % 40 + 1)) for i in range(200)] + [(7, "a second text of seven, and longer"), (None, "no id"), (300, "y" * 5000), (301, None)]
    labels = spark.createDataFrame([(i, i % 4 == 0 and 1 or 0) for i in range(200)] + [(7, 1), (None, 1), (300, 1), (301, 0), (999, 1)], "doc_id long, toxic int")
    sample = lambda most, **more: labelled_sample(docs(spark, rows), labels, "toxic", F.col("doc_id") != 8, most, **more)
    whole = sample(1000, text_bytes=100)
    assert len(whole) == 200 and 8 not in set(whole["doc_id"]) and 300 not in set(whole["doc_id"]) and whole["doc_id"].is_unique
    by_id = whole.set_index("doc_id")
    assert by_id.loc[7, "label"] == 1 and by_id.loc[7, "text"] == "x" * 8 and by_id.loc[301, "text"] == ""
    assert sample(50)["doc_id"].isin(sample(100)["doc_id"]).all() and len(sample(50)) == 50
    less = sample(1000, text_bytes=100, total_bytes=500)
    assert 400 < sum(map(len, less["text"])) <= 500 and set(less["doc_id"]) <= set(whole["doc_id"])
    halves = sample(60, by_class=True, text_bytes=100)
    assert (halves["label"] > 0).sum() in (28, 29, 30), "300's text is too long and 999 has none"
    assert dict(zip(halves["label"], halves["weight"])) == {1: 52 / 30, 0: 150 / 30}
    assert len(sample(10, text_bytes=0)) <= 1 and list(labelled_sample(docs(spark, []), labels, "toxic", F.lit(True), 5).columns) == ["doc_id", "text", "label"]
