"""Every operator against a brute-force version, with nulls, ties, repeats, empty tables and extra columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from permuta.llm import annlinks, bpe, exact, graph, jaccard, mixing, quality, substring, token_counts, toxicity, urlrank
from permuta.llm.queries import held_out, tokenizer_file

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, th long, packed string, n int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs(spark, rows):
    """rows: (doc_id, text) or (doc_id, text, source); the last columns have names that operators use inside."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or ""), 7, "x", 3) for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def empty(spark):
    return docs(spark, [])


def corpus(seed=0, n=60):
    """Texts with exact copies, near copies, shared passages, nulls and very short ones."""
    rng = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in "bcdfghklmnpr" for b in ("a", "e", "on", "ing", "est")]
    text = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    passage = text(70)
    out = [(i, text(rng.choice([3, 5, 8, 30, 120, 300]))) for i in range(n)]
    for i in range(n, n + 25):
        words = rng.choice(out)[1].split()
        for _ in range(rng.choice([0, 1, 1, 2, 6])):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        out.append((i, " ".join(words)))
    out += [(n + 25 + i, f"{text(20)} {passage} {text(rng.choice([0, 10, 60]))}") for i in range(8)]
    out += [(n + 40, None), (n + 41, ""), (n + 42, " \n "), (n + 43, out[0][1].upper()), (None, out[1][1]), (n + 44, "one"), (n + 45, "ONE"), (n + 46, "a " * 400)]
    out.append(out[5])
    return out


# 1


def removed(rows, window=50):
    """Brute force: for every (id, text) the words that stay."""
    words = [WORD.findall(t or "") for _, t in rows]
    first = {}
    for (i, _), w in zip(rows, words):
        for p in range(len(w) - window + 1):
            key = tuple(w[p : p + window])
            if i is not None:
                first[key] = min(first.get(key, i), i)
    out = []
    for (i, _), w in zip(rows, words):
        gone = set()
        for p in range(len(w) - window + 1):
            if i is not None and first[tuple(w[p : p + window])] < i:
                gone.update(range(p, p + window))
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("window", [50, 8])
def test_substring_dedup(spark, window):
    rows = corpus(1)
    got = substring.remove_repeats(docs(spark, rows), window)
    assert sorted(map(tuple, got.collect()), key=repr) == removed(rows, window)


def test_substring_dedup_repeated_words_and_empty(spark):
    rows = [(1, "w " * 130), (2, "w " * 90), (3, "x " + "w " * 60 + "y"), (2, "other text")]
    assert sorted(map(tuple, substring.remove_repeats(docs(spark, rows)).collect()), key=repr) == removed(rows)
    assert substring.remove_repeats(empty(spark)).count() == 0


# 2


def mixed(rows, weights=(5, 2, 1), most=3):
    """Targets by repeated resharing."""
    size = {}
    for _, text, source in rows:
        size[source] = size.get(source, 0) + len(WORD.findall(text or ""))
    order = sorted(size, key=lambda s: (s is None, s))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, capped = sum(size.values()), {}
    while True:
        open_ = [s for s in order if s not in capped]
        left, w = total - sum(capped.values()), sum(weight[s] for s in open_)
        target = {s: left * weight[s] / w for s in open_}
        over = [s for s in open_ if target[s] > most * size[s]]
        if not over:
            return size, capped | target
        capped |= {s: most * size[s] for s in over}


def test_mixing_sources(spark):
    rng = random.Random(4)
    rows = [(i, "w " * rng.choice([0, 1, 5, 40]), rng.choice(["a", "b", "b", "b", "c", None, "Z"])) for i in range(200)] + [(500, None, "a"), (None, "x y", "b"), (7, "w w", "b")]
    size, target = mixed(rows)
    sized = docs(spark, rows).select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    for parts in (1, 5):
        got = mixing.mix_sources(sized.repartition(parts)).collect()
        assert len(got) == len(rows)
        for s in size:
            mine = [r for r in got if r["source"] == s]
            assert all(r["source_size"] == size[s] and abs(r["target"] - target[s]) < 1e-6 for r in mine)
            assert sum(r["taken"] for r in mine) == int(target[s] + 1e-9)
        assert all(0 <= r["taken"] <= 3 * r["size"] for r in got)
        same = sorted((repr(r["doc_id"]), r["size"], r["taken"]) for r in got)
        if parts == 1:
            once = same
        assert same == once
    assert mixing.mix_sources(sized.limit(0)).count() == 0


def test_mixed_documents_hold_what_is_taken(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(f"w{i}_{k}" for k in range(rng.choice([1, 5, 40]))), rng.choice(["a", "b", "b", "c"])) for i in range(80)]
    frame = docs(spark, rows).withColumn("size", F.lit(1)).withColumn("taken", F.lit("x"))
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix_sources(frame.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))).collect()}
    held = {}
    for r in mixing.mixed_documents(frame).collect():
        held[r["doc_id"]] = held.get(r["doc_id"], 0) + len(r["text"].split())
        assert dict(rows_text(rows))[r["doc_id"]].startswith(r["text"])
    assert held == {k: v for k, v in taken.items() if v}
    assert mixing.mixed_documents(empty(spark)).columns == docs(spark, []).columns


def rows_text(rows):
    return [(r[0], r[1]) for r in rows]


# 3


def test_url_rules_and_links(spark):
    page = lambda i, url, html="": (i, url, html)
    link = lambda h: f'<a href="https://{h}/x">'
    rows = [
        page(1, "https://EXAMPLE.org/es/1"), page(2, "https://www.example.org/en/19?q=/es/"), page(3, "http://a.org"), page(4, "http://a.org/"),
        page(5, "https://x.com/fr/"), page(6, "https://x.com/de/1", link("bad.net")), page(7, None), page(8, "no scheme"), page(9, "https://good.net/a", None),
        page(10, "https://x.com/other", link("good.net")), page(11, "https://spam.net/", link("y.com") * 3), page(12, "https://y.com/de/2"), page(13, "https://y.com/z"), page(13, "https://y.com/z"), page(14, "https://notexample.org/es/#a"),
        page(15, "https://e.net/a://b.org/c"),
    ]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: tuple(r)[1:] for r in urlrank.filter_urls(frame).collect()}
    assert got[1] == ("example.org", "/es/1", "example.org/es/", "block")
    assert got[2] == ("www.example.org", "/en/19", "example.org/en/1", "block")
    assert got[3] == ("a.org", "", None, "allow") and got[4][2:] == ("org/", "allow")
    assert got[5][2:] == ("com/fr/", "allow") and got[6][2:] == ("com/de/", "block")
    assert got[7] == ("", "", None, "allow") and got[8][:2] == ("", "")
    assert got[11][2:] == (None, "block"), "it links to a blocked host"
    assert got[13][2:] == (None, "block") and got[9][2:] == (None, "allow")
    assert got[14][2] == "org/" and got[15][:2] == ("e.net", "/a://b.org/c")
    assert urlrank.filter_urls(frame).count() == len(rows) and urlrank.filter_urls(frame.limit(0)).count() == 0


def test_propagation_is_personalised_pagerank(spark):
    rng = np.random.default_rng(2)
    edges = sorted({(f"h{a}", f"h{b}") for a, b in rng.integers(0, 8, (20, 2)) if a != b})
    frame = spark.createDataFrame([(a, b, int(k)) for (a, b), k in zip(edges, rng.integers(1, 4, len(edges)))], "src string, dst string, n long")
    seeds = spark.createDataFrame([("h0", 2, 0), ("h3", 1, 1), ("h5", 0, 3)], "host string, trusted long, blocked long")
    weights = {(r["src"], r["dst"]): r["n"] for r in frame.collect()}
    for kind, start, turn in (("trust", {"h0": 2, "h3": 1}, False), ("distrust", {"h3": 1, "h5": 3}, True)):
        w = {((b, a) if turn else (a, b)): n for (a, b), n in weights.items()}
        rank = dict(start)
        for _ in range(urlrank.ITERATIONS):
            new = {h: 0.15 * s for h, s in start.items()}
            for (a, b), n in w.items():
                if a in rank:
                    new[b] = new.get(b, 0) + 0.85 * rank[a] * n / sum(m for (c, _), m in w.items() if c == a)
            rank = new
        got = {r["host"]: r[kind] for r in urlrank.propagate(frame, seeds).collect()}
        assert all(abs(got.get(h, 0) - v) < 1e-9 for h, v in rank.items())


# 4


def test_near_duplicate_vectors(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(150, 16))
    rows = [list(map(float, v)) for v in base] + [list(map(float, base[i % 20] + rng.normal(scale=0.08, size=16))) for i in range(120)] + [list(map(float, base[3] * 2)), list(map(float, base[3]))]
    rows += [None, [0.0] * 16, [float("nan")] + [1.0] * 15, [None] + [1.0] * 15, [float("inf")] + [1.0] * 15, [1.0] * 3, []]
    data = [(i, v, 0) for i, v in enumerate(rows)] + [(None, rows[0], 1)]
    frame = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int")
    x = np.array([v for v in rows[:272]])
    cos = (x @ x.T) / np.sqrt((x * x).sum(1))[:, None] / np.sqrt((x * x).sum(1))[None, :]
    link = cos >= annlinks.COSINE
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in annlinks.near_duplicates(frame, shards=3).collect()}
    assert len(got) == len(data) and got[None] == (0, None, False)
    part = list(range(272))
    for i in range(272):
        for j in np.flatnonzero(link[i]):
            a, b = part[i], part[j]
            part = [min(a, b) if p in (a, b) else p for p in part]
    assert sum(got[i][0] for i in range(272)) >= 0.99 * (link.sum() - 272)
    assert all(got[i] == (0, i, True) for i in range(272, len(rows)))
    assert sum(got[i][1] == part[i] for i in range(272)) >= 270
    assert annlinks.near_duplicates(frame.limit(0)).count() == 0


def block(x, least=annlinks.COSINE, degree=annlinks.DEGREE):
    """All of x as a shard and as the queries on it."""
    x = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    ids = np.arange(len(x))
    world = annlinks.SmallWorld.build(x.astype(np.float32), ids, degree)
    groups = ids.copy()
    at, root = graph.roots(*world.ties(x, least))
    groups[at] = root
    return annlinks.Shard(world, ids, x, groups, ids, groups, x, least)


def test_audit_notices_missed_links():
    """Narrow beams in a sparse graph miss links; the audit says so, and doesn't count a point's match with itself."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(2400, 32))
    x[:800] = x[0] + rng.normal(scale=0.05, size=(800, 32))
    x[1600:] = x[800:1600] + rng.normal(scale=0.1, size=(800, 32))
    shares = []
    for degree, beam in ((2, 2), (annlinks.DEGREE, 48)):
        shard = block(x, degree=degree)
        exact = shard.exact @ shard.exact.T >= annlinks.COSINE
        np.fill_diagonal(exact, False)
        told = shard.audit(beam)
        links = told[told["level"] == 0].set_index("id")
        assert links["true"].to_dict() == {i: int(n) for i, n in enumerate(exact.sum(axis=1)) if n}
        sparse = links[links.index >= 800]
        shares.append(sparse["found"].sum() / sparse["true"].sum())
        nearest = told[told["level"] == annlinks.STEPS]
        assert (nearest["true"] <= annlinks.NEAREST).all() and (nearest["found"] <= nearest["true"]).all()
    assert shares[0] < 0.97 and shares[1] > 0.99


def test_recall_rests_on_links_or_says_on_what(spark):
    frame = lambda rows: spark.createDataFrame(rows, "id long, level long, true long, found long")
    many = frame([(i, 0, 2, 1 + i % 2) for i in range(100)])
    assert annlinks.recall(many, 0.95) == {"least": 0.95, "links": 200, "recall": 0.75, "passed": False}
    few = frame([(1, 0, 1, 1)] + [(i, 1, 1, 1) for i in range(50)] + [(i, 2, 3, 3) for i in range(50)])
    told = annlinks.recall(few, 0.95)
    assert told["links"] == 150 and abs(told["least"] - 0.85) < 1e-9 and told["passed"]
    missed = frame([(1, 0, 1, 0)] + [(i, 2, 3, 3) for i in range(50)])
    assert not annlinks.recall(missed, 0.95)["passed"], "few links, but one was missed"
    assert annlinks.recall(frame([]), 0.95) == {"least": 0.95, "links": 0, "recall": 1.0, "passed": True}


def test_twenty_thousand_vectors_are_linked_by_their_graphs(spark, monkeypatch):
    """Planted pairs and groups in loose clusters, with no way to compare a query with a shard but the audit's."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(40, 48))[rng.integers(0, 40, 20_000)] + rng.normal(scale=1.0, size=(20_000, 48))
    x[1000:1300] = x[:300] + rng.normal(scale=0.1, size=(300, 48))
    x[2000:2400] = x[500] + rng.normal(scale=0.12, size=(400, 48))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(8)
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    true = np.concatenate([(x[i : i + 2000] @ x.T >= annlinks.COSINE).sum(axis=1) - 1 for i in range(0, 20_000, 2000)])
    audits = []
    got = {r["vec_id"]: r["n_links"] for r in annlinks.near_duplicates(frame, audits=audits).collect()}
    found = np.array([got[i] for i in range(20_000)])
    assert (found <= true).all() and found.sum() >= 0.99 * true.sum() and true.sum() > 100_000
    assert ((found > 0) == (true > 0)).mean() > 0.999
    assert audits[-1]["passed"] and audits[-1]["links"] >= annlinks.AUDIT_LINKS


def test_no_row_grows_with_a_shard(spark, monkeypatch):
    """A shard's graph in one value was 2.7 MB for these 3,000 points; where a shard held 88,000, executors ran out of memory."""
    written = []
    write = annlinks.materialize
    monkeypatch.setattr(annlinks, "materialize", lambda df, tag: written.append((tag, write(df, tag))) or written[-1][1])
    rng = np.random.default_rng(9)
    x = rng.normal(size=(3000, 64))
    x[1500:] = x[:1500] + rng.normal(scale=0.1, size=(1500, 64))
    x[::2] = x[::2].astype(np.float32)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r["n_links"] for r in annlinks.near_duplicates(frame, shards=1).collect()}
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    true = (x @ x.T >= annlinks.COSINE).sum(axis=1) - 1
    assert all(got[i] <= true[i] for i in got) and sum(got.values()) >= 0.99 * true.sum() > 2900
    longest = {tag: max([0, *(df.agg(F.max(F.length(c))).first()[0] or 0 for c, kind in df.dtypes if kind == "binary")]) for tag, df in written}
    assert "vector-graphs" in longest and max(longest.values()) <= annlinks.CELL * 64 * 8


def test_a_graph_is_the_same_after_its_rows():
    x = np.random.default_rng(2).normal(size=(900, 24)).astype(np.float32)
    for n in (1, 900):
        made = annlinks.SmallWorld.build(x[:n], np.arange(n))
        again = annlinks.SmallWorld.of(x[:n], made.edges())
        assert len(made.members) == len(again.members) > (n > 1)
        assert all((a == b).all() for a, b in zip([*made.members, *made.links], [*again.members, *again.links], strict=True))


def test_recall_of_sparse_links_beside_a_dense_group(spark, monkeypatch):
    """A third of the vectors in one group must not hide that the others' links are missed by narrow beams."""
    monkeypatch.setattr(annlinks, "BEAM", 2)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(2400, 32))
    x[:800] = x[0] + rng.normal(scale=0.05, size=(800, 32))
    x[1600:] = x[800:1600] + rng.normal(scale=0.1, size=(800, 32))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    true = (x @ x.T >= annlinks.COSINE).sum(axis=1) - 1
    got = {r["vec_id"]: r["n_links"] for r in annlinks.near_duplicates(frame, shards=2).collect()}
    assert true[800:].sum() > 1000 and all(got[i] == true[i] for i in range(800))
    assert sum(got[i] for i in range(800, 2400)) >= 0.98 * true[800:].sum()


def test_cells_of_a_tight_group_are_counted_without_comparing(spark, monkeypatch):
    """1,500 near copies have over two million links, and no two cells of theirs are compared; a looser group's are."""
    rng = np.random.default_rng(5)
    rows = [("tight", 0.01, False), ("loose", 0.2, True)]
    for _, scale, compares in rows:
        x = rng.normal(size=(1, 64)) + rng.normal(scale=scale, size=(1500, 64))
        x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
        n = rng.integers(1, 4, 1500)
        made = list(annlinks.cells_of(np.arange(1500), n, x, np.zeros(1500, np.int64)))
        assert len(made) == 3 and all(len(c["ids"]) <= 8 * annlinks.CELL for c in made)
        cells = spark.createDataFrame([(k, 0, 1500, c["total"], c["centre"], c["angle"], c["ids"], c["ns"], c["vecs"]) for k, c in enumerate(made)], "cell long, gid long, members long, total long, centre binary, angle double, ids binary, ns binary, vecs binary")
        ties = spark.createDataFrame([], "a long, b long")
        seen = []
        compared = annlinks.compared_cells
        monkeypatch.setattr(annlinks, "compared_cells", lambda pairs, least: seen.append(pairs.count()) or compared(pairs, least))  # noqa: B023
        got = {r["id"]: r["n"] for r in annlinks.link_counts(cells, ties, annlinks.COSINE).collect()}
        monkeypatch.setattr(annlinks, "compared_cells", compared)
        wanted = (x @ x.T >= annlinks.COSINE) @ n
        assert got == {i: int(v) for i, v in enumerate(wanted)} and (seen[0] > 0) == compares


def test_groups_around_the_dense_limit_count_all_links(spark):
    """Groups of 9 to 40 over 4 shards: some members are scanned in a shard, others aren't."""
    rng = np.random.default_rng(11)
    parts = [rng.normal(size=(1, 32)) + rng.normal(scale=0.15, size=(k, 32)) for k in range(9, 41, 3)]
    x = np.concatenate([*parts, rng.normal(size=(100, 32))])
    frame = spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    n = (x @ x.T >= annlinks.COSINE).sum(axis=1) - 1
    got = {r["vec_id"]: r["n_links"] for r in annlinks.near_duplicates(frame, shards=4).collect()}
    assert n.max() > 30 and got == dict(enumerate(n.tolist()))


# 5 and 10


def labelled(spark, n=300, bad="lumpox"):
    rng = random.Random(6)
    vocabulary = [f"{a}{b}" for a in ("ba", "te", "mi", "so") for b in ("ra", "len", "tu", "ko")]
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([10, 60]))]
        toxic, low = i % 4 == 0, i % 5 == 0
        if toxic:
            words[rng.randrange(len(words))] = bad
        if low:
            words = [f"{w.upper()}!!" if w != bad else w for w in words]
        rows.append((i, " ".join(words) + "."))
        labels.append((i, int(not low), int(toxic)))
    return docs(spark, rows), spark.createDataFrame(labels + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")


def test_kernel_is_the_subsequence_kernel():
    def slow(s, t, k, d):
        from itertools import combinations

        total = 0.0
        for a in combinations(range(len(s)), k):
            for b in combinations(range(len(t)), k):
                if all(s[i] == t[j] for i, j in zip(a, b)):
                    total += d ** (a[-1] - a[0] + 1 - k + b[-1] - b[0] + 1 - k)
        return total

    for s, t in (("abcab", "acb"), ("idiot", "i.diot"), ("aaaa", "aaa"), ("xyz", "abc")):
        for k in (2, 3):
            got = toxicity.kernel(toxicity.codes([s]), toxicity.codes([t]), k, 0.5)[0]
            assert abs(got - slow(s, t, k, 0.5)) < 1e-4


def test_toxicity(spark):
    frame, labels = labelled(spark)
    model = toxicity.fit_toxicity(frame, labels, ~held_out(F.col("doc_id"), 5, 0))
    more = docs(spark, [(1000, "a lumpox here"), (1001, "a l.u.m.p.o.x here"), (1002, "a lumpoox here"), (1003, "bara telen"), (1004, ""), (1005, None)])
    score = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(frame.unionByName(more), model, ["doc_id"]).collect()}
    unseen = [i for i in range(300) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(score[i] >= 0.5) == (i % 4 == 0) for i in unseen]) > 0.95
    assert score[1000] >= 0.5 and score[1001] >= 0.5 and score[1002] >= 0.5
    assert max(score[1003], score[1004], score[1005]) < 0.5 and all(0 <= s <= 1 for s in score.values())


def test_toxicity_with_few_toxic_labels(spark):
    """Ten toxic documents of 200 and four insults; then 30 of 6,000, of which a small sample by hash has hardly any."""
    rng = random.Random(7)
    vocabulary = [f"{a}{b}" for a in ("ba", "te", "mi", "so", "ru", "ka") for b in ("ra", "len", "tu", "ko", "dis", "mor")]
    for n, every, most in ((200, 20, 3000), (6000, 200, 300)):
        rows = []
        for i in range(n):
            words = [rng.choice(vocabulary) for _ in range(20)]
            if i % every == 0:
                words[3] = ("trash", "scum", "moron", "loser")[i // every % 4]
            rows.append((i, " ".join(words)))
        labels = spark.createDataFrame([(i, int(i % every == 0)) for i in range(n)], "doc_id long, toxic int")
        model = toxicity.fit_toxicity(docs(spark, rows), labels, F.lit(True), most)
        score = model.score_texts(["bara a scum telen", "a moron miko", *(t for _, t in rows[:100])])
        assert min(score[:2]) >= 0.5
        assert [s >= 0.5 for s in score[2:]] == [i % every == 0 for i in range(100)]


def test_landmarks_of_single_documents():
    sample = toxicity.pd.DataFrame({"text": ["you scum", "good day", "fine words", "more text"], "label": [1, 0, 0, 0]})
    assert toxicity.fit(sample).score_texts(["scum", "fine day"])[0] > toxicity.fit(sample).score_texts(["fine day"])[0]


def test_quality(spark):
    frame, labels = labelled(spark)
    model = quality.fit_quality(frame, labels, ~held_out(F.col("doc_id"), 3, 1))
    more = docs(spark, [(1004, ""), (1005, None), (1006, "word " * 5000)])
    score = {r["doc_id"]: r["score"] for r in quality.score_quality(frame.unionByName(more), model, ["doc_id"]).collect()}
    unseen = [i for i in range(300) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([(score[i] >= 0.5) == (i % 5 != 0) for i in unseen]) > 0.95
    assert score[1004] == score[1005] and all(0 <= s <= 1 for s in score.values())


def test_quality_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(3)
    count, y = np.array([1, 3, 2, 5]), np.array([0.0, 1.0, 1.0, 0.0])
    x = rng.normal(size=(count.sum(), 6))
    w = {"we": rng.normal(size=(6, 4)), "be": rng.normal(size=4), "wu": rng.normal(size=(4, 3)), "wg": rng.normal(size=(4, 3)), "wa": rng.normal(size=3), "wo": rng.normal(size=4), "bo": np.array(0.3)}
    found = quality.gradients(x, count, y, w)

    def loss(weights):
        p = quality._forward(x, count, weights)["p"]
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    for k, v in w.items():
        for at in np.ndindex(v.shape):
            more, less = ({**w, k: v.copy()} for _ in range(2))
            more[k][at] += 1e-6
            less[k][at] -= 1e-6
            assert abs((loss(more) - loss(less)) / 2e-6 - np.asarray(found[k])[at]) < 1e-6


def test_very_long_texts_are_read_in_parts(monkeypatch):
    """With a small limit every text is very long; parts give what the whole text gives."""
    from permuta.llm import shared

    rng = random.Random(12)
    texts = [" ".join(f"w{rng.randrange(400)}" for _ in range(k)).encode() for k in (0, 3, 60, 700, 2000)] + [b"x" * 900, b"a  b\n" * 300]
    whole = [(a, b, x.tolist(), c.tolist()) for a, b, x, c in quality.passages(texts)]
    sets = {i: set(jaccard.shingle_sets(shared.Words(np.frombuffer(t, np.uint8), np.array([0, len(t)])))[0].tolist()) for i, t in enumerate(texts)}
    exact = [len(x) for x in jaccard.exact_sets(texts)]
    for module in (quality, jaccard, substring):
        monkeypatch.setattr(module, "MIX_BYTES", 128)
    for name in ("segments", "binary_parts"):
        monkeypatch.setattr(getattr(shared, name), "__defaults__", (128,))
    parts = [(x.tolist(), c.tolist()) for _, _, x, c in quality.passages(texts)]
    assert sum((c for _, c in parts), []) == sum((c for _, _, _, c in whole), [])
    assert np.abs(np.vstack([x for x, _ in parts]) - np.vstack([x for _, _, x, _ in whole])).max() < 0.2
    got = {i: set(found[at[i - a] : at[i - a + 1]].tolist()) for a, b, found, at in jaccard.sets_of(texts) for i in range(a, b)}
    assert got == sets and [len(x) for x in jaccard.exact_sets(texts)] == exact
    edges = {}
    for a, b, base, data, offsets in substring.normal_parts(texts, 50):
        words = shared.Words(data, offsets)
        owner, start, n, _, piece = substring.read_pieces(words)
        for o, s, k in zip(owner.tolist(), start.tolist(), n.tolist()):
            edges.setdefault(a + o, []).extend(range(base + s, base + s + k))
    assert {i: sorted(e) for i, e in edges.items()} == {i: list(range(len(t.split()) - 49)) for i, t in enumerate(texts) if len(t.split()) >= 50}


def test_repeats_are_compacted_to_long_spans(spark):
    """Document 2 repeats words 10 to 210 of document 1, and 3 those of both, between words of its own."""
    words = [f"w{k}" for k in range(300)]
    rows = [(1, " ".join(words)), (2, " ".join(["x"] * 7 + words[10:210] + ["y"] * 9)), (3, " ".join(["z"] * 3 + words[50:150] + ["u"] * 80 + words[150:260]))]
    got = sorted((r["doc_id"], r["start"], r["stop"], r["source_id"], r["source_start"]) for r in substring.repeated_spans(docs(spark, rows)).collect())
    assert got == [(2, 7, 207, 1, 10), (3, 3, 103, 1, 50), (3, 183, 293, 1, 150)]


@pytest.mark.parametrize("fit, score", [(toxicity.fit_toxicity, toxicity.score_toxicity), (quality.fit_quality, quality.score_quality)])
def test_classifiers_without_labels_or_rows(spark, fit, score):
    frame, labels = labelled(spark, 6)
    model = fit(frame, labels.limit(0), F.lit(True))
    assert all(0 <= r["score"] <= 1 for r in score(frame, model, ["doc_id"]).collect())
    assert score(frame.limit(0), model, ["doc_id"]).count() == 0


# 6


def jaccard_groups(rows):
    sets = {}
    for i, t in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) > 4 else frozenset([tuple(w)] if w else [])
    ids = sorted(i for i in sets if i is not None)
    part = {i: i for i in sets}
    for a in ids:
        for b in ids:
            inter = len(sets[a] & sets[b])
            if a < b and inter and 100 * inter >= 80 * (len(sets[a]) + len(sets[b]) - inter) and part[a] != part[b]:
                one, two = part[a], part[b]
                part = {k: min(one, two) if v in (one, two) else v for k, v in part.items()}
    return sorted(((i, len(sets[i]), part[i]) for i, _ in rows), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_ngram_jaccard(spark, seed):
    rows = corpus(seed)
    assert sorted(map(tuple, jaccard.jaccard_components(docs(spark, rows)).collect()), key=repr) == jaccard_groups(rows)
    assert jaccard.jaccard_components(empty(spark)).count() == 0


def test_ngram_jaccard_small_pages(spark, monkeypatch):
    """Small pages send the same rows through many pages and branches, and one first pair leaves trees open."""
    monkeypatch.setattr(jaccard, "PAGE", 4)
    monkeypatch.setattr(jaccard, "FANOUT", 2)
    rng = random.Random(8)
    passage = [f"p{k}" for k in range(40)]
    rows = [(i, " ".join(passage + [f"u{i}_{k}" for k in range(rng.choice([2, 4, 9, 12]))])) for i in range(40)]
    rows += [(100 + i, " ".join(w if rng.random() > 0.02 else f"x{rng.randrange(9)}" for w in passage * 3)) for i in range(20)]
    chain = [f"c{k}" for k in range(60)]
    rows += [(200 + i, " ".join(chain[2 * i : 2 * i + 30])) for i in range(15)]
    wanted = jaccard_groups(rows)
    for rounds in (0, 2):
        monkeypatch.setattr(jaccard, "ROUNDS", rounds)
        assert sorted(map(tuple, jaccard.jaccard_components(docs(spark, rows)).collect()), key=repr) == wanted


def test_ngram_jaccard_ids_with_two_texts(spark):
    """5 has the text of 3 and that of 7, which is nearly that of 2; so all of them reach 2."""
    one, two = (" ".join(f"{c}{k}" for k in range(40)) for c in "ab")
    rows = [(3, one), (5, one), (5, two), (7, two), (2, two + " z"), (8, "other words that stand alone here")]
    got = {(r["doc_id"], r["component_id"]) for r in jaccard.jaccard_components(docs(spark, rows)).collect()}
    assert got == {(3, 2), (5, 2), (7, 2), (2, 2), (8, 8)}


def thue_morse(n, a, b):
    """Two words or runs of which sums over powers of any odd base are equal modulo 2**64."""
    bits = [bin(k).count("1") & 1 for k in range(n)]
    return [b if k else a for k in bits], [a if k else b for k in bits]


def test_texts_with_colliding_polynomials_stay_apart(spark):
    one, two = ("".join(x) for x in thue_morse(1024, "a", "b"))
    rows = [(1, one), (2, two), (3, " ".join(f"v{k}" for k in range(49)) + " " + one), (4, " ".join(f"v{k}" for k in range(49)) + " " + two)]
    runs = [" ".join(x) for x in thue_morse(1024, "p q", "r s")]
    rows += [(5, runs[0]), (6, runs[1])]
    assert sorted(map(tuple, jaccard.jaccard_components(docs(spark, rows)).collect()), key=repr) == jaccard_groups(rows)
    assert sorted(map(tuple, substring.remove_repeats(docs(spark, rows)).collect()), key=repr) == removed(rows)


def test_exact_sets_are_those_of_words():
    texts = [b"", b"a b", b"a  b\n", b"a b c d e", b"a b c d e f", b"b c d e f  a b c d e", b"e d c b a"]
    sets = jaccard.exact_sets(texts)
    brute = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} - {()} for w in map(bytes.split, texts)]
    for i, x in enumerate(brute):
        for j, y in enumerate(brute):
            assert len(np.intersect1d(sets[i], sets[j])) == len(x & y)


def test_similar_sets_share_a_beginning():
    rng = np.random.default_rng(9)
    grades = rng.integers(0, 9, 1 << 16).astype(np.uint8)
    for n in (1, 2, 4, 5, 7, 10, 23, 80, 400):
        for _ in range(30):
            a = rng.integers(0, 1 << 63, n, dtype=np.uint64) << np.uint64(1)
            shared = -(-80 * n // 100)
            b = np.concatenate([a[:shared], rng.integers(0, 1 << 63, max(0, int(shared * 100 / 80) - n), dtype=np.uint64)])
            if 100 * len(np.intersect1d(a, b)) < 80 * len(np.union1d(a, b)):
                continue
            (a, b) = sorted((np.sort(a), np.sort(b)), key=len)
            _, one, short = jaccard.beginnings(a, np.array([0, len(a)]), grades, 16)
            _, two, _ = jaccard.beginnings(np.concatenate([b, a]), np.array([0, len(b), len(b) + len(a)]), grades, 16)
            assert np.isin(one[short], two[: len(b) - -(-80 * len(b) // 100) + 1]).any()


def test_pages_lose_nothing():
    rng = np.random.default_rng(1)
    counts = rng.poisson(3, (200, 16)).astype(np.int32)
    counts[100:] = np.maximum(0, counts[:100] + rng.integers(-1, 2, (100, 16)) * (rng.random((100, 16)) < 0.3))
    sizes, component = counts.sum(axis=1).astype(np.int64), np.arange(200) // 3
    parts = [jaccard.Page(np.arange(i, 200, 2), sizes[i::2], component[i::2], np.ones(100, bool), counts[i::2]) for i in (0, 1)]
    found = [tuple(sorted(p)) for i, j in ((0, 0), (0, 1), (1, 1)) for p in zip(*(c.to_pylist() for c in parts[i].pairs(parts[j]).columns[:2]))]
    n, m = sizes[:, None], sizes[None]
    ok = (np.minimum(counts[:, None], counts[None]).sum(axis=2) >= jaccard.least_shared(n, m)) & (component[:, None] != component[None])
    ok &= np.maximum(n, m) * 80 <= np.minimum(n, m) * 100
    assert sorted(found) == [(i, j) for i, j in zip(*np.nonzero(np.triu(ok, 1)))] and found
    share = np.where(ok, np.minimum(counts[:, None], counts[None]).sum(axis=2) / (n + m), 0)
    whole = jaccard.Page(np.arange(200), sizes, component, np.ones(200, bool), counts)
    best = whole.pairs(whole, best=True)
    assert best.column(0).to_pylist() and all(s == share[i].max() == share[i, j] for i, j, s in zip(*(c.to_pylist() for c in best.columns)))
    assert sorted(best.column(0).to_pylist()) == np.flatnonzero(ok.any(axis=1)).tolist()


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(50, 60), (60, 55), (70, 70), (50, 60)]
    got = {r["id"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, 50: 50, 55: 50, 60: 50}


# 7 and 8

TEXTS = [None, "", " ", "Hello  world\n\n  it's 12345 <|endoftext|> x", "é" * 50 + " ß\u2003ü", "a" * 300, "end ", " start", "tab\there\r\n", "$$$ %%% !!! | a | b", "word " * 400, "x<|endoftext|>y <|endoftext|>", "\u0085 next\u00a0line", " a  b   c    d"]


@pytest.mark.parametrize("chunk, overlap", [(1 << 15, 1 << 10), (40, 12), (64, 4)])
def test_bpe_equals_the_library(spark, chunk, overlap):
    import public_tokenizers

    path = tokenizer_file("byte_bpe_multi_50k.tiktoken")
    enc = bpe.encoding(path, public_tokenizers.PATTERN)
    rows = [(i, t) for i, t in enumerate(TEXTS + ["The cat. " * 30 + "\n \n" * 9 + "don't stop 99" * 9])] + [(3, TEXTS[3])]
    got = bpe.encode_texts(docs(spark, rows), path, public_tokenizers.PATTERN, ["doc_id"], chunk=chunk, overlap=overlap).collect()
    wanted = []
    for i, t in rows:
        ids = enc.encode_ordinary(t or "")
        wanted.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, got)) == sorted(wanted)
    assert bpe.encode_texts(empty(spark), path, public_tokenizers.PATTERN, ["doc_id"]).count() == 0


def test_bpe_ids_and_bytes(spark):
    import public_tokenizers

    path = tokenizer_file("byte_bpe_multi_50k.tiktoken")
    got = bpe.encode_texts(docs(spark, [(1, "two words"), (2, "w " * 60)]), path, public_tokenizers.PATTERN, ["doc_id"], out="ids", chunk=32, overlap=8).collect()
    assert {r["doc_id"]: bytes(r["decoded"]) for r in got} == {1: b"two words", 2: b"w " * 60}


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_token_counts_equal_the_library(spark, name):
    path = tokenizer_file(name)
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"]) for r in token_counts.token_counts(docs(spark, list(enumerate(TEXTS))), path, ["doc_id"], batch_bytes=64).collect()}
    texts = [t or "" for t in TEXTS]
    if name.endswith(".json"):
        from tokenizers import Tokenizer

        wanted = [len(x.ids) for x in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    else:
        wanted = token_counts.counter(path)(texts)
    assert got == {i: (len(t.encode()), n) for i, (t, n) in enumerate(zip(texts, wanted))}


def test_safe_pieces_join_to_the_text():
    for t in TEXTS:
        assert "".join(token_counts.safe_pieces(t or "")) == (t or "")


# 9


def exact_groups(rows):
    low = lambda t: re.sub("[A-Z]", lambda m: m.group().lower(), t or "")
    groups = {}
    for i, t in rows:
        groups.setdefault(low(t), []).append(i)
    out = []
    for i, t in rows:
        g = groups[low(t)]
        keep = max((x for x in g if x is not None), default=None)
        out.append((i, keep, len(g), i == keep, hashlib.sha256(low(t).encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("old", ["doc_id < 40", "false", "true"])
def test_exact_dedup(spark, old):
    rows = corpus(3) + [(200, "Ünicode"), (201, "ünicode"), (202, "same"), (202, "same")]
    got = exact.exact_dedup(docs(spark, rows), F.expr(old)).collect()
    assert sorted(map(tuple, got), key=repr) == exact_groups(rows)
    assert exact.exact_dedup(empty(spark), F.expr(old)).count() == 0


def test_texts_with_one_digest_are_told_apart(spark):
    """As if 'a' and 'b' had one digest; the id 1 stands for two texts, 5 and a null id repeat rows."""
    rows = [(1, "a"), (1, "c"), (2, "B"), (3, "b"), (4, "c"), (5, "A"), (5, "A"), (None, "b")]
    frame = docs(spark, rows)
    fake = F.when(F.lower("text").isin("a", "b"), "d").otherwise("e")
    keep = F.when(F.lower("text").isin("a", "b"), 5).otherwise(4)
    found = frame.select("doc_id", F.xxhash64("text").alias("th"), keep.cast("bigint").alias("keep_id"), F.when(keep == 5, 6).otherwise(2).cast("bigint").alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), fake.alias("text_sha256"))
    odd = exact.mixed_digests(frame, found)
    assert [tuple(r) for r in odd.collect()] == [("d",)]
    got = sorted((r["doc_id"] or 0, r["keep_id"], r["group_size"], r["kept"]) for r in exact.regrouped(frame, found, odd).collect())
    assert got == [(0, 3, 3, False), (1, 4, 2, False), (1, 5, 3, False), (2, 3, 3, False), (3, 3, 3, True), (4, 4, 2, True), (5, 5, 3, True), (5, 5, 3, True)]


def test_exact_dedup_of_ids_with_two_texts_and_large_groups(spark, monkeypatch):
    monkeypatch.setattr(exact, "SALT_ROWS", 4)
    rows = [(1, "a"), (1, "b"), (2, "a"), (None, "a"), (None, None), (9, "")] + [(100 + i, "Many" if i % 2 else "mANY") for i in range(30)]
    for old in ("doc_id < 110", "false"):
        assert sorted(map(tuple, exact.exact_dedup(docs(spark, rows), F.expr(old)).collect()), key=repr) == exact_groups(rows)


def test_binary_fuse_has_no_false_negatives():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 10, 1000, 30000):
        keys = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        made = exact.BinaryFuse.build(keys)
        assert made.contains(keys).all()
        if n:
            assert made.contains(rng.integers(0, 1 << 63, 20000, dtype=np.uint64)).mean() < 0.02
