"""SimHash near-dedup, decontamination, top-k products, mixing and the pipeline against brute force."""

import random
import re
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tandem.llm import leaks, mixing, search, simhash

SPACE = re.compile(rb"[^\x20\x09-\x0D]+")


def plain_fingerprint(text):
    import xxhash
    words = SPACE.findall(re.sub(rb"[A-Z]", lambda m: m.group().lower(), (text or "").encode()))
    shingles = [b" ".join(words[i:i + 4]) for i in range(len(words) - 3)] if len(words) >= 4 else [b" ".join(words)] if words else []
    hashes = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def components(ids, linked):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in linked:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def expected_groups(pairs, radius):
    linked = [(a, b) for k, (a, x) in enumerate(pairs) for b, y in pairs[:k] if (x ^ y).bit_count() <= radius]
    return components({a for a, _ in pairs}, linked)


def test_simhash(documents, corpus):
    prints = [(d, plain_fingerprint(t)) for d, t, *_ in corpus]
    want = expected_groups(prints, 4)
    got = Counter((r.doc_id, r.fingerprint, r.component_id) for r in simhash.op6(documents).collect())
    assert got == Counter((d, f"{f:016x}", want[d]) for d, f in prints)


@pytest.mark.parametrize("bucket, paired", [(10_000, 24), (10_000, 2), (20, 4)])
def test_links_of_dense_groups(spark, monkeypatch, bucket, paired):
    """Few centres, many nodes within a few bits: small buckets, large ones, and such as are dealt out again."""
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    monkeypatch.setattr(simhash, "PAIRED", paired)
    rng = random.Random(bucket + paired)
    centres = [rng.getrandbits(64) for _ in range(4)] + [0]
    fps = {0, 1, 2**64 - 1}
    while len(fps) < 400:
        x = rng.choice(centres)
        for b in rng.sample(range(64), rng.randint(0, 7)):
            x ^= 1 << b
        fps.add(x)
    signed = sorted(x - (1 << 64) if x >> 63 else x for x in fps)
    nodes = spark.createDataFrame([(x,) for x in signed], "fp long").repartition(3)
    want = expected_groups([(x, x & (2**64 - 1)) for x in signed], 4)
    roots = simhash.components(simhash.find_links(nodes, 4, 4)).df.collect()
    got = {x: x for x in signed} | {r.fp: r.root for r in roots}
    assert got == want


def test_components_of_paths_stars_and_blocks(spark):
    rng = np.random.default_rng(4)
    name = rng.permutation(400).tolist()  # labels in any order along the paths
    links = [(k, k + 1) for k in range(60)] + [(name[k] + 1000, name[k + 1] + 1000) for k in range(120)] + [(5000, k) for k in range(4000, 4050)]
    links += [(k, 2000) for k in range(2001, 2040)] + [(7, 7), (3001, 3000), (3000, 3001)] + [(int(a) + 6000, int(b) + 6000) for a, b in rng.integers(0, 300, (250, 2))]
    got = simhash.components(spark.createDataFrame(links, "a long, b long")).df.collect()
    ids = {x for a, b in links if a != b for x in (a, b)}
    want = components(ids, links)
    assert len(got) == len(ids) and {r.fp: r.root for r in got} == want
    assert simhash.components(spark.createDataFrame([], "a long, b long")).df.count() == 0


def test_parts_and_thresholds():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2, (500, 32))
    bits = np.concatenate([base, base], axis=1)  # bit k repeats bit k + 32
    both = (bits.T @ bits).astype(float)
    parts = simhash.correlated_parts(500, both, 4)
    assert sorted(b for p in parts for b in p) == list(range(64))
    assert all(sum(1 for b in p if (b + 32) % 64 in p) >= 14 for p in parts)  # correlated bits stand together
    for radius in (2, 4, 8):
        plan = simhash.plan_parts(10**6, both, radius)
        assert all(t >= 0 for _, t in plan)
    cost, ts = simhash.allocate([[1, 5, 50], [3, 4, 5], [2, 9, 90]], 2)
    assert sum(ts) == 2 - 3 + 1 and cost == min(
        sum(c[t] for c, t in zip([[1, 5, 50], [3, 4, 5], [2, 9, 90]], x) if t >= 0)
        for x in [(a, b, c) for a in range(-1, 3) for b in range(-1, 3) for c in range(-1, 3)] if sum(x) == 0)


def test_one_of_each_group_stays(spark, documents, corpus):
    texts = {}
    for d, t, *_ in corpus:
        texts.setdefault(d, t)
    ids = sorted(texts)
    close = [(a, b) for k, a in enumerate(ids) for b in ids[:k] if simhash.jaccard(texts[a], texts[b], 5) >= 0.8]
    group = components(ids, close)
    kept = [r.doc_id for r in simhash.one_of_each(documents).collect()]
    assert len(kept) == len(set(kept)) and set(kept) <= set(ids)
    assert set(group.values()) <= {group[d] for d in kept}  # no group is lost
    extra = len(kept) - len(set(group.values()))
    assert 0 <= extra <= 1  # near copies that the fingerprints keep apart are rare
    assert simhash.one_of_each(documents).columns == documents.columns


def edited_pairs(rng, vocabulary, n):
    """Pairs of texts with a block appended, cut or replaced, or words scattered, so that J is 0.8 to 0.9."""
    while n:
        base = [rng.choice(vocabulary) for _ in range(rng.randint(80, 300))]
        k = rng.randint(len(base) // 20, len(base) // 4)
        at = rng.randrange(len(base) - k)
        block = [rng.choice(vocabulary) for _ in range(k)]
        near = [base + block, base[:at] + base[at + k:], base[:at] + block[:k // 2] + base[at + k // 2:], list(base)][n % 4]
        if n % 4 == 3:
            for j in rng.sample(range(len(base)), max(1, len(base) // 60)):
                near[j] = "other"
        a, b = " ".join(base), " ".join(near)
        if 0.8 <= simhash.jaccard(a, b, 5) <= 0.9:
            yield a, b
            n -= 1


def test_edited_blocks_are_found(spark):
    rng = random.Random(3)
    pairs = list(edited_pairs(rng, ["v%d" % k for k in range(5000)], 400))
    d = spark.createDataFrame([(2 * i + j, t) for i, p in enumerate(pairs) for j, t in enumerate(p)], "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(d).collect()}
    assert got == {2 * i + j: 2 * i for i in range(len(pairs)) for j in (0, 1)}


def test_template_families(spark, monkeypatch):
    """Pages of one template, each with one near copy: crowded buckets whose first node is like none of the others."""
    monkeypatch.setattr(simhash, "BLOCK", 32, raising=False)
    rng = random.Random(4)
    template = ["t%d" % k for k in range(170)]
    texts = []
    for k in range(300):
        own = ["p%d_%d" % (k, j) for j in range(40)]
        texts += [" ".join(template + own), " ".join(template + own[:-3] + ["x%d" % k, "y", "z"])]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    want = components(range(600), [(a, b) for a in range(600) for b in range(a) if a // 2 == b // 2])
    assert simhash.jaccard(texts[0], texts[2], 5) < 0.8 <= simhash.jaccard(texts[0], texts[1], 5)
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r.doc_id: r.component_id for r in simhash.similar_groups(d).collect()} == want


def test_texts_of_few_words(spark):
    """All texts have the same two- and nearly the same three-word shingles; only near copies are alike in five."""
    rng = random.Random(6)
    texts = []
    for k in range(60):
        body = [rng.choice("abcd") for _ in range(400)]
        texts += [" ".join(body), " ".join(body + [rng.choice("abcd") for _ in range(20)])]
    want = components(range(120), [(a, b) for a in range(120) for b in range(a) if simhash.jaccard(texts[a], texts[b], 5) >= 0.8])
    assert len(set(want.values())) == 60
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert {r.doc_id: r.component_id for r in simhash.similar_groups(d).collect()} == want


def test_links_of_a_block():
    rng = np.random.default_rng(8)
    sets = [np.sort(rng.choice(60, 40 + k % 12, replace=False)).astype(np.uint64) for k in range(40)]
    rows = [(k, k, x.tobytes()) for k, x in enumerate(sets)]
    alike = [(a, b) for a in range(15) for b in range(40) if a != b and len(np.intersect1d(sets[a], sets[b])) / len(np.union1d(sets[a], sets[b])) >= 0.65]
    got = simhash.block_links(rows[:15], rows, 0.65)
    assert alike and set(got) <= set(alike) and components(range(40), got) == components(range(40), alike)


def test_simhash_empty_and_null(spark, no_documents):
    assert simhash.op6(no_documents).count() == 0 and simhash.one_of_each(no_documents).count() == 0
    d = spark.createDataFrame([(None, "a b c d e"), (5, "a b c d e"), (5, "a b c d e"), (3, None), (4, "  ")], "doc_id long, text string")
    got = Counter((r.doc_id, r.component_id) for r in simhash.op6(d).collect())
    assert got == Counter({(None, None): 1, (5, 5): 2, (3, 3): 1, (4, 3): 1})
    assert sorted(str(r.doc_id) for r in simhash.one_of_each(d).collect()) == ["3", "5", "None"]


def test_leaks(spark):
    rng = random.Random(5)
    vocabulary = ["w%d" % k for k in range(3000)]

    def words(n):
        return [rng.choice(vocabulary) for _ in range(n)]
    items = [words(40) for _ in range(30)] + [words(15), words(9), []]
    docs, want, never = [], set(), set()
    for d in range(300):
        w = words(rng.choice([0, 5, 80, 400]))
        k = d % 30
        if d % 4 == 0:  # whole, with every ninth word substituted: identity 0.89
            w[3:3] = [x if j % 9 else "other" for j, x in enumerate(items[k])]
            want.add((d, k))
        elif d % 4 == 1:  # 20 words of it
            w += items[k][10:30]
            want.add((d, k))
        elif d % 4 == 2:  # eight words are no passage
            w += items[k][:8]
            never.add(d)
        docs.append((d, " ".join(w).upper() if d % 8 == 0 else ", ".join(w), d))
    docs += [(900, None, 0), (None, " ".join(items[0]), 0), (0, docs[0][1], 0)]
    table = spark.createDataFrame(docs, "doc_id long, text string, seed int").repartition(3)
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)] + [(99, None), (0, " ".join(items[0]))], "item_id long, text string")
    found = leaks.op5(table, bench).collect()
    got = {(r.doc_id, r.item_id) for r in found}
    assert got == want and len(found) == len(want)
    assert all(r.n_equal >= 0.8 * r.n_words for r in found)
    assert leaks.op5(table.limit(0), bench).count() == 0 and leaks.op5(table, bench.limit(0)).count() == 0


def test_seeds_hit_every_allowed_pattern():
    """Stretches of 10 to 25 words with at most a fifth of them substituted, wherever those stand."""
    masks = [sum(1 << k for k, c in enumerate(m) if c == "1") for m in leaks.MASKS]
    for n in range(10, 26):
        other = np.array([sum(1 << k for k in x) for x in combinations(range(n), n // 5)])
        hit = np.zeros(len(other), dtype=bool)
        for m in masks:
            for at in range(n - leaks.SPAN + 1):
                hit |= other & (m << at) == 0
        assert hit.all(), n


def test_longest_stretch():
    rng = np.random.default_rng(9)
    for _ in range(300):
        same = rng.random(rng.integers(0, 40)) < 0.7
        fit = [(a, b) for a in range(len(same)) for b in range(a + 1, len(same) + 1) if same[a] and same[b - 1] and same[a:b].sum() >= 0.8 * (b - a) - 1e-9]
        a, b = leaks.best_stretch(same, 0.8)
        assert b - a == max((y - x for x, y in fit), default=0) and (not fit or (a, b) in fit)


def test_short_and_edited_items(spark):
    words = ["u%d" % k for k in range(400)]
    items = [words[0:13], words[20:35], words[40:60], words[70:73], words[80:89], words[100:101]]
    subs = [(2, 3), (3, 6, 9), (3, 7, 11, 15), (), (), ()]
    docs = [["before"] * k + ["other" if j in s else w for j, w in enumerate(x)] + ["after"] * (k % 2) for k, (x, s) in enumerate(zip(items, subs))]
    docs.append(words[70:72] + words[80:88])  # short items count only whole
    table = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(docs)], "doc_id long, text string").repartition(2)
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in leaks.find_leaks(table, bench).collect()} == {(k, k) for k in range(6)}


def test_leaks_of_the_table(spark, sf_dir):
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    want = {(d.doc_id, b.item_id) for d in docs.collect() for b in bench.collect() if b.text in (d.text or "")}
    assert {(r.doc_id, r.item_id) for r in leaks.op5(docs, bench).collect()} == want and want


def plain_top(vectors, every, k):
    fit = [(i, [int(np.floor(1024 * float(np.float32(x)))) for x in v]) for i, v in vectors
           if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for q in {i for i, _ in fit if i % every == 0}:
        v = next(v for i, v in fit if i == q)
        best = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in fit if i != q)[:k]
        out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(best)}
    return out


def test_top_products(spark, monkeypatch):
    rng = np.random.default_rng(1)
    vectors = [(i, [float(np.float32(x)) for x in rng.normal(0, 1 + i % 3, 6)]) for i in range(300)]
    vectors += [(i, vectors[7][1]) for i in range(300, 340)]  # one common vector
    vectors += [(401, None), (402, [1.0, None] + [0.0] * 4), (500, [float("nan")] * 6), (501, [float("inf")] * 6), (None, [1.0] * 6), (600, [0.0] * 6)]
    d = spark.createDataFrame([(i, v, 0) for i, v in vectors], "vec_id long, embedding array<float>, score int").repartition(4)
    got = {(r.query_id, r["rank"], r.vec_id, r.score) for r in search.op7(d).collect()}
    assert got == plain_top(vectors, 100, 10)
    monkeypatch.setattr(search, "BLOCK", 2)
    monkeypatch.setattr(search, "PER_PART", 50)
    monkeypatch.setattr(search, "AT_ONCE", 16)
    monkeypatch.setattr(search, "LONGEST", 5)
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in search.top_products(d, 20, 7).collect()} == plain_top(vectors, 20, 7)
    assert search.op7(d.limit(0)).count() == 0
    few = d.where("vec_id in (0, 1, 2)")
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in search.op7(few).collect()} == plain_top(vectors[:3], 100, 10)


@pytest.fixture(scope="module")
def sources(spark):
    """One source with most of the tokens, small ones, one without tokens, one null."""
    rows = [(i, "a b c " * 20, "big") for i in range(300)] + [(1000 + i, "w " * (5 + i), "s%d" % (i % 3)) for i in range(30)]
    rows += [(2000, "", "empty"), (2001, None, "empty"), (2002, "x y", None), (2003, "z", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)


def mixture(df, target):
    return mixing.mix(df, target).toPandas()


def test_entropy_target(spark, sources):
    base = mixing.source_table(sources.select(F.col("source").alias("_mx_source"), F.regexp_count("text", F.lit(mixing.TOKEN)).alias("_mx_tokens")))
    for share in (0.5, 0.8, 0.99):
        fitted = mixing.bisect_exponent(base, mixing.Target(entropy=share))
        t = np.array([r._mx_t for r in base.collect()], dtype=float)
        p = (t / t.sum()) ** fitted.exponent
        p /= p.sum()
        assert abs(-(p * np.log(p)).sum() - share * np.log(len(t))) < 1e-4


def test_budgets_are_met_by_whole_passes_and_one_part(sources):
    for target in (mixing.Target(entropy=0.9), mixing.Target(entropy=None, max_epochs=2.5), mixing.Target(entropy=0.99, budget=0.1)):
        got = mixture(sources, target)
        tokens = {r.doc_id: len((r.text or "").split()) for r in sources.collect()}
        size = Counter()
        for r in sources.collect():
            size[r.source] += tokens[r.doc_id]
        total = sum(size.values())
        assert "empty" not in set(got["_mx_source"])
        for name, rows in got.groupby(got["_mx_source"].fillna("null")):
            own = size[None if name == "null" else name]
            budget = int(rows["_mx_weight"].iloc[0] * target.budget * total)
            drawn = rows["_mx_tokens"].sum()
            longest = max(tokens[r.doc_id] for r in sources.collect() if (r.source or "null") == name)
            assert budget - longest < drawn <= budget
            full = budget // own
            epochs = rows.groupby("_mx_epoch")["_mx_id"]
            assert all(ids.nunique() == len(ids) for _, ids in epochs)
            assert all(rows[rows["_mx_epoch"] == e]["_mx_tokens"].sum() == own for e in range(full))
            if target.max_epochs:
                assert drawn <= target.max_epochs * own + longest


def test_mixture_is_the_same_every_time(sources):
    columns = ["_mx_id", "_mx_epoch", "_mx_block"]
    a, b = (Counter(map(tuple, mixture(s, mixing.Target())[columns].to_numpy())) for s in (sources, sources.repartition(7)))
    assert a == b


def test_mixture_cases(spark, sources):
    assert mixing.op2(sources.limit(0)).count() == 0
    assert mixing.op2(sources.where("source = 'empty'")).count() == 0
    one = mixing.mix(sources.where("source = 'big'"), keep=["doc_id", "text"])
    assert one.count() == 300 and one.where("text is null").count() == 0


def test_pipeline_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "line_dedup", "near_dedup", "decontaminate", "mix_sources"]
    junk = spark.createDataFrame([(900_001, "0123 4567 !!", None, "src0", 12), (900_002, None, "en", "src1", 0), (900_003, "щюя " * 30, None, "src1", 120)], docs.schema)
    first = corpus_pipeline.language_id(spark, docs.unionByName(junk), sf_dir)
    assert first.columns == docs.columns and first.count() == docs.count() and first.where("doc_id >= 900001").count() == 0
    lines = corpus_pipeline.line_dedup(spark, first, sf_dir)
    assert lines.columns == docs.columns and lines.count() == docs.count()
    assert lines.where("n_chars <> char_length(text)").count() == first.where("n_chars <> char_length(text)").count()
    near = corpus_pipeline.near_dedup(spark, lines, sf_dir)
    assert near.columns == docs.columns and near.count() < docs.count()
    bench = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    clean = corpus_pipeline.decontaminate(spark, near, sf_dir).collect()
    want = {r.doc_id for r in near.collect() if not any(b in (r.text or "") for b in bench)}
    assert {r.doc_id for r in clean} == want
    last = corpus_pipeline.run(spark, sf_dir)
    assert set(docs.columns) <= set(last.columns) and last.count() > 100
    assert {r.doc_id for r in last.select("doc_id").distinct().collect()} <= want


def test_pipeline_of_nothing(spark, sf_dir, tmp_path):
    spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf_dir}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_rows_with_one_id_and_unlike_texts_are_documents_of_their_own(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    a, b, c = ([word() for _ in range(80)] for _ in range(3))
    near = list(b)
    near[40] = "other"
    text = " ".join
    schema = "doc_id long, text string, lang string"

    def kept(rows):
        return sorted((r.doc_id, r.text) for r in simhash.one_of_each(spark.createDataFrame(rows, schema).repartition(3)).collect())
    assert kept([(1, text(a), "x"), (1, text(b), "x"), (2, text(c), "y")]) == sorted([(1, text(a)), (1, text(b)), (2, text(c))])
    # b and its near copy are one group, whose first row is (1, b); a stays beside it
    assert kept([(1, text(a), "x"), (1, text(b), "x"), (2, text(near), "y")]) == sorted([(1, text(a)), (1, text(b))])
    # repeated rows: one stays, always the same
    rows = [(3, text(c), "z"), (3, text(c), None), (3, text(c), "y"), (4, text(c), "x")]
    first = [tuple(r) for r in simhash.one_of_each(spark.createDataFrame(rows, schema).repartition(2)).collect()]
    assert len(first) == 1 and first == [tuple(r) for r in simhash.one_of_each(spark.createDataFrame(rows[::-1], schema).repartition(5)).collect()]


def test_mixing_stage_replaces_columns_of_its_names(spark):
    import corpus_pipeline
    d = spark.createDataFrame([(k, "some words here %d" % k, "en", "s%d" % (k % 2), 5, 9, "w") for k in range(20)],
                              "doc_id long, text string, lang string, source string, n_chars long, Mix_epoch int, mix_weight string")
    got = corpus_pipeline.mix_sources(spark, d, "")
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "mix_epoch", "mix_block", "mix_weight"]
    assert dict(got.dtypes)["mix_weight"] == "double" and got.count() >= 10


def test_near_dedup_goes_by_fingerprints(spark, monkeypatch):
    """SimHash links are candidates of the pipeline's stage: enough to join all texts within the radius, and read by it."""
    rng = np.random.default_rng(8)
    base = [" ".join(f"w{x}" for x in rng.integers(0, 5000, 400)) for _ in range(6)]
    texts = [b + tail for b in base for tail in ("", " end", " close")]
    prints = [simhash.fingerprint(t) for t in texts]
    want = components(range(len(texts)), [(a, b) for a in range(len(texts)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 4])
    assert len(set(want.values())) < len(texts)
    nodes = spark.createDataFrame([(i, int(np.uint64(p).view(np.int64))) for i, p in enumerate(prints)], "fp long, sim long")
    links = [(r.a, r.b) for r in simhash.print_links(nodes, 4, 4).collect() if r.a != r.b]
    assert components(range(len(texts)), links) == want
    read, own = [], simhash.print_links
    monkeypatch.setattr(simhash, "print_links", lambda *a: read.append(1) or own(*a))
    kept = simhash.one_of_each(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert read and sorted(r.doc_id for r in kept) == [0, 3, 6, 9, 12, 15]
