"""Substring, byte and line dedup against brute force; the suffix array against sorting."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest

from tandem.llm import anchors, bytedups, lines, substrings, suffixarray, words

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def rows(df, *names):
    return Counter(tuple(r[n] for n in names) for r in df.collect())


def expected_words(corpus, window):
    texts = [(d, SPACE.findall(t or "")) for d, t, *_ in corpus]
    first = {}
    for d, w in texts:
        for i in range(len(w) - window + 1):
            k = tuple(w[i:i + window])
            first[k] = min(first.get(k, (d, i)), (d, i))
    out = Counter()
    for d, w in texts:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if first[tuple(w[i:i + window])] < (d, i):
                gone[i:i + window] = [True] * window
        out[(d, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g)))] += 1
    return out


def test_substrings(documents, corpus):
    assert rows(substrings.op3(documents), "doc_id", "n_words", "n_removed", "kept_sha256") == expected_words(corpus, 20)


def test_substrings_in_small_groups(documents, corpus, monkeypatch):
    """Frequent prefixes are split by longer ones, down to whole windows."""
    monkeypatch.setattr(substrings, "GROUP", 40)
    got = substrings.drop_repeated_passages(documents, 5).select("doc_id", "n_words", "n_removed", "kept").collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, sha(r.kept)) for r in got) == expected_words(corpus, 5)


def test_groups_use_every_prefix_length():
    counts = np.zeros((5, 8), dtype=np.int64)
    counts[0, 0], counts[0, 1], counts[1, 2], counts[2, 3], counts[3, 4], counts[4, 5] = 1000, 10, 1000, 1000, 1000, 1000
    groups = substrings.plan_groups(counts, 100)
    assert groups.group[0, 0] == -1 and groups.group[0, 1] >= 0 and groups.group[3, 4] == -1
    assert groups.split[5] == 10 and groups.count >= 10
    whole = np.arange(1000, dtype=np.uint64)
    dealt = substrings.deal(groups, [np.zeros(1000, int), np.full(1000, 2), np.full(1000, 3), np.full(1000, 4), np.full(1000, 5)], whole)
    assert len(set(dealt)) == 10 and dealt.min() >= 0 and dealt.max() < groups.count


def expected_bytes(corpus, window):
    texts = [(d, (t or "").encode()) for d, t, *_ in corpus]
    seen = Counter(t[i:i + window] for _, t in texts for i in range(len(t) - window + 1))
    out = Counter()
    for d, t in texts:
        gone = np.zeros(len(t) + 1, dtype=int)
        for i in range(len(t) - window + 1):
            if seen[t[i:i + window]] > 1:
                gone[i] += 1
                gone[i + window] -= 1
        gone = np.cumsum(gone)[:len(t)] > 0
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
        out[(d, len(t), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), sha(kept))] += 1
    return out


def test_bytes(documents, corpus, monkeypatch):
    want = expected_bytes(corpus, 400)
    assert rows(bytedups.op9(documents), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want
    monkeypatch.setattr(bytedups, "PIECE", 1000)  # long texts in pieces
    monkeypatch.setattr(bytedups, "SHARD", 5000)
    monkeypatch.setattr(bytedups, "HOT", 2)  # pieces of hot anchors beside whole runs
    assert rows(bytedups.op9(documents), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want


@pytest.mark.parametrize("parts", [2, 12])
def test_equal_rows(spark, parts):
    """Equal rows in the same and in different batches, beside documents that share passages with them in other surroundings."""
    rng = np.random.default_rng(parts)

    def text(n):
        return " ".join("w%d" % x for x in rng.integers(0, 10**6, n))
    rows = []
    for k in range(20):
        shared, twice = [text(80) for _ in range(3)], text(40)
        body = " ".join([text(30), shared[0], twice, text(30), shared[1], twice, text(30), shared[2], text(30)])
        rows += [(100 + k, body)] * 4
        rows += [(k, text(10) + " " + shared[k % 3]), (200 + k, shared[(k + 1) % 3] + " " + text(10))]
    d = spark.createDataFrame(spark.sparkContext.parallelize(sorted(rows, key=lambda r: len(r[1]) % 7 if parts > 2 else r[0] < 100), parts), "doc_id long, text string")
    assert Counter(map(tuple, substrings.op3(d).select("doc_id", "n_words", "n_removed", "kept_sha256").collect())) == expected_words(rows, 20)
    assert Counter(map(tuple, bytedups.op9(d).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect())) == expected_bytes(rows, 400)


@pytest.mark.parametrize("letters", [2, 3, 200])
def test_suffix_array(letters):
    rng = np.random.default_rng(letters)
    for _ in range(150):
        s = np.concatenate([rng.integers(2, 2 + letters, rng.integers(1, 80)), [0]]).astype(np.uint8)
        sa = suffixarray.suffix_array(s)
        assert list(sa) == sorted(range(len(s)), key=lambda i: bytes(s[i:]))
        common = suffixarray.permuted_prefixes(s, sa)
        for a, b in zip(sa[1:], sa[:-1]):
            k = 0
            while s[a + k] == s[b + k]:
                k += 1
            assert common[a] == k


def test_windows_of_joined_texts_stay_inside_them():
    rng = np.random.default_rng(1)
    for _ in range(40):
        bodies = [bytes(rng.integers(97, 99, rng.integers(4, 30)).astype(np.uint8)) for _ in range(rng.integers(1, 9))]
        seen = Counter(b[i:i + 4] for b in bodies for i in range(len(b) - 3))
        got = bytedups.repeated_windows(bodies, 4)
        at = 0
        for b in bodies:
            assert [bool(x) for x in got[at:at + len(b) - 3]] == [seen[b[i:i + 4]] > 1 for i in range(len(b) - 3)]
            at += len(b) + 1


def test_runs_cover_every_window_and_anchors_agree():
    rng = np.random.default_rng(2)
    texts = [bytes(rng.integers(97, 100, n).astype(np.uint8)) for n in (5, 30, 31, 200, 64)] + [b"a" * 100]
    texts.append(texts[3][20:150])
    size = np.array([len(t) for t in texts])
    v, first, n, place = anchors.runs(np.frombuffer(b"".join(texts), np.uint8), np.cumsum(size) - size, np.cumsum(size), 30, 8)
    data = b"".join(texts)
    starts = [int(a) + i for a, k in zip(first, n) for i in range(k)]
    assert starts == [int(b) + i for b, s in zip(np.cumsum(size) - size, size) for i in range(max(0, s - 29))]
    anchor = {}
    for a, k, x in zip(first, n, v):
        for i in range(k):
            assert anchor.setdefault(data[a + i:a + i + 30], x) == x
    assert all(a <= p and p + 8 <= a + 30 for a, p in zip(first, place))
    run, begin, short, share = anchors.shorter_runs(first, n, place, 4)
    assert [int(a) + i for a, k in zip(begin, short) for i in range(k)] == [s for s in sorted(starts)] and (short > 0).all() and (short <= 4).all()
    shared = {}
    for r, a, k, s in zip(run, begin, short, share):
        for i in range(a, a + k):  # equal windows lie in pieces with equal shared bytes at equal distances
            key = (data[s:s + 27], int(place[r] - s))
            assert i <= s and s + 27 <= i + 30 and shared.setdefault(data[i:i + 30], key) == key


def test_word_hashes_are_those_of_the_words():
    texts = ["", "a b  a\tb", "é ß", " lead", "tail ", "a b"]
    w = words.words_of([t.encode() for t in texts])
    found = [bytes(w.data[s:e]).decode() for s, e in zip(w.start, w.end)]
    assert found == [x for t in texts for x in SPACE.findall(t)]
    assert list(np.diff(w.text)) == [len(SPACE.findall(t)) for t in texts]
    assert len({(x, h) for x, h in zip(found, w.hash)}) == len(set(found)) == len(set(w.hash))


def expected_lines(corpus, least=2):
    def key(line):
        return re.sub(r"[A-Z]", lambda m: m.group().lower(), line.strip("\x20\x09\x0a\x0b\x0c\x0d"))
    holders = {}
    for d, t, *_ in corpus:
        for line in (t or "").split("\n"):
            holders.setdefault(key(line), set()).add(d)
    out = Counter()
    for d, t, *_ in corpus:
        all_lines = (t or "").split("\n")
        kept = [x for x in all_lines if not (len(key(x)) >= 10 and len(holders[key(x)]) >= least and min(holders[key(x)]) != d)]
        out[(d, len(all_lines), len(all_lines) - len(kept), sha("\n".join(kept)))] += 1
    return out


def test_lines(documents, corpus):
    assert rows(lines.op4(documents), "doc_id", "n_lines", "n_dropped", "kept_sha256") == expected_lines(corpus)
    assert sum(n for (_, _, dropped, _), n in expected_lines(corpus).items() if dropped) > 10


def test_lines_keep_rows_and_columns(documents, corpus):
    out = lines.drop_repeated_lines(documents, min_docs=3)
    assert out.columns[:-2] == documents.columns
    assert sum(r._ld_dropped for r in out.collect()) == sum(k[2] * n for k, n in expected_lines(corpus, 3).items())
    assert out.where("text is null").count() == sum(t is None for _, t, *_ in corpus)


@pytest.mark.parametrize("op", [substrings.op3, bytedups.op9, lines.op4])
def test_empty_table(no_documents, op):
    assert op(no_documents).count() == 0


@pytest.mark.parametrize("op", [substrings.op3, bytedups.op9, lines.op4])
def test_rows_without_id_are_kept(spark, op):
    text = "the same long line of words again and again " * 30
    d = spark.createDataFrame([(None, text), (None, text), (1, text)], "doc_id long, text string")
    got = op(d).collect()
    assert sorted(str(r.doc_id) for r in got) == ["1", "None", "None"]
    assert all((r.n_removed if "n_removed" in r else r.n_dropped) == 0 for r in got if r.doc_id is None)
