"""SimHash near-dedup: fingerprints, links by the generalised pigeonhole principle, connected components.

Two fingerprints within ``radius`` bits must agree closely in some part of any partition of the 64 bits: for
thresholds t_1..t_m that sum to radius - m + 1, some part i differs in at most t_i bits.  Parts are made of
correlated bits (they repeat each other's information, so they belong together), and the thresholds are not equal:
a dynamic programme gives each part the threshold that makes the estimated number of probes and candidates least.
Only parts with a threshold >= 0 are probed: every fingerprint is listed under its own value of the part, and looks
under all values within t_i bits.  Candidates are verified on all 64 bits.

Fingerprints follow the contract: A-Z in lower case, words ``[^\\x20\\x09-\\x0D]+``, 4-word shingles with repeats
(fewer words: the whole sequence; none: zero), XXH64 with seed 42, a bit is 1 where over half the hashes have it.

Defined cases: null and empty texts have fingerprint zero and are linked like any other; rows that repeat a doc_id
each have a row in the result and may share or link components; null doc_ids get a fingerprint, no component (null)
and link nothing; an empty table gives an empty result.

Scale: equal fingerprints are one node whatever the number of copies, found with partial aggregates.  Inside a bucket
a task keeps only links to the first node of each local component, so a dense group leaves one link a node, never all
pairs; a bucket above ``BUCKET`` nodes is dealt out again by its remaining bits (``_dealt_again``).  Components come from
contracting the links round by round over written tables; nothing is collected on the driver but 64 x 64 counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tandem.llm.storage import Stored, ready, stored
from tandem.llm.words import chunks, last_start, mixed, windows, words_of

SEED = 42
SHINGLE = 4
BITS = 64
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: str | None, n: int = SHINGLE, repeats: bool = True) -> int:
    """64 bits; ``repeats``: a shingle counts as often as it occurs."""
    import xxhash

    words = (text or "").encode("utf-8").translate(LOWER).split()  # bytes.split() parts at exactly these six characters
    if not words:
        return 0
    if len(words) <= n:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    line = b" ".join(words)
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    end = np.cumsum(size + 1) - 1
    start = (end - size)[:len(words) - n + 1].tolist()
    digest = xxhash.xxh64_digest
    shingles = [line[s:e] for s, e in zip(start, end[n - 1:].tolist())]
    raw = b"".join([digest(x, SEED) for x in (shingles if repeats else set(shingles))])
    ones = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1)
    set_in = ones.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(set_in * 2 > len(ones)).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        got = np.fromiter((fingerprint(t.as_py()) for t in batch.column(1)), dtype=np.uint64, count=len(batch))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got.view(np.int64))], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    ready(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_fingerprints, "doc_id long, fp long")


# -- parts and thresholds -------------------------------------------------------------------------------------------

def _bit_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    both = np.zeros((BITS, BITS))
    n = 0
    for batch in batches:
        fp = batch.column(0).to_numpy().view(np.uint64)
        ones = np.unpackbits(fp.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).astype(np.float32)
        both += ones.T @ ones
        n += len(fp)
    if n:
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([both.reshape(-1).tolist()], pa.list_(pa.float64()))], names=["n", "both"])


def bit_statistics(nodes: DataFrame) -> tuple[int, np.ndarray]:
    """Number of nodes, and for every two bits (most significant first) in how many nodes both are set."""
    part = nodes.select("fp").mapInArrow(_bit_counts, "n long, both array<double>").select("n", F.posexplode("both").alias("at", "v"))
    rows = part.groupBy("at").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect()  # 4096 rows
    both = np.zeros(BITS * BITS)
    for r in rows:
        both[r["at"]] = r["v"]
    return (rows[0]["n"] if rows else 0), both.reshape(BITS, BITS)


def correlated_parts(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """``m`` parts of nearly equal width; each grows by the free bit that correlates most with those it has."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.clip(p * (1 - p), 1e-12, None))
    corr = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    free = set(range(BITS))
    parts = []
    for k in range(m):
        width = BITS // m + (k < BITS % m)
        part = [max(free, key=lambda b: (sum(corr[b, c] for c in free if c != b), -b))]
        free.remove(part[0])
        while len(part) < width:
            nxt = max(free, key=lambda b: (sum(corr[b, c] for c in part), -b))
            part.append(nxt)
            free.remove(nxt)
        parts.append(sorted(part))
    return parts


def estimate(n: int, both: np.ndarray, part: list[int], radius: int) -> list[tuple[float, float]]:
    """For t = 0..radius: probes of one node, and estimated candidates of all (bits of a part taken as independent)."""
    p = np.diag(both)[part] / max(n, 1)
    differ = 2 * p * (1 - p)
    chance = np.zeros(radius + 1)
    chance[0] = 1.0
    for d in differ:
        chance[1:] = chance[1:] * (1 - d) + chance[:-1] * d
        chance[0] *= 1 - d
    probes = np.cumsum([len(list(combinations(range(len(part)), t))) if t < 3 else np.inf for t in range(radius + 1)])
    return [(float(probes[t]), float(n) * n * float(chance[:t + 1].sum())) for t in range(radius + 1)]


def allocate(costs: list[list[float]], radius: int) -> tuple[float, list[int]]:
    """Thresholds >= -1 that sum to radius - m + 1 at the least total cost (-1: the part is not probed, cost 0)."""
    total = radius + 1  # sum of t + 1 over the parts
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for cost in costs:
        nxt: dict[int, tuple[float, list[int]]] = {}
        for used, (c, ts) in best.items():
            for t in range(-1, radius - used + 1):
                add = 0.0 if t < 0 else cost[t]
                at = used + t + 1
                if at <= total and (at not in nxt or c + add < nxt[at][0]):
                    nxt[at] = (c + add, [*ts, t])
        best = nxt
    return best[total]


def plan_parts(n: int, both: np.ndarray, radius: int) -> list[tuple[list[int], int]]:
    """The cheapest partition: parts to probe with their thresholds."""
    found = None
    for m in range(1, radius + 4):
        parts = correlated_parts(n, both, m)
        costs = [[n * pr + cand / 100 for pr, cand in estimate(n, both, part, radius)] for part in parts]
        cost, ts = allocate(costs, radius)
        if np.isfinite(cost) and (found is None or cost < found[0]):
            found = cost, [(part, t) for part, t in zip(parts, ts) if t >= 0]
    return found[1]


# -- links ----------------------------------------------------------------------------------------------------------

#: Buckets with more nodes are dealt out again; up to PAIRED nodes their pairs are compared row against shifted row.
BUCKET = 10_000
PAIRED = 24
PROBE = "part int, key long, own boolean, fp long"


def part_value(fp: np.ndarray, part: list[int]) -> np.ndarray:
    out = np.zeros(len(fp), dtype=np.uint64)
    for k, bit in enumerate(part):
        out |= ((fp >> np.uint64(BITS - 1 - bit)) & np.uint64(1)) << np.uint64(k)
    return out


def _probes(plan: list[tuple[list[int], int]]):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0)
            raw = fp.to_numpy().view(np.uint64)
            for i, (part, t) in enumerate(plan):
                value = part_value(raw, part)
                for k in range(t + 1):
                    for flips in combinations(range(len(part)), k):
                        key = value ^ np.uint64(sum(1 << b for b in flips))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(raw), i, np.int32)), pa.array(key.view(np.int64)), pa.array(np.full(len(raw), k == 0)), fp],
                            names=["part", "key", "own", "fp"])
    return rows


def _dealt_again(plan: list[tuple[list[int], int]], radius: int):
    """Rows of a large bucket under each of radius + 1 groups of the bits outside its part.

    Nodes within the radius agree on one of those groups entirely; the group and its value extend the key.
    """
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, key = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            raw = batch.column(3).to_numpy().view(np.uint64)
            for i in np.unique(part):
                rest = [b for b in range(BITS) if b not in plan[i][0]]
                at = np.flatnonzero(part == i)
                for g in range(radius + 1):
                    value = part_value(raw[at], rest[g::radius + 1]) | np.uint64((g + 1) << 56)
                    longer = (key[at] * np.uint64(0x9E3779B97F4A7C15)) ^ (value * np.uint64(0xC2B2AE3D27D4EB4F))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(part[at]), pa.array(longer.view(np.int64)), batch.column(2).take(pa.array(at)), batch.column(3).take(pa.array(at))],
                        names=["part", "key", "own", "fp"])
    return rows


def _root(parent: np.ndarray, i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def local_links(fp: np.ndarray, own: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a large bucket, of (own, any) pairs within the radius: a spanning forest, and each node's nearest one."""
    parent = np.arange(len(fp))
    a: list[int] = []
    b: list[int] = []
    mine = np.flatnonzero(own)
    for lo in range(0, len(mine), 64):
        rows = mine[lo:lo + 64]
        apart = np.bitwise_count(fp[rows, None] ^ fp[None, :])
        apart[np.arange(len(rows)), rows] = BITS + 1
        for k in np.flatnonzero((apart <= radius).any(axis=1)):
            i, near = int(rows[k]), np.flatnonzero(apart[k] <= radius)
            a.append(i)
            b.append(int(apart[k].argmin()))
            root = _root(parent, i)
            while len(near := near[parent[near] != root]):
                j = int(near[0])
                other = _root(parent, j)
                if other == root:
                    parent[j] = root
                    continue
                a.append(i)
                b.append(j)
                low = min(root, other)
                parent[[root, other, i, j]] = low
                parent[near[parent[near] == other]] = low
                root = low
    return fp[a], fp[b]


def bucket_links(group: np.ndarray, fp: np.ndarray, own: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of many whole buckets, which lie one after the other."""
    edge = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]]))
    size = np.diff(edge)
    mine = np.repeat(size, size)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for step in range(1, min(PAIRED, int(size.max(initial=0)))):
        i = np.flatnonzero((group[step:] == group[:-step]) & (mine[step:] <= PAIRED) & (own[step:] | own[:-step]))
        i = i[np.bitwise_count(fp[i] ^ fp[i + step]) <= radius]
        i = i[fp[i] != fp[i + step]]
        found.append((fp[i + step], fp[i]))
    for k in np.flatnonzero(size > PAIRED):
        found.append(local_links(fp[edge[k]:edge[k + 1]], own[edge[k]:edge[k + 1]], radius))
    if not found:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


def _linked(radius: int):
    """Reads rows sorted by bucket; a bucket may go on in the next batch, so the last one waits for it."""
    def links(part: np.ndarray, key: np.ndarray, fp: np.ndarray, own: np.ndarray) -> pa.RecordBatch:
        new = np.concatenate([[True], (part[1:] != part[:-1]) | (key[1:] != key[:-1])])
        a, b = bucket_links(np.cumsum(new), fp.view(np.uint64), own, radius)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for batch in batches:
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 3, 2)]
            if held is not None:
                cols = [np.concatenate([h, c]) for h, c in zip(held, cols)]
            part, key = cols[0], cols[1]
            other = np.flatnonzero((part != part[-1]) | (key != key[-1]))
            cut = int(other[-1]) + 1 if len(other) else 0
            if cut:
                yield links(*[c[:cut] for c in cols])
            held = [c[cut:] for c in cols]
        if held is not None and len(held[0]):
            yield links(*held)
    return rows


def find_links(nodes: DataFrame, radius: int, parts: int) -> DataFrame:
    """Links (a, b) between fingerprints: enough to join all that are within the radius, possibly over others."""
    n, both = bit_statistics(nodes)
    if n < 2:
        return nodes.select(F.col("fp").alias("a"), F.col("fp").alias("b")).where("false")
    plan = plan_parts(n, both, radius)
    probes = nodes.select("fp").mapInArrow(_probes(plan), PROBE)
    crowded = stored(probes.groupBy("part", "key").count().where(F.col("count") > BUCKET).select("part", "key"), "crowded")
    light = probes.join(crowded.df, ["part", "key"], "left_anti").select("part", "key", "own", "fp")
    heavy = probes.join(crowded.df, ["part", "key"], "left_semi").select("part", "key", "own", "fp").mapInArrow(_dealt_again(plan, radius), PROBE)
    both_kinds = light.unionByName(heavy) if crowded.df.head(1) else probes
    return both_kinds.repartition(parts, "part", "key").sortWithinPartitions("part", "key").mapInArrow(_linked(radius), "a long, b long")


# -- components -----------------------------------------------------------------------------------------------------

def flat(hooks: Stored) -> Stored:
    """Pointers (fp, root) to lesser fingerprints, led to their ends by doubling."""
    while True:
        up = hooks.df.select(F.col("fp").alias("root"), F.col("root").alias("up"))
        after = stored(hooks.df.join(up, "root", "left").select("fp", F.coalesce("up", "root").alias("root"), F.col("up").isNotNull().alias("moved")), "flat")
        hooks.drop()
        hooks = after
        if not after.df.where("moved").head(1):
            return after


def components(links: DataFrame) -> Stored:
    """(fp, root) for every fingerprint that has a link; root: the least fingerprint of its component.

    Each round hooks every node to its least lesser neighbour, leads these pointers to their ends, and carries the
    links over to the ends.  Of the ends next to one hooked node only the least can outlive the next round, so two rounds
    leave half the nodes at most; links only become fewer, and no join makes more rows than there are links or nodes.
    """
    edges = stored(one_way(links), "links")
    nodes = edges.df.select(F.col("a").alias("fp")).unionByName(edges.df.select(F.col("b").alias("fp"))).distinct()
    state = stored(nodes.withColumn("root", F.col("fp")), "roots")
    while edges.df.head(1):
        hooks = flat(stored(edges.df.groupBy(F.col("b").alias("fp")).agg(F.min("a").alias("root")), "hooks"))
        ends = [hooks.df.select(F.col("fp").alias(c), F.col("root").alias(f"{c}_end")) for c in ("root", "a", "b")]
        after = stored(state.df.join(ends[0], "root", "left").select("fp", F.coalesce("root_end", "root").alias("root")), "roots")
        left = edges.df.join(ends[1], "a", "left").join(ends[2], "b", "left").select(F.coalesce("a_end", "a").alias("a"), F.coalesce("b_end", "b").alias("b"))
        kept = stored(one_way(left), "links")
        for table in (state, edges, hooks):
            table.drop()
        state, edges = after, kept
    edges.drop()
    return state


def jaccard(a: str | None, b: str | None, n: int) -> float:
    """Of the sets of n-word shingles (fewer words: the whole sequence)."""
    sets = []
    for text in (a, b):
        words = (text or "").encode("utf-8").translate(LOWER).split()
        sets.append({tuple(words[i:i + n]) for i in range(max(1, len(words) - n + 1))})
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def _alike(n: int, least: float):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [jaccard(x, y, n) >= least for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))
    return rows


def mark_of(text_col: str) -> Column:
    """Tells rows apart that have one id and different texts."""
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def first_texts(nodes: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(fp, text) of each node: the text of its first document."""
    firsts = nodes.select("fp", F.col("first_doc").alias("_sh_id"), F.col("first_mark").alias("_sh_mark"))
    own = docs.select(F.col(id_col).cast("long").alias("_sh_id"), mark_of(text_col).alias("_sh_mark"), F.col(text_col).alias("text"))
    return own.join(firsts, ["_sh_id", "_sh_mark"]).groupBy("fp").agg(F.min("text").alias("text"))


def verified(links: Stored, nodes: DataFrame, docs: DataFrame, id_col: str, text_col: str, n: int, least: float) -> DataFrame:
    """Links whose first documents share enough n-word shingles; only texts at an end of a link are moved."""
    ends = links.df.select(F.col("a").alias("fp")).unionByName(links.df.select(F.col("b").alias("fp"))).distinct()
    texts = stored(first_texts(nodes.join(ends, "fp"), docs, id_col, text_col), "texts")
    pairs = (links.df.join(texts.df.select(F.col("fp").alias("a"), F.col("text").alias("ta")), "a")
             .join(texts.df.select(F.col("fp").alias("b"), F.col("text").alias("tb")), "b"))
    out = stored(pairs.select("a", "b", "ta", "tb").mapInArrow(_alike(n, least), "a long, b long"), "verified")
    texts.drop()
    return out.df


def named(nodes: DataFrame, roots: Stored) -> Stored:
    """(fp, component_id): the least document of a node's component."""
    rooted = nodes.join(roots.df.select("fp", "root"), "fp", "left").select("fp", "first_doc", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first_doc").alias("component_id"))
    return stored(rooted.join(least, "root").select("fp", "component_id"), "named")


def near_duplicates(docs: DataFrame, radius: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, fp (as a signed long), component_id."""
    spark = docs.sparkSession
    prints = stored(fingerprints(docs, id_col, text_col), "prints")
    nodes = stored(prints.df.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("first_doc")), "nodes")
    roots = components(find_links(nodes.df, radius, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    names = named(nodes.df, roots)
    roots.drop()
    nodes.drop()
    return prints.df.join(names.df, "fp", "left").select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


#: Bands of the sketch and least shingles in each: a pair with a similarity of 0.8 shares a band with a chance of 1 - 6e-5.
BANDS, ROWS = 32, 6
#: Bands whose crowded buckets are first tied to one node; nodes on each side of a block of a crowded bucket.
STARS = 4
BLOCK = 256
XORS, FACTORS = (np.random.Generator(np.random.PCG64(seed)).integers(0, 1 << 64, BANDS * ROWS, dtype=np.uint64) | np.uint64(1) for seed in (11, 12))


def shingle_sets(texts: list[str | None], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of the n-word shingles (fewer words: the whole sequence) of one text after the other, and where each text's begin."""
    w = words_of([(t or "").encode("utf-8").translate(LOWER) for t in texts])
    count = np.diff(w.text)
    long = np.flatnonzero(last_start(w.text, n, len(w.hash))[:max(0, len(w.hash) - n + 1)])
    short = np.flatnonzero(count < n)
    whole = [int(windows(w.hash[w.text[i]:w.text[i + 1]], int(count[i]))[0]) if count[i] else 0 for i in short]
    value = np.concatenate([windows(w.hash, n)[long], np.array(whole, dtype=np.uint64)])
    owner = np.concatenate([np.searchsorted(w.text, long, side="right") - 1, short])
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    new = np.concatenate([[True], (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])])[:len(value)]
    return value[new], np.searchsorted(owner[new], np.arange(len(texts)))


def band_keys(value: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Row of a text: its bucket in each band; the low bits name the band."""
    out = np.empty((len(first), BANDS), dtype=np.uint64)
    for band in range(BANDS):
        key = np.zeros(len(first), dtype=np.uint64)
        for k in range(band * ROWS, (band + 1) * ROWS):
            key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat((value ^ XORS[k]) * FACTORS[k], first))
        out[:, band] = (key & ~np.uint64(BANDS - 1)) | np.uint64(band)
    return out


def _sketches(n: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            texts = batch.column(1).to_pylist()
            words = [b" ".join((t or "").encode("utf-8").translate(LOWER).split()) for t in texts]
            for lo, hi in chunks(words):
                fp = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words[lo:hi]), dtype=np.uint64, count=hi - lo)
                sim = np.fromiter((fingerprint(t) for t in texts[lo:hi]), dtype=np.uint64, count=hi - lo)
                value, first = shingle_sets(texts[lo:hi], n)
                size = np.diff(np.append(first, len(value)))
                keys = pa.FixedSizeListArray.from_arrays(pa.array(band_keys(value, first).view(np.int64).ravel()), BANDS).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], batch.column(2)[lo:hi], pa.array(fp.view(np.int64)), pa.array(sim.view(np.int64)),
                                                  pa.array(size.astype(np.int64)), keys], names=["doc_id", "mark", "fp", "sim", "size", "keys"])
    return rows


def _bucket_pairs(least: float, first: bool):
    """Reads (key, fp, size, root) sorted by key.  First: of the first bands, each node of a bucket with the bucket's first
    one.  Then: all pairs of a bucket of up to PAIRED nodes that have different roots and that their sizes allow."""
    def pairs(key: np.ndarray, fp: np.ndarray, size: np.ndarray, root: np.ndarray) -> pa.RecordBatch:
        edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
        n = np.diff(edge)
        if first:
            head = np.repeat(edge[:-1], n)
            i = np.flatnonzero((head != np.arange(len(key))) & ((key & (BANDS - 1)) < STARS))
            return pa.RecordBatch.from_arrays([pa.array(fp[head[i]]), pa.array(fp[i])], names=["a", "b"])
        mine = np.repeat(n, n)
        a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for step in range(1, min(PAIRED, int(n.max(initial=0)))):
            i = np.flatnonzero((key[step:] == key[:-step]) & (mine[step:] <= PAIRED) & (root[step:] != root[:-step]))
            i = i[np.minimum(size[i], size[i + step]) >= least * np.maximum(size[i], size[i + step]) - 1e-6]
            a.append(fp[i])
            b.append(fp[i + step])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            cols = [batch.column(i).to_numpy() for i in range(4)]
            if held is not None:
                cols = [np.concatenate([h, c]) for h, c in zip(held, cols)]
            cut = int(np.searchsorted(cols[0], cols[0][-1])) if len(cols[0]) else 0
            if cut:
                yield pairs(*[c[:cut] for c in cols])
            held = [c[cut:] for c in cols]
        if held is not None and len(held[0]):
            yield pairs(*held)
    return rows


def one_way(links: DataFrame) -> DataFrame:
    """Each link once, from the lesser to the greater end."""
    return links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _gram_rows(n: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            value, first = shingle_sets(texts, n)
            ends = np.append(first[1:], len(value))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([value[a:b].tobytes() for a, b in zip(first, ends)], pa.binary())], names=["fp", "grams"])
    return rows


def block_links(left: list[tuple], right: list[tuple], least: float) -> list[tuple[int, int]]:
    """Of (fp, root, grams) on two sides: verified links between different roots, enough to join all that any of them joins."""
    sets = [np.frombuffer(x[2], np.uint64) for x in (*left, *right)]
    size = np.array([len(x) for x in sets])
    k = len(left)
    if not k or k == len(sets):
        return []
    own = np.repeat(np.arange(len(sets)), size)
    value, at = np.unique(np.concatenate(sets), return_inverse=True)
    both = np.zeros((k, len(right)))
    for lo in range(0, len(value), 8192):
        here = np.flatnonzero((at >= lo) & (at < lo + 8192))
        ones = np.zeros((len(sets), min(8192, len(value) - lo)), dtype=np.float32)
        ones[own[here], at[here] - lo] = 1
        both += ones[:k] @ ones[k:].T
    alike = both / (size[:k, None] + size[None, k:] - both) >= least
    label = np.unique([x[1] for x in (*left, *right)], return_inverse=True)[1]
    out = []
    for i in range(k):
        near = np.flatnonzero(alike[i]) + k
        while len(near := near[label[near] != label[i]]):
            out.append((left[i][0], right[near[0] - k][0]))
            label[label == label[near[0]]] = label[i]
    return out


def _blocks(least: float):
    """Reads rows sorted by block; holds one block."""
    def links(rows: list[tuple]) -> pa.RecordBatch:
        got = block_links([r[1:] for r in rows if r[0]], [r[1:] for r in rows if not r[0]], least)
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in got], pa.int64()) for i in (0, 1)], names=["a", "b"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, name = [], None
        for batch in batches:
            for *at, is_left, fp, root, grams in zip(*(c.to_pylist() for c in batch.columns)):
                if at != name and held:
                    yield links(held)
                    held = []
                name = at
                held.append((is_left, fp, root, grams))
        if held:
            yield links(held)
    return rows


def crowded_links(nodes: DataFrame, roots: DataFrame, docs: DataFrame, id_col: str, text_col: str, n: int, least: float, parts: int) -> DataFrame | None:
    """Verified links that join components inside buckets of over PAIRED nodes; every pair of different components is compared.

    The nodes outside a bucket's largest component are dealt to blocks, all nodes of the bucket to others, and each
    block of the first kind meets each of the second.
    """
    own = nodes.join(roots.select("fp", "root"), "fp", "left").select("fp", "first_doc", "keys", F.coalesce("root", "fp").alias("root"))
    held = own.select(F.explode("keys").alias("key"), "fp", "root")
    mixed_up = stored(held.groupBy("key", "root").count().groupBy("key").agg(F.max_by("root", F.struct("count", "root")).alias("top"), F.max("count").alias("most"),
                      F.count(F.lit(1)).alias("roots"), F.sum("count").alias("n")).where((F.col("n") > PAIRED) & (F.col("roots") > 1)), "mixed")
    if not mixed_up.df.head(1):
        mixed_up.drop()
        return None
    inside = stored(held.join(mixed_up.df, "key"), "inside")
    mixed_up.drop()
    texts = first_texts(inside.df.select("fp").distinct().join(nodes, "fp"), docs, id_col, text_col)
    grams = stored(texts.mapInArrow(_gram_rows(n), "fp long, grams binary"), "grams")
    rights, lefts = (F.ceil(x / F.lit(BLOCK)).cast("int") for x in (F.col("n"), F.col("n") - F.col("most")))
    block = F.xxhash64("fp")
    left = inside.df.where("root <> top").select("key", F.pmod(block, lefts).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), rights - 1)).alias("j"), F.lit(True).alias("is_left"), "fp", "root")
    right = inside.df.select("key", F.explode(F.sequence(F.lit(0), lefts - 1)).alias("i"), F.pmod(block, rights).cast("int").alias("j"), F.lit(False).alias("is_left"), "fp", "root")
    dealt = left.unionByName(right).join(grams.df, "fp").select("key", "i", "j", "is_left", "fp", "root", "grams")
    out = stored(dealt.repartition(parts, "key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(_blocks(least), "a long, b long"), "crossed")
    inside.drop()
    grams.drop()
    return out.df


def print_links(nodes: DataFrame, radius: int, parts: int) -> DataFrame:
    """Candidates by SimHash: each node with the first one of its fingerprint, and such first ones over the links of fingerprints."""
    firsts = stored(nodes.groupBy("sim").agg(F.min("fp").alias("first")), "firsts")
    same = nodes.select("sim", F.col("fp").alias("b")).join(firsts.df, "sim").select(F.col("first").alias("a"), "b")
    ends = [firsts.df.select(F.col("sim").alias(c), F.col("first").alias(f"{c}_first")) for c in ("a", "b")]
    links = find_links(firsts.df.select(F.col("sim").alias("fp")), radius, parts)
    near = links.join(ends[0], "a").join(ends[1], "b").select(F.col("a_first").alias("a"), F.col("b_first").alias("b"))
    return same.unionByName(near)


def _groups(docs: DataFrame, id_col: str, text_col: str, shingle: int, least: float, radius: int = 4) -> DataFrame:
    """(doc_id, mark, component_id, component_mark) of all rows with an id; the last two name the component's first row."""
    spark = docs.sparkSession
    ready(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), mark_of(text_col).alias("mark")).where("doc_id is not null")
    prints = stored(own.mapInArrow(_sketches(shingle), "doc_id long, mark long, fp long, sim long, size long, keys array<long>"), "prints")
    firsts = [F.first(c).alias(c) for c in ("sim", "size", "keys")]
    nodes = stored(prints.df.groupBy("fp").agg(F.min(F.struct("doc_id", "mark")).alias("f"), *firsts)
                   .select("fp", F.col("f.doc_id").alias("first_doc"), F.col("f.mark").alias("first_mark"), "sim", "size", "keys"), "nodes")

    def candidates(roots: DataFrame | None) -> DataFrame:
        """Verified links inside buckets; once there are roots, only between different ones."""
        own = nodes.df.withColumn("root", F.col("fp")) if roots is None else nodes.df.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
        buckets = own.select(F.explode("keys").alias("key"), "fp", "size", "root").repartition(parts, "key").sortWithinPartitions("key", "fp")
        pairs = buckets.mapInArrow(_bucket_pairs(least, roots is None), "a long, b long")
        found = stored(one_way(pairs if roots is not None else pairs.unionByName(print_links(nodes.df, radius, parts))), "found")
        links = verified(found, nodes.df, docs, id_col, text_col, shingle, least)
        found.drop()
        return links

    # links of SimHash and a few ties for each node first; what they have joined need not be compared again
    links = candidates(None)
    roots = components(links)
    rest = candidates(roots.df.select("fp", "root"))
    if rest.head(1):
        links = links.unionByName(rest)
        roots.drop()
        roots = components(links)
    more = crowded_links(nodes.df, roots.df, docs, id_col, text_col, shingle, least, parts)
    if more is not None:
        roots.drop()
        roots = components(links.unionByName(more))
    rooted = nodes.df.join(roots.df.select("fp", "root"), "fp", "left").select("fp", "first_doc", "first_mark", F.coalesce("root", "fp").alias("root"))
    first = rooted.groupBy("root").agg(F.min(F.struct("first_doc", "first_mark")).alias("c"))
    names = stored(rooted.join(first, "root").select("fp", F.col("c.first_doc").alias("component_id"), F.col("c.first_mark").alias("component_mark")), "named")
    roots.drop()
    nodes.drop()
    return prints.df.select("doc_id", "mark", "fp").join(names.df, "fp").select("doc_id", "mark", "component_id", "component_mark")


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, least: float = 0.8) -> DataFrame:
    """(doc_id, component_id) of all rows with an id, where links are texts with a Jaccard similarity of ``least`` on
    ``shingle``-word shingles.

    Nodes are texts (equal sequences of lower-cased words are one).  Candidates are linked by their SimHash fingerprints
    (``print_links``) or, since these miss pairs near ``least``, share a bucket in one of BANDS bands of least shingles.  In the first bands the nodes of a bucket are tied to its first one; then all pairs of small buckets
    that verified ties have not joined are verified, and what is left in several components in large ones is compared
    pair by pair (``crowded_links``).  Rows that repeat an id
    with different texts are nodes of their own.
    """
    return _groups(docs, id_col, text_col, shingle, least).select("doc_id", "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, least: float = 0.8) -> DataFrame:
    """``docs`` with the first row of each group of near-duplicates (``similar_groups``), in the given columns.

    First is the smallest id, then the smallest hash of the text; of rows that repeat both one stays, the first by its
    columns as JSON.  Rows with one id and unlike texts are in different groups and all stay; so do rows with a null id.
    """
    found = _groups(docs, id_col, text_col, shingle, least).where("doc_id = component_id and mark = component_mark")
    stay = stored(found.groupBy(F.col("doc_id").alias("_sh_id"), F.col("mark").alias("_sh_mark")).agg(F.count(F.lit(1)).alias("_sh_n")), "stay")
    own = docs.withColumns({"_sh_id": F.col(id_col).cast("long"), "_sh_mark": mark_of(text_col)})
    key = ["_sh_id", "_sh_mark"]
    rows = own.join(stay.df.where("_sh_n = 1").select(*key), key, "left_semi").unionByName(own.where("_sh_id is null").select(*key, *docs.columns))
    rows = rows.select(*docs.columns)
    if stay.df.where("_sh_n > 1").head(1):
        whole = F.struct(*[f"`{c}`" for c in docs.columns])
        again = own.join(stay.df.where("_sh_n > 1").select(*key), key, "left_semi")
        rows = rows.unionByName(again.groupBy(*key).agg(F.min_by(whole, F.to_json(whole)).alias("_sh_row")).select("_sh_row.*"))
    return rows


def as_hex(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def op6(documents: DataFrame) -> DataFrame:
    return near_duplicates(documents).select("doc_id", as_hex(F.col("fp")).alias("fingerprint"), "component_id")
