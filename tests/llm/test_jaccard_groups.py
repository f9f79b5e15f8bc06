"""The n-gram Jaccard join against all pairs by brute force, on groups of near copies larger than its blocks."""

import random

import numpy as np
import pyarrow as pa

from profitlens.llm import jaccard_join


def _sets(texts):
    out = []
    for text in texts:
        w = text.split()
        out.append({tuple(w[i: i + 5]) for i in range(max(1, len(w) - 4))})
    return out


def _brute_force(ids, sets):
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            if 100 * len(x & sets[j]) >= 80 * len(x | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, k in enumerate(ids):
        least[find(i)] = min(k, least.get(find(i), k))
    return {k: least[find(i)] for i, k in enumerate(ids)}


def test_large_groups_of_near_copies(spark):
    rng = random.Random(5)
    bases = [[f"w{rng.randrange(4000)}" for _ in range(150)] for _ in range(3)]
    bases.append(bases[0][:75] + bases[1][75:])  # shares many shingles with both, links with neither
    texts = []
    for base in bases:
        for _ in range(70):
            words = list(base)
            for _ in range(rng.randrange(9)):
                words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(words))
    chain = [f"c{i}" for i in range(200)]  # each links with the next ones only
    texts += [" ".join(chain[i * 4: i * 4 + 60]) for i in range(30)]
    texts += texts[:20]
    ids = list(range(1000, 1000 + len(texts)))
    rng.shuffle(ids)
    sets = _sets(texts)
    docs = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.similar(docs).collect()}
    want = _brute_force(ids, sets)
    assert len(set(want.values())) < len(ids) // 2
    assert got == {k: (len(s), want[k]) for k, s in zip(ids, sets, strict=True)}


def test_verification_moves_only_the_sets_of_its_pairs(spark, monkeypatch):
    one, two, far = (np.arange(k, k + 50, dtype=np.uint64) for k in (0, 2, 1000))
    table = [(i, s.tobytes()) for i, s in enumerate([one, two, far, *(far + np.uint64(i * 100) for i in range(300))])]
    sets = spark.createDataFrame(table, "sid long, shingles binary")
    pairs = spark.createDataFrame([(0, 1), (0, 2)], "a long, b long")
    plans, keep = [], jaccard_join.stored
    monkeypatch.setattr(jaccard_join, "stored", lambda df, name: plans.append(df) or keep(df, name))
    got = {(r["a"], r["b"]): r["linked"] for r in jaccard_join._verified(pairs, sets).collect()}
    assert got == {(0, 1): True, (0, 2): False}
    plan = plans[0]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("bit_or") == 2  # a bitmap for each side of the join


def _counted(spark, monkeypatch, name, texts):
    """The rows that step ``name`` of the join gives for the texts, call by call, and the result."""
    seen, keep = [], getattr(jaccard_join, name)

    def run(*args):
        df = keep(*args)
        seen.append(df.count())
        return df

    monkeypatch.setattr(jaccard_join, name, run)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return seen, {r.doc_id: r.component_id for r in jaccard_join.similar(docs).collect()}


def test_pairs_of_a_group_that_cannot_link_are_no_rows(spark, monkeypatch):
    rng = random.Random(3)
    base = [f"w{i}" for i in range(150)]
    texts = []
    for i in range(160):  # three words of its own in each: 15 shingles (16 may differ), and 30 from most others
        words = list(base)
        for j in range(3):
            words[rng.randrange(j * 50 + 4, j * 50 + 46)] = f"x{i}y{j}"
        texts.append(" ".join(words))
    texts += [texts[0] + " end", texts[7] + " end"]
    seen, got = _counted(spark, monkeypatch, "_across", texts)
    assert got == _brute_force(list(range(len(texts))), _sets(texts))
    assert len(set(got.values())) > 100
    assert len(seen) == 1 and seen[0] < 500  # of 13,000 pairs


def test_large_sets_that_differ_are_not_moved(spark, monkeypatch):
    rng = random.Random(4)
    base = [f"w{i}" for i in range(4000)]
    texts = []
    for i in range(5):  # 80 words of its own in each: they link with the base, but not with each other
        words = list(base)
        for at in rng.sample(range(4000), 80):
            words[at] = f"x{i}y{at}"
        texts.append(" ".join(words))
    texts.append(" ".join([*base, "end"]))
    texts.append(" ".join([*base, "end", "more"]))
    moved, keep = [], jaccard_join._verified
    monkeypatch.setattr(jaccard_join, "_verified", lambda pairs, sets: moved.append(pairs.count()) or keep(pairs, sets))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard_join.similar(docs).collect()}
    want = _brute_force(list(range(len(texts))), _sets(texts))
    assert got == want
    links = sum(5 * len(x & y) >= 4 * len(x | y) for i, x in enumerate(_sets(texts)) for y in _sets(texts)[:i])
    assert sum(moved) <= links + 2


def test_signatures_never_differ_in_more_than_the_sets():
    rng = np.random.default_rng(5)
    for n, m in ((10, 30), (200, 3000), (3000, 3100)):
        x = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        y = np.unique(np.concatenate([x[: n // 2], rng.integers(0, 1 << 63, m - n // 2, dtype=np.uint64)]))
        far = len(np.setxor1d(x, y))
        for a, b in ((1024, 1024), (1024, 16384), (16384, 16384)):
            d = jaccard_join.apart(jaccard_join.parity(x, a), jaccard_join.parity(y, b))
            assert 0 < d <= far and (far - d) % 2 == 0


def test_a_group_dealt_over_many_keys_gives_the_same_pairs(spark, monkeypatch):
    rng = np.random.default_rng(6)
    shared = rng.integers(0, 1 << 63, 90, dtype=np.uint64)
    sets = [np.unique(np.concatenate([shared, rng.integers(0, 1 << 63, 2 + i % 20, dtype=np.uint64)])) for i in range(150)]
    nodes = spark.createDataFrame([(i, jaccard_join.parity(s).view(np.int64).tolist()) for i, s in enumerate(sets)], "sid long, sig array<long>")
    mixed = spark.createDataFrame([(7, i, len(s), 0, i // 2) for i, s in enumerate(sets)], "tok long, sid long, size int, pos int, root long")
    want = {tuple(r) for r in jaccard_join._across(mixed, nodes).collect()}
    monkeypatch.setattr(jaccard_join, "SALT_ROWS", 20)
    got = [tuple(r) for r in jaccard_join._across(mixed, nodes).collect()]
    links = {(a, b) for b in range(150) for a in range(b) if a // 2 != b // 2
             and 5 * len(np.intersect1d(sets[a], sets[b])) >= 4 * len(np.union1d(sets[a], sets[b]))}
    assert sorted(got) == sorted(want) and links and links <= want


def test_only_the_sets_of_pairs_that_may_link_are_stored(spark, monkeypatch):
    rng = random.Random(7)
    passage = " ".join(f"p{i}" for i in range(44))  # 40 shingles of 60 texts; 10 more are a text's own, and no two link
    texts = [passage + "".join(f" w{rng.randrange(10**6)}" for _ in range(10)) for _ in range(60)]
    base = [f"v{i}" for i in range(60)]
    texts += [" ".join(base), " ".join([*base, "end"])]
    rows, keep = {}, jaccard_join.stored

    def run(df, name):
        out = keep(df, name)
        rows[name] = rows.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(jaccard_join, "stored", run)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard_join.similar(docs).collect()}
    assert got == _brute_force(list(range(len(texts))), _sets(texts))
    assert rows["mixed-groups"] >= 60
    assert rows["candidate-sets"] < 10


def test_copies_of_a_text_do_not_multiply_its_pairs(spark, monkeypatch):
    base = [f"v{i}" for i in range(60)]
    texts = [" ".join(base)] * 40 + [" ".join([*base, "end"])] * 40
    monkeypatch.setattr(jaccard_join, "maybe_in", lambda rows, keys, *names: rows)  # as full bitmaps: all rows come
    seen, got = _counted(spark, monkeypatch, "_verified", texts)
    assert set(got.values()) == {0}
    assert seen[0] == 1  # one pair of sets, of 1600 pairs of texts


def test_a_repeated_row_is_one_text_of_its_pairs():
    texts = [" ".join(f"v{i}" for i in range(n)) for n in (30, 40)]
    columns = [pa.array([1, 2] * 50), pa.array([3, 4] * 50), pa.array(texts * 50)]
    batch = pa.RecordBatch.from_arrays(columns, names=["dkey", "tkey", "text"])
    for find in (jaccard_join._sets, jaccard_join._signatures):
        got = [r for b in find(iter([batch.slice(0, 60), batch.slice(60)])) for r in b.to_pylist()]
        assert [(r["dkey"], r["tkey"]) for r in got] == [(1, 3), (2, 4)]
