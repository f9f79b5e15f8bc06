"""N-gram Jaccard join: documents whose sets of word 5-grams are similar.

Words are runs of [^\\x20\\x09-\\x0D]+ with A-Z lower-cased; a set holds the distinct 5-word shingles (64-bit
hashes), with fewer words the whole sequence as one.  Two sets link when 5 * |intersection| >= 4 * |union|.

1. Every text's shingles are counted into a sketch of ``BUCKETS`` sums (fixed size, broadcast).  It orders
   all shingles, rare ones first; and texts with one set get one set id (copies are one node from here on).
2. A set sends only the first n - ceil(0.8 n) + 1 shingles of that order: similar sets share one of them.
   Rows are grouped by shingle and streamed in order of size.  Pairs must pass the length filter and the
   positional filter.  A group of at most ``SMALL`` sets gives all its pairs; a larger one gives a star around
   its first set, so that the many members of a group of near copies are not paired with each other.  Shingles
   that the sketch shows to be frequent are salted over several tasks.
3. Pairs are verified once each: the bits in which two parity signatures differ bound the difference of the sets from
   below.  First signatures of ``PARITY`` bits are compared, then longer ones, ``SPREAD`` bits a shingle and more
   (short ones say nothing of large sets); what is left is decided by the exact intersection of the two sets.
4. Links give components.  In groups that were too large or salted, ``STARS`` more rounds pair each set with
   ``HEADS`` heads of other components, which leaves few components in a group of near copies.  The pairs then left
   are those between different components; all of them pass the same filters and are verified, and complete
   the components: no pair of linked texts is lost, and pairs that a component already connects need no look.
   In a group of more than ``DENSE`` sets the join itself compares the signatures: only pairs that may link are rows.

Defined results: a null or empty text has no shingles and links with nothing; repeated rows and texts with
one set are linked; a null doc_id is the largest id (a component of such rows alone has a null id); texts are
read whole; an empty table gives an empty result; extra columns are ignored."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from profitlens.llm.common import NULL_ID, chunks, components, keyed, maybe_in, mix, signed, small, stored, word_hashes, words

WORDS = 5
#: Sums of the frequency sketch.
BUCKETS = 1 << 20
#: Sets of a shingle's group that are paired at once.
SMALL = 8
#: Members beyond twice the mean bucket for which a frequent shingle gets one more salt.
SALT_ROWS = 4096
#: Sets of a group beyond which its pairs between components are compared by their signatures at once.
DENSE = 64
#: Rounds of stars before all pairs between components, and the heads that a shingle has in a round.
STARS = 2
HEADS = 3
#: Bits of the parity signature that each set has, in longs of 64; candidates get longer ones, with bits for
#: ``SPREAD`` times their shingles.
PARITY = 1024
SPREAD = 4
_BLOCK = 4096
_SHIFT = np.uint64(64 - 20)


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    mult = np.array([pow(0x2545F4914F6CDD1D, j, 1 << 64) for j in range(WORDS)], dtype=np.uint64)
    for _, _, data, off in chunks(texts):
        low, start, end, first = words(data, off)
        w = word_hashes(low, start, end)
        with np.errstate(over="ignore"):
            n = max(0, len(w) - WORDS + 1)
            s = np.zeros(n, dtype=np.uint64)
            for j in range(WORDS):
                s += w[j: j + n] * mult[j]
            s = mix(s)
            for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                if b - a >= WORDS:
                    yield np.unique(s[a: b - WORDS + 1])
                elif b > a:
                    yield mix(np.array([(w[a:b] * mult[: b - a]).sum() + np.uint64(b - a)], dtype=np.uint64))
                else:
                    yield s[:0]


def set_id(s: np.ndarray) -> np.uint64:
    with np.errstate(over="ignore"):
        return mix(s ^ np.uint64(0xA0761D6478BD642F)).sum(dtype=np.uint64) + np.uint64(len(s))


def prefix_length(n: int) -> int:
    return n - (4 * n + 4) // 5 + 1 if n else 0


def parity(s: np.ndarray, bits: int = PARITY) -> np.ndarray:
    """For each of ``bits`` buckets (a power of 2) whether the set holds an odd number of shingles there, packed.
    The bits in which two sets differ are at most the shingles in which they do."""
    odd = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8))


def apart(x: np.ndarray, y: np.ndarray) -> int:
    """The bits in which two signatures differ, the longer one folded to the length of the other."""
    n = min(len(x), len(y))
    x, y = (np.bitwise_xor.reduce(v.reshape(-1, n), axis=0) for v in (x, y))
    return int(np.bitwise_count(x ^ y).sum())


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each text (n, sid, sig) and, last, the task's sketch in blocks of counts."""
    names = ["doc_id", "dkey", "tkey", "n", "sid", "sig", "block", "counts"]
    sketch = np.zeros(BUCKETS, dtype=np.int32)
    for b in small(batches):
        sizes, ids, sigs = [], [], []
        for s in shingle_sets(b.column("text")):
            np.add.at(sketch, (s >> _SHIFT).astype(np.int64), 1)
            sizes.append(len(s))
            ids.append(set_id(s) if len(s) else None)
            sigs.append(parity(s).view(np.int64))
        n = len(sizes)
        yield pa.RecordBatch.from_arrays(
            [*(b.column(x) for x in names[:3]), pa.array(sizes, pa.int64()),
             pa.array([None if x is None else int(np.uint64(x).view(np.int64)) for x in ids], pa.int64()), pa.array(sigs, pa.list_(pa.int64())),
             pa.nulls(n, pa.int32()), pa.nulls(n, pa.list_(pa.int32()))], names=names)
    rows = [(i, sketch[i * _BLOCK: (i + 1) * _BLOCK]) for i in range(BUCKETS // _BLOCK)]
    rows = [(i, x) for i, x in rows if x.any()]
    m = len(rows)
    none = pa.nulls(m, pa.int64())
    yield pa.RecordBatch.from_arrays([none, none, none, none, none, pa.nulls(m, pa.list_(pa.int64())), pa.array([i for i, _ in rows], pa.int32()),
                                      pa.array([x for _, x in rows], pa.list_(pa.int32()))], names=names)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums of the blocks of counts with one number; all of a number are in one task."""
    sums: dict[int, np.ndarray] = {}
    for b in batches:
        for i, x in zip(b.column("block").to_pylist(), b.column("counts"), strict=True):
            x = x.values.to_numpy().astype(np.int64)
            sums[i] = sums[i] + x if i in sums else x
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(list(sums.values()), pa.list_(pa.int64()))], names=["block", "counts"])


def _prefixes(batches: Iterator[pa.RecordBatch], sketch: np.ndarray) -> Iterator[pa.RecordBatch]:
    extra = np.maximum(sketch - 2 * max(1, int(sketch.mean())), 0) // SALT_ROWS
    for b in small(batches):
        toks, sids, sizes = [], [], []
        for s in shingle_sets(b.column("text")):
            if not len(s):
                continue
            k = prefix_length(len(s))
            toks.append(s[np.lexsort((s, sketch[(s >> _SHIFT).astype(np.int64)]))[:k]])
            sids.append(set_id(s))
            sizes.append(len(s))
        if not toks:
            continue
        k = np.array([len(t) for t in toks])
        tok, sid = np.concatenate(toks), np.repeat(np.array(sids, dtype=np.uint64), k)
        pos = np.arange(len(tok)) - np.repeat(np.cumsum(k) - k, k)
        salts = extra[(tok >> _SHIFT).astype(np.int64)]
        salt = np.where(salts > 0, (mix(sid) % (salts + 1).astype(np.uint64)).astype(np.int64), -1)
        for lo in range(0, len(tok), 200_000):
            cut = slice(lo, lo + 200_000)
            yield pa.RecordBatch.from_arrays(
                [pa.array(signed(tok[cut])), pa.array(salt[cut].astype(np.int32)), pa.array(signed(sid[cut])),
                 pa.array(np.repeat(np.array(sizes), k)[cut].astype(np.int32)), pa.array(pos[cut].astype(np.int32))],
                names=["tok", "salt", "sid", "size", "pos"])


def _can_link(na, pa_, nb, pb):
    """Length and positional filters for set sizes na <= nb and the places of a shared shingle."""
    least = (4 * (na + nb) + 8) // 9  # the least intersection at Jaccard 4 / 5
    return (5 * na >= 4 * nb) & (1 + np.minimum(na - pa_ - 1, nb - pb - 1) >= least)


_CANDIDATES = "a long, b long, tok long, size int, pos int"


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (tok, salt, size, sid): pairs (a, b) of the groups, and the rows (a = sid, tok set) of
    groups that are too large or salted.  A group is streamed: state is its last SMALL rows and its head."""
    tail = [np.zeros(0, t) for t in (np.int64, np.int32, np.int64, np.int32, np.int32)]
    rank0 = 0  # members of the tail's last group that came before the tail
    head = None  # first row of that group
    for b in batches:
        cols = [np.concatenate([t, b.column(i).to_numpy()]) for i, t in enumerate(tail)]
        old = len(tail[0])
        tok, salt, sid, size, pos = cols
        n = len(tok)
        if not n:
            continue
        again = np.zeros(n, dtype=bool)
        again[1:] = (tok[1:] == tok[:-1]) & (salt[1:] == salt[:-1]) & (sid[1:] == sid[:-1])
        again[:old] = False
        if again.any():  # copies of a set
            cols = [c[~again] for c in cols]
            tok, salt, sid, size, pos = cols
            n = len(tok)
        new = np.ones(n, dtype=bool)
        new[1:] = (tok[1:] != tok[:-1]) | (salt[1:] != salt[:-1])
        start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        rank = np.arange(n) - start
        if old:
            rank[start == 0] += rank0
        fresh = np.arange(n) >= old
        out_a, out_b = [], []
        for gap in range(1, SMALL):  # pairs within the first SMALL of a group
            i = np.flatnonzero(fresh & (rank >= gap) & (rank < SMALL))
            j = i - gap
            good = _can_link(size[j].astype(np.int64), pos[j], size[i].astype(np.int64), pos[i]) & (sid[i] != sid[j])
            out_a.append(sid[j[good]])
            out_b.append(sid[i[good]])
        big = np.flatnonzero(fresh & (rank >= SMALL))
        if len(big):  # the star: the group's first row
            inside = rank[big] == big - start[big]
            first = np.where(inside, start[big], 0)
            c = [np.where(inside, col[first], h) for col, h in zip((sid, size, pos), head or (0, 0, 0), strict=True)]
            good = _can_link(c[1].astype(np.int64), c[2], size[big].astype(np.int64), pos[big])
            out_a.append(c[0][good])
            out_b.append(sid[big[good]])
        a, z = np.concatenate(out_a), np.concatenate(out_b)
        if len(a):
            both = np.unique(np.stack([np.minimum(a, z), np.maximum(a, z)], axis=1), axis=0)
            m = len(both)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy()), pa.nulls(m, pa.int64()),
                                              pa.nulls(m, pa.int32()), pa.nulls(m, pa.int32())], names=["a", "b", "tok", "size", "pos"])
        # rows of large or salted groups; the first SMALL rows of a group follow when it proves large
        keep = fresh & ((rank >= SMALL) | (salt >= 0))
        for r in np.flatnonzero(fresh & (rank == SMALL) & (salt < 0)):
            keep[max(0, r - SMALL): r] = True
        k = np.flatnonzero(keep)
        if len(k):
            yield pa.RecordBatch.from_arrays([pa.array(sid[k]), pa.nulls(len(k), pa.int64()), pa.array(tok[k]), pa.array(size[k]), pa.array(pos[k])],
                                             names=["a", "b", "tok", "size", "pos"])
        if rank[-1] == n - 1 - start[-1]:
            head = tuple(col[start[-1]] for col in (sid, size, pos))
        held = min(n, SMALL)
        tail = [c[n - held:] for c in cols]
        lead = np.flatnonzero((tail[0] == tok[-1]) & (tail[1] == salt[-1]))[0]
        tail = [t[lead:] for t in tail]
        rank0 = int(rank[n - held + lead])


#: A pair, with the sizes of its sets and one text of each (dkey, tkey).
_PAIR = ["a", "b", "n_a", "n_b", "d_a", "t_a", "d_b", "t_b"]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs whose long signatures differ in no more than sets may at Jaccard 4 / 5."""
    for b in small(batches):
        good = []
        na, nb = (b.column(c).to_pylist() for c in ("n_a", "n_b"))
        for n, x, y in zip(map(sum, zip(na, nb, strict=True)), b.column("sig_a"), b.column("sig_b"), strict=True):
            x, y = (np.frombuffer(v.as_buffer(), dtype=np.uint8) for v in (x, y))
            good.append(apart(x, y) <= n - 2 * ((4 * n + 8) // 9))
        yield b.select(_PAIR).filter(pa.array(good, pa.bool_()))


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in small(batches):
        good = []
        for x, y in zip(b.column("shingles_a"), b.column("shingles_b"), strict=True):
            x, y = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (x, y))
            both = np.concatenate([x, y])
            both.sort(kind="stable")  # two sorted runs
            common = int((both[1:] == both[:-1]).sum())
            good.append(5 * common >= 4 * (len(x) + len(y) - common))
        yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(good, pa.bool_())], names=["a", "b", "linked"])


def _set_rows(batches: Iterator[pa.RecordBatch], name: str, packed) -> Iterator[pa.RecordBatch]:
    """(sid, dkey, tkey, ``packed`` of the set) of texts that have shingles; a row that a task meets again is left out."""
    seen: set[tuple[int, int]] = set()
    for b in small(batches):
        out = []
        for d, t, s in zip(b.column("dkey").to_pylist(), b.column("tkey").to_pylist(), shingle_sets(b.column("text")), strict=True):
            if len(s) and (d, t) not in seen:
                seen.add((d, t))
                out.append((int(set_id(s).view(np.int64)), d, t, packed(s)))
        columns = list(zip(*out, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [*[pa.int64()] * 3, pa.binary()], strict=True)], names=["sid", "dkey", "tkey", name])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _set_rows(batches, "shingles", np.ndarray.tobytes)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _set_rows(batches, "sig", lambda s: parity(s, max(PARITY, 1 << (SPREAD * len(s) - 1).bit_length())).tobytes())


def _texts(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """One text of each set of the pairs, and a few others: a bitmap finds them."""
    need = pairs.select(F.explode(F.expr("array(struct(d_a dkey, t_a tkey), struct(d_b dkey, t_b tkey))")).alias("x")).select("x.*")
    return maybe_in(docs, need, "dkey", "tkey").select("dkey", "tkey", "text")


def _at(sets: DataFrame, pairs: DataFrame, c: str, name: str) -> DataFrame:
    """What ``sets`` has in ``name``, as ``name``_``c``, by the columns of side ``c`` of the pairs: by the set's id and, if it has
    them, the keys of its text, as copies of that text may have come too.  Only sets that a bitmap of the pairs may hold move."""
    keys = {k: v for k, v in (("sid", c), ("dkey", f"d_{c}"), ("tkey", f"t_{c}")) if k in sets.columns}
    need = pairs.select(*(F.col(v).alias(k) for k, v in keys.items()))
    return maybe_in(sets, need, *keys).withColumnsRenamed(keys | {name: f"{name}_{c}"}).select(*keys.values(), f"{name}_{c}")


def _with(pairs: DataFrame, sets: DataFrame, name: str) -> DataFrame:
    """The pairs with what ``sets`` has of either side."""
    a, b = (_at(sets, pairs, c, name) for c in "ab")
    return pairs.join(a, a.columns[:-1]).join(b, b.columns[:-1])


#: Of the sets a and b (sizes na, nb; signatures ga, gb): the bits that differ are at most what may differ at Jaccard 4 / 5.
_ALIKE = " + ".join(f"bit_count(ga[{i}] ^ gb[{i}])" for i in range(PARITY // 64)) + " <= na + nb - 2 * ((4 * (na + nb) + 8) div 9)"


def _plausible(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose signatures are close enough, as ``_PAIR``."""
    info = nodes.select("sid", "n", "sig", "dkey", "tkey")
    both = pairs.join(info.toDF("a", "na", "ga", "d_a", "t_a"), "a").join(info.toDF("b", "nb", "gb", "d_b", "t_b"), "b")
    return stored(both.where(_ALIKE).withColumnsRenamed({"na": "n_a", "nb": "n_b"}).select(_PAIR), "candidate-pairs")


def _close(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs that the long signatures leave, so that few sets move in vain: large sets differ in most of the
    short signatures' bits, linked or not.  If one set is small, the long signatures say what the short ones did."""
    large = F.least("n_a", "n_b") * SPREAD > PARITY
    far = pairs.where(large)
    sigs = stored(_texts(far, docs).mapInArrow(_signatures, "sid long, dkey long, tkey long, sig binary"), "candidate-signatures")
    close = _with(far, sigs, "sig").mapInArrow(_compare, ", ".join(f"{c} long" for c in _PAIR))
    return pairs.where(~large).unionByName(stored(close, "close-pairs"))


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, linked) of the pairs, by the exact intersections."""
    joined = _with(pairs, sets, "shingles").select("a", "b", "shingles_a", "shingles_b")
    return stored(joined.mapInArrow(_verify, "a long, b long, linked boolean"), "verified-pairs")


def _checked(pairs: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """(a, b, linked) of those of the pairs (a, b) that may link by their signatures.  Only their sets are computed
    anew, from one text of each: the sets of all members of large groups would be most of the corpus."""
    pairs = _close(_plausible(pairs, nodes), docs)
    return _verified(pairs, stored(_texts(pairs, docs).mapInArrow(_sets, "sid long, dkey long, tkey long, shingles binary"), "candidate-sets"))


def _links(pairs: DataFrame) -> DataFrame:
    return pairs.where("linked").select("a", "b")


_FILTER = "5 * least(na, nb) >= 4 * greatest(na, nb) and 1 + least(na - ia - 1, nb - ib - 1) >= floor((4 * (na + nb) + 8) / 9)"


def _groups(large: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows (tok, sid, size, pos, root) of the shingles whose sets are not all of one component yet."""
    rows = large.select("tok", "sid", "size", "pos").join(groups, F.col("sid") == F.col("node"), "left")
    rows = stored(rows.select("tok", "sid", "size", "pos", F.coalesce("root", "sid").alias("root")), "large-groups")
    mixed = rows.groupBy("tok").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("tok")
    return stored(rows.join(mixed, "tok", "left_semi"), "mixed-groups")


def _star(mixed: DataFrame, k: int) -> DataFrame:
    """Pairs of each row with its shingle's heads, if their components differ.  The heads have the least hashes
    of set id and round, so that the shingles of similar sets mostly agree on them."""
    heads = [F.min(F.struct(F.xxhash64("sid", F.lit(k * HEADS + j)).alias("o"), "sid", "size", "pos", "root")) for j in range(HEADS)]
    heads = mixed.groupBy("tok").agg(F.array(*heads).alias("h")).select("tok", F.explode(F.array_distinct("h")).alias("h"))
    heads = heads.selectExpr("tok", "h.sid b", "h.size nb", "h.pos ib", "h.root rb")
    rows = mixed.toDF("tok", "a", "na", "ia", "ra").join(heads, "tok").where("ra <> rb and " + _FILTER)
    return rows.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _across(mixed: DataFrame, nodes: DataFrame) -> DataFrame:
    """All pairs of sets of different components that share a shingle and pass the filters.  In the groups of more
    than ``DENSE`` sets the join itself compares the signatures, so that its rows are pairs that may link.  It still
    compares all sets of a group with each other, dealt over as many keys as the group has times ``SALT_ROWS`` sets."""
    dense = mixed.groupBy("tok").agg(F.count("*").alias("many")).where(F.col("many") > DENSE)
    few = mixed.join(dense, "tok", "left_anti")
    x, y = few.toDF("tok", "a", "na", "ia", "ra"), few.toDF("tok", "b", "nb", "ib", "rb")
    pairs = x.join(y, "tok").where("a < b and ra <> rb and " + _FILTER).select("a", "b")
    rows = mixed.join(dense, "tok").withColumn("salts", F.expr(f"1 + (many - 1) div {SALT_ROWS}")).drop("many")
    rows = stored(rows.join(nodes.select("sid", F.col("sig").alias("g")), "sid").select("tok", "sid", "size", "pos", "root", "g", "salts"), "dense-groups")
    x = rows.withColumn("salts", F.expr("pmod(xxhash64(sid), salts)")).toDF("tok", "a", "na", "ia", "ra", "ga", "salt")
    y = rows.withColumn("salts", F.explode(F.expr("sequence(0L, salts - 1)"))).toDF("tok", "b", "nb", "ib", "rb", "gb", "salt")
    more = x.join(y, ["tok", "salt"]).where("a < b and ra <> rb and " + _FILTER + " and " + _ALIKE).select("a", "b")
    return pairs.unionByName(more).distinct()


def _joined(groups: DataFrame, links: DataFrame) -> DataFrame:
    """The components (node, root) after further links: only the links between roots are resolved anew."""
    ends = links.join(groups.toDF("a", "ra"), "a", "left").join(groups.toDF("b", "rb"), "b", "left")
    up = components(ends.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))).toDF("root", "top")
    known = groups.join(up, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    fresh = up.toDF("node", "root").join(groups.select("node"), "node", "left_anti")
    return stored(known.unionByName(fresh), "components")


def similar(docs: DataFrame) -> DataFrame:
    """doc_id, dkey, tkey, n_shingles, sid (the set's id), root (the component's own key: one of its set ids, null
    without shingles) and component_id (its smallest doc_id, which components of repeated or null ids may share)
    of each row."""
    rows = keyed(docs).select("doc_id", "dkey", "tkey", "text")
    profile = stored(rows.mapInArrow(_profile, "doc_id long, dkey long, tkey long, n long, sid long, sig array<long>, block int, counts array<int>"), "profiles")
    sums = profile.where("block is not null").select("block", "counts").repartition("block").mapInArrow(_summed, "block int, counts array<long>").toArrow()
    sketch = np.zeros(BUCKETS, dtype=np.int64)  # of at most BUCKETS sums
    for i, x in zip(sums.column("block").to_pylist(), sums.column("counts"), strict=True):
        sketch[i * _BLOCK: (i + 1) * _BLOCK] = x.values.to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast(sketch)
    texts = profile.where("block is null").select("doc_id", "dkey", "tkey", "n", "sid", "sig")
    least = F.min(F.struct("dkey", "tkey", "n", "sig")).alias("least")
    nodes = stored(texts.where("sid is not null").groupBy("sid").agg(least).select("sid", "least.*"), "set-nodes")

    prefix = rows.select("text").mapInArrow(lambda it: _prefixes(it, shared.value), "tok long, salt int, sid long, size int, pos int")
    order = ["tok", "salt", "size", "sid"]
    found = stored(prefix.repartition("tok", "salt").sortWithinPartitions(*order).mapInArrow(_pairs, _CANDIDATES), "candidates")
    checked = _checked(found.where("b is not null").select("a", "b").distinct(), nodes, rows)
    groups = stored(components(_links(checked)), "components")

    large = found.where("b is null").select("tok", F.col("a").alias("sid"), "size", "pos").distinct()
    mixed = _groups(large, groups)
    if not mixed.isEmpty():
        # a few rounds of stars, while they link anything, leave few components; then all pairs between those
        for k in range(STARS + 1):
            last = k == STARS
            new = (_across(mixed, nodes) if last else _star(mixed, k)).join(checked.select("a", "b"), ["a", "b"], "left_anti")
            more = _checked(new, nodes, rows)
            checked = checked.unionByName(more)
            if last or not _links(more).isEmpty():
                groups = _joined(groups, _links(more))
                mixed = mixed if last else _groups(mixed, groups)
    of = nodes.select("sid", "dkey").join(groups.withColumnRenamed("node", "sid"), "sid", "left").select("sid", "dkey", F.coalesce("root", "sid").alias("root"))
    least = of.groupBy("root").agg(F.min("dkey").alias("component"))
    of = of.join(least, "root").select("sid", "root", "component")
    out = texts.join(of, "sid", "left").withColumn("component", F.coalesce("component", "dkey"))
    return out.select("doc_id", "dkey", "tkey", F.col("n").alias("n_shingles"), "sid", "root",
                      F.when(F.col("component") < NULL_ID, F.col("component")).alias("component_id"))
