"""Near-duplicate groups by MinHash bands, verified with odd sketches and then on full sets.

1. Each text becomes the set of its 5-word shingles. Texts with equal sets share a node, so exact
   copies cost one row each from here on, however many there are.
2. A node has 128 MinHash samples. 32 bands of 4 make its buckets: a pair with similarity 0.75 misses
   all of them with a probability of 5e-6. The samples are also folded into a parity bitmap of 512
   bits, the odd sketch; the population count of two bitmaps' XOR estimates the similarity.
3. In every bucket each node is a candidate with the bucket's leader, its smallest node. Candidates
   pass if sizes and sketches allow a similarity of 0.5, and become links after a check of their full
   shingle sets. Sets are made of the texts of candidates only, where they are read.
4. Buckets of three and more nodes that these links leave in several components are compared further,
   in blocks of bounded size, first by sketches, then those with a candidate by full sets: a pair is
   looked at in the first of its common buckets only, the most similar by sketch first, and not at all
   once its components have met. Only links come out. So no link that would join components is lost,
   and no group's pairs are listed.
5. Components of the links, by label spreading in written tables.

A key with many rows (a bucket, a leader, a hub) is dealt over tasks by a salt.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import blank_words, components, delete, maybe_wanted, row_key, vectorized, without, written

SHINGLE, SAMPLES, BANDS, BITS = 5, 128, 32, 512
ROWS = SAMPLES // BANDS
NUMERATOR, DENOMINATOR = 75, 100
#: XOR counts up to this one pass: the expected count for a similarity of 0.5. Of pairs at 0.75 less than one in a million
#: has more: that takes 60 of 128 samples that differ, where 32 are expected and the deviation is 4.9.
MOST_XOR = int(BITS / 2 * (1 - np.exp(-2 * (2 * SAMPLES * 0.5) / BITS)))
#: Nodes of a key from which on it is dealt over several tasks.
BLOCK = 400
#: Nodes of a block that meets others, and bytes of their full sets.
ACROSS, ACROSS_BYTES = 2000, 16 << 20
_rng = np.random.default_rng(75)
_MUL = _rng.integers(0, 1 << 63, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, SAMPLES, dtype=np.uint64)
_STEP = _rng.integers(0, 1 << 63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None, n: int = SHINGLE) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct ``n``-word shingles; fewer words are one shingle, no words none."""
    import xxhash

    words = blank_words(text)
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = min(n, len(words))
    count = len(words) - n + 1
    out = np.full(count, n, np.uint64)
    for k in range(n):
        out = (out ^ (out >> np.uint64(29))) * _STEP[k] + h[k : k + count]
    out = (out ^ (out >> np.uint64(31))) * _STEP[8]
    return np.unique(out ^ (out >> np.uint64(30)))


def set_key(found: np.ndarray) -> bytes:
    return hashlib.blake2b(found.tobytes(), digest_size=16).digest()


def samples_of(found: np.ndarray, chunk: int = 2048) -> np.ndarray:
    least = np.full(SAMPLES, np.iinfo(np.uint64).max, np.uint64)
    for s in range(0, len(found), chunk):
        h = found[s : s + chunk, None] * _MUL
        h += _ADD
        np.minimum(least, h.min(0), out=least)
    return least >> np.uint64(32)


def bands_of(samples: np.ndarray) -> np.ndarray:
    rows = samples.reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * _STEP[9]
    for k in range(ROWS):
        key = (key ^ (key >> np.uint64(32))) * _STEP[10] + rows[:, k] * _STEP[11]
    return (key ^ (key >> np.uint64(29))).view(np.int64)


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """Eight 64-bit words of parities: each sample, with its number, flips one of 512 bits."""
    slot = ((samples + np.arange(1, SAMPLES + 1, dtype=np.uint64) * _STEP[12]) ^ (samples << np.uint64(17))) * _STEP[13] >> np.uint64(55)
    return np.packbits((np.bincount(slot.astype(np.int64), minlength=BITS) & 1).astype(np.uint8)).view(np.int64)


def similarity_by_sketch(xor: np.ndarray) -> np.ndarray:
    """The similarity that a population count of the XOR of two odd sketches stands for."""
    part = np.clip(1 - 2 * np.asarray(xor, float) / BITS, 1e-9, 1)
    return 1 + BITS / 2 * np.log(part) / (2 * SAMPLES)


@vectorized("n_shingles long, node binary, bands array<long>, sketch array<long>")
def _signature(texts: pd.Series) -> pd.DataFrame:
    rows = []
    for text in texts:
        found = shingles(text)
        if len(found):
            samples = samples_of(found)
            rows.append((len(found), set_key(found), bands_of(samples), odd_sketch(samples)))
        else:
            rows.append((0, None, None, None))
    return pd.DataFrame(rows, columns=["n_shingles", "node", "bands", "sketch"])


@vectorized("node binary, shingles binary")
def _full_set(texts: pd.Series) -> pd.DataFrame:
    found = [shingles(t) for t in texts]
    return pd.DataFrame({"node": [set_key(x) for x in found], "shingles": [x.tobytes() for x in found]})


def linked_sets(a: bytes, b: bytes) -> bool:
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return DENOMINATOR * both >= NUMERATOR * (len(x) + len(y) - both)


def _sizes_allow(a: str, b: str) -> Column:
    return DENOMINATOR * F.least(a, b) >= NUMERATOR * F.greatest(a, b)


def _xor_count(a: str, b: str) -> Column:
    return sum((F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in range(BITS // 64)), F.lit(0))


def _full_sets(wanted: DataFrame, nodes: DataFrame, docs: DataFrame, repeated: bool) -> DataFrame:
    """(node, shingles), a written table with all wanted nodes (and a few others), from the whole text of one row each.

    The rows are found by a bitmap of their keys, so texts are read once more but never shuffled. Sets are shuffled
    only to become one a node where rows of ``docs`` are ``repeated``.
    """
    wanted = written(wanted.select("node"), "wanted")
    rows = written(_of(nodes.select("node", "rep"), wanted).join(wanted, "node", "left_semi").select(F.col("rep").alias("key")), "wanted")
    texts = maybe_wanted(docs.select("text", row_key(docs).alias("row_key")), F.col("row_key"), rows, "hit").where("hit")
    found = texts.select(_full_set("text").alias("y")).select("y.*")
    out = written(found.groupBy("node").agg(F.first("shingles").alias("shingles")) if repeated else found, "sets")
    delete(rows)
    return out


def _salts(m: Column) -> Column:
    """Over how many tasks the ``m`` rows of a key are dealt."""
    return F.ceil(m / BLOCK).cast("int")


def _salt(node: str, m: Column) -> Column:
    return F.pmod(F.xxhash64(node), _salts(m)).cast("int")


def _with_leader(pairs: DataFrame, values: DataFrame) -> DataFrame:
    """Joins (a, b, m, ...) with ``values`` (b, ...), whose rows are copied to the salts over which a leader's pairs are dealt."""
    leaders = pairs.groupBy("b").agg(F.max("m").alias("m")).join(values, "b").withColumn("salt", F.explode(F.sequence(F.lit(0), _salts(F.col("m")) - 1))).drop("m")
    return pairs.withColumn("salt", _salt("a", F.col("m"))).join(leaders, ["b", "salt"])


def _star_links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Compares each node with the leader that stands before it, in rows sorted by (b, salt, side)."""
    leader, full = None, None
    for batch in batches:
        out = []
        for b, side, a, found in zip(batch["b"], batch["side"], batch["a"], batch["shingles"]):
            if side == 0:
                leader, full = b, found
            elif leader == b and linked_sets(found, full):
                out.append((a, b))
        yield pd.DataFrame(out, columns=["a", "b"])


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b, m) whose full sets are similar enough, as (a, b). Sets are dealt by node, then by (b, salt)."""
    leaders = pairs.groupBy("b").agg(F.max("m").alias("m"))
    roles = pairs.select(F.col("a").alias("node"), "a", "b", _salt("a", F.col("m")).alias("salt"), F.lit(1).alias("side")).union(
        leaders.select(F.col("b").alias("node"), F.lit(None).cast("binary"), "b", F.explode(F.sequence(F.lit(0), _salts(F.col("m")) - 1)), F.lit(0)))
    rows = roles.join(sets, "node").select("b", "salt", "side", "a", "shingles")
    return rows.repartition("b", "salt").sortWithinPartitions("b", "salt", "side").mapInPandas(_star_links, "a binary, b binary")


_UNIT = ["key", "bi", "bj"]
_LIVE = [*_UNIT, "side", "band", "node", "component"]


def _candidates(g: pd.DataFrame) -> list[tuple[int, int, int]]:
    """(XOR count, i, j) of the pairs of rows in one unit of work that sketches and sizes allow to be linked, that are in
    different components and in no earlier common bucket. Rows of sides 1 and 2 meet those of side 0, rows of side 2
    each other too."""
    sketch = np.stack(g["sketch"].to_numpy()).view(np.uint64)
    bands = np.stack(g["bands"].to_numpy())
    size, side, code, band = g["n_shingles"].to_numpy(), g["side"].to_numpy(), pd.factorize(g["component"])[0], g["band"].iloc[0]
    left, right = np.flatnonzero(side > 0), np.flatnonzero(side != 1)
    out: list[tuple[int, int, int]] = []
    for i in left:
        js = right[(right > i) | (side[right] == 0)] if side[i] == 2 else right[side[right] == 0]
        js = js[(code[js] != code[i]) & (DENOMINATOR * np.minimum(size[js], size[i]) >= NUMERATOR * np.maximum(size[js], size[i]))]
        if band and len(js):
            js = js[~(bands[js, :band] == bands[i, :band]).any(1)]
        if len(js):
            xor = np.bitwise_count(sketch[js] ^ sketch[i]).sum(1)
            near = xor <= MOST_XOR
            out += zip(xor[near].tolist(), [int(i)] * int(near.sum()), js[near].tolist())
    return out


def _live(g: pd.DataFrame) -> pd.DataFrame:
    """The rows of a unit that have a candidate in it."""
    return g.iloc[sorted({x for _, i, j in _candidates(g) for x in (i, j)})][_LIVE]


def _linked_in(g: pd.DataFrame) -> pd.DataFrame:
    """Links between different components in one unit, by full sets; the most similar by sketch are looked at first."""
    group, node, full = pd.factorize(g["component"])[0].tolist(), g["node"].to_numpy(), g["shingles"].to_numpy()
    root = list(range(max(group) + 1))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for _, i, j in sorted(_candidates(g)):
        a, b = find(group[i]), find(group[j])
        if a != b and linked_sets(full[i], full[j]):
            root[a] = b
            out.append((min(node[i], node[j]), max(node[i], node[j])))
    return pd.DataFrame(out, columns=["a", "b"])


def _by_unit(rows: DataFrame, work, ddl: str) -> DataFrame:
    """Runs ``work`` on the rows of each unit; a unit may go over Arrow batches, and only one unit is held."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
            if not len(rows):
                continue
            unit = rows[_UNIT]
            cuts = [*np.flatnonzero(unit.ne(unit.shift()).any(axis=1).to_numpy()), len(rows)]
            held = rows.iloc[cuts[-2] :].reset_index(drop=True)
            yield from (work(rows.iloc[a:b]) for a, b in zip(cuts[:-2], cuts[1:-1]))
        if held is not None and len(held):
            yield work(held)

    return rows.repartition(*_UNIT).sortWithinPartitions(*_UNIT).mapInPandas(run, ddl)


def _hot_keys(nodes: DataFrame, most: int = 100_000, chunk: int = 1 << 21) -> DataFrame:
    """(key): the band keys that a large share of the nodes has, a written table of at most ``2 * most`` rows.

    A key is hot from BLOCK nodes on, or one in ``most`` of all, by counts of what stands together in the same
    partition. The list only decides which of two ways a bucket goes; both give the same rows.
    """
    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0

        def out() -> pd.DataFrame:
            keys, counts = np.unique(np.concatenate(held), return_counts=True)
            return pd.DataFrame({"key": keys[counts > 1], "n": counts[counts > 1].astype(np.int64)})

        for batch in batches:
            if len(batch):
                held.append(np.concatenate(batch["bands"].to_numpy()))
                n += len(held[-1])
            if n >= chunk:
                yield out()
                held, n = [], 0
        if held:
            yield out()

    least = max(BLOCK, nodes.count() * BANDS // most)
    return written(nodes.select("bands").mapInPandas(counted, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") * 2 >= least).select("key"), "hot")


def _buckets(nodes: DataFrame) -> DataFrame:
    """(key, band, node, n_shingles, leader, m) of all buckets with m > 1 nodes, a written table.

    Nodes are dealt by key once. Hot keys stay out of that: their leaders and sizes come from partial aggregates and
    are broadcast to the rows.
    """
    members = nodes.select("node", "n_shingles", F.posexplode("bands").alias("band", "key"))
    hot = _hot_keys(nodes)
    by_key = W.partitionBy("key")
    cold = members.join(F.broadcast(hot), "key", "left_anti").withColumns({"leader": F.min("node").over(by_key), "m": F.count("*").over(by_key)}).where("m > 1")
    large = written(members.join(F.broadcast(hot), "key").groupBy("key").agg(F.min("node").alias("leader"), F.count("*").alias("m")).where("m > 1"), "large")
    out = written(cold.select("key", "band", "node", "n_shingles", "leader", "m").union(
        members.join(F.broadcast(large), "key").select("key", "band", "node", "n_shingles", "leader", "m")), "members")
    delete(hot, large)
    return out


def _open_buckets(members: DataFrame, component: DataFrame) -> DataFrame:
    """The rows of ``members``, leaders left out, of buckets whose nodes are in several components.

    Of buckets with the same nodes only that of the smallest band stays: in it the pairs are looked at. A bucket's one
    row is copied to the salts over which its nodes are dealt.
    """
    rows = members.where("m > 2").where("node <> leader").drop("component").join(component, "node", "left").withColumn("component", F.coalesce("component", "node"))
    still = rows.groupBy("key", "band", "m").agg(
        F.min("component").alias("low"), F.max("component").alias("high"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(2))).alias("y"))
    kept = still.where("low <> high").groupBy("x", "y", "m").agg(F.min(F.struct("band", "key")).alias("k")).select(
        "k.key", F.explode(F.sequence(F.lit(0), _salts(F.col("m")) - 1)).alias("salt"))
    return rows.withColumn("salt", _salt("node", F.col("m"))).join(kept, ["key", "salt"], "left_semi").drop("salt")


def _units(rows: DataFrame) -> DataFrame:
    """The rows of open buckets by unit of work: (key, bi, bj) and side.

    Of two nodes in different components one is not in the bucket's largest component. Those are cut into blocks, which
    meet each other and the blocks of the largest component. A block has about ACROSS nodes, fewer if their full sets
    would take more than ACROSS_BYTES. A node is copied once for each block that it meets: where one block holds all
    that are not in the largest component, no node of that is copied.
    """
    def blocks(n: Column, size: Column) -> Column:
        return F.greatest(F.ceil(n / ACROSS), F.ceil(8 * size / ACROSS_BYTES)).cast("int")

    counts = rows.groupBy("key", "m", "component").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("size")).groupBy("key", "m").agg(
        F.max(F.struct("n", "component", "size")).alias("top"), F.sum("n").alias("all"), F.sum("size").alias("size"))
    counts = counts.select(
        "key", F.col("top.component").alias("top"), blocks(F.col("all") - F.col("top.n"), F.col("size") - F.col("top.size")).alias("few"), blocks(F.col("top.n"), F.col("top.size")).alias("many"),
        F.explode(F.sequence(F.lit(0), _salts(F.col("m")) - 1)).alias("salt"))
    marked = rows.withColumn("salt", _salt("node", F.col("m"))).join(counts, ["key", "salt"])
    own, other, few, many = (F.col(c) for c in ("own", "other", "few", "many"))
    largest = marked.where("component = top").withColumns({"own": F.pmod(F.xxhash64("node"), many).cast("int"), "bi": F.explode(F.sequence(F.lit(0), few - 1))})
    # one block alone meets itself together with the first block of the largest component
    rest = marked.where("component <> top").withColumn("own", F.pmod(F.xxhash64("node"), few).cast("int")).withColumn(
        "other", F.explode(F.sequence(F.when(few == 1, 1).otherwise(0), few + many - 1)))
    side = F.when(few == 1, F.when(other == 1, 2).otherwise(1)).when(other >= few, 1).when(own == other, 2).when(own < other, 1).otherwise(0)
    low, high = F.when(other >= few, own).otherwise(F.least(own, other)), F.when(other >= few, other).otherwise(F.greatest(own, other))
    return largest.select(*rows.columns, "bi", (own + few).alias("bj"), F.lit(0).alias("side")).union(rest.select(*rows.columns, low, high, side))


def _candidate_rows(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """The rows of ``_units`` that have a candidate there, a written table. Only sizes and sketches are sent around for this."""
    # units are made of thin rows, which are used three times there, and meet their sketches once, behind that
    known = _units(rows).join(_of(nodes.select("node", "sketch", "bands"), rows), "node")
    return written(_by_unit(known, _live, "key long, bi int, bj int, side int, band int, node binary, component binary"), "live")


def _of(values: DataFrame, rows: DataFrame) -> DataFrame:
    """``values`` of the nodes in the written table ``rows``, and a few others; nothing is shuffled. A join has to follow."""
    return maybe_wanted(values, F.xxhash64("node"), rows.select(F.xxhash64("node").alias("key")), "hit").where("hit").drop("hit")


def _compared(live: DataFrame, nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b), a written table of the links between different components in the units of ``live``."""
    full = _of(nodes.select("node", "n_shingles", "sketch", "bands"), live).join(_of(sets, live), "node")
    return written(_by_unit(live.join(full, "node"), _linked_in, "a binary, b binary"), "links")


def _links(nodes: DataFrame, docs: DataFrame, repeated: bool) -> DataFrame:
    """(a, b), a written table of links that join all nodes of a group."""
    members = _buckets(nodes)
    pairs = members.where("node <> leader").groupBy(F.col("node").alias("a"), F.col("leader").alias("b")).agg(F.max("m").alias("m"))
    size = nodes.select("node", "n_shingles", "sketch")
    pairs = written(
        _with_leader(pairs.join(size.toDF("a", "na", "sa"), "a"), size.toDF("b", "nb", "sb"))
        .where(_sizes_allow("na", "nb") & (_xor_count("sa", "sb") <= MOST_XOR)).select("a", "b", "m"), "pairs")
    sets = _full_sets(pairs.select(F.col("a").alias("node")).union(pairs.select("b")), nodes, docs, repeated)
    every = written(_verified(pairs, sets), "links")
    delete(pairs)
    live = _candidate_rows(written(_open_buckets(members, components(every)), "open"), nodes)
    if live.limit(1).count():
        lacking = written(live.select("node").distinct().join(sets, "node", "left_anti"), "lacking")
        if lacking.limit(1).count():
            sets = sets.unionByName(_full_sets(lacking, nodes, docs, repeated).join(lacking, "node", "left_semi"))
        every = every.union(_compared(live, nodes, sets))
    delete(members)
    return every


def _groups(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, n_shingles, group, component_id), one row a document; ``group`` is null without shingles."""
    docs = docs.select("doc_id", "text")
    signed = written(docs.select("doc_id", F.xxhash64("text").alias("text_key"), _signature("text").alias("s")).select("doc_id", "text_key", "s.*"), "signatures")
    nodes = written(
        signed.where("n_shingles > 0").groupBy("node").agg(
            F.min("doc_id").alias("doc_id"), F.min(F.xxhash64("doc_id", "text_key")).alias("rep"), F.count("*").alias("copies"),
            F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")),
        "nodes")
    repeated = signed.groupBy("doc_id", "text_key").count().where("count > 1").limit(1).count() > 0
    found = components(_links(nodes, docs, repeated))
    least = nodes.select("node", "doc_id").join(found, "node").groupBy("component").agg(F.min("doc_id").alias("least"))
    groups = (
        nodes.select("node", "doc_id", "copies").join(found, "node", "left").join(least, "component", "left").where("copies > 1 or component is not null")
        .select("node", F.coalesce("component", "node").alias("group"), F.coalesce("least", "doc_id").alias("group_id")))
    return signed.join(groups, "node", "left").select(
        "doc_id", "text_key", "n_shingles", F.coalesce("group", "node").alias("group"), F.coalesce("group_id", "doc_id").alias("component_id"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row a document.

    Words are lower-cased (A-Z) runs of ``[^\\x20\\x09-\\x0D]``. Texts link if 100 * |intersection| >= 75 * |union| of
    their shingle sets, compared as sets of 64-bit hashes. Null, empty and blank texts have no shingles and are groups
    of their own. ``component_id`` is the smallest non-null doc_id of the group; ``kept`` is true where it is the
    document's own, and for all rows of a group that has null ids only. Repeated rows are kept or not together. Other
    columns of ``docs`` play no part, so none can clash. An empty table gives no rows.
    """
    return _groups(docs).select(
        "doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """``docs``, with all its columns, with one row of each group: of the smallest id (nulls last) and, of equal ids, the
    smallest hash of the text. Repeated rows of it are one. Texts without words all stay.

    Which rows go is worked out on their keys; the rows themselves are not shuffled (see ``without``). Any names of
    further columns may be taken.
    """
    marks = written(_groups(docs).where("group is not null").withColumn("key", F.xxhash64("doc_id", "text_key")), "marks")
    first = marks.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key", "key")).alias("first"), F.count("*").alias("rows")).where("rows > 1")
    judged = marks.select("group", "key").join(first.select("group", F.col("first.key").alias("first")), "group", "left").groupBy("key").agg(
        F.bool_or(F.coalesce(F.col("key") == F.col("first"), F.lit(True))).alias("stays"), F.count("*").alias("rows"))
    judged = written(judged, "judged")
    # repeated rows of one that stays are looked up with those that go, and become one
    surely, looked_up = without(docs, row_key(docs), judged.where("not stays or rows > 1").select("key"), judged.where("stays").select("key"))
    return surely.union(looked_up.dropDuplicates(["doc_id", "text"]))
