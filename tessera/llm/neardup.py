"""MinHash near-duplicates by an inverted join over signature coordinates."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import arrow_map, checkpoint, semi, stored, with_arrays, with_texts
from .components import components

WORDS, PERCENT = 5, 75
#: Coordinates that are posted, and how many collisions make a pair a candidate. At the lowest similarity that counts, 0.75, a
#: pair has fewer with probability 1.5e-5, at 0.8 with 1e-7.
COORDINATES, MATCHES = 64, 33
#: Collisions of a pair are counted on BITS bits of each coordinate's value: never too few, one too many with probability 5e-4.
BITS = 16
LANES = 64 // BITS
#: Parities tell for each of PARITIES bins whether an odd number of a set's shingles falls there: two sets differ
#: in at least as many shingles as they have unequal parities, so that filter loses nothing, and is sharp for sets up to that size.
PARITIES = 1024
VALUES = [f"v{i}" for i in range(COORDINATES // LANES)]
ODD = [f"o{i}" for i in range(PARITIES // 64)]
#: Rounds in which each posting list is compared with one member, before the lists are compared pair by pair.
ROUNDS = 1
#: Longer posting lists are cut into blocks, so that no task holds more than a pair of blocks.
BLOCK = 512
#: Comparisons within lists that a task should make, and the most tasks that they are dealt to.
TASK_PAIRS, MOST_TASKS = 2_000_000, 100_000
#: Pairs that are confirmed with one copy of a text; a text of more pairs is copied, so that its pairs are spread.
TEXT_PAIRS = 500

_rng = np.random.default_rng(7)
_MASK = _rng.integers(0, 2**63, COORDINATES, dtype=np.uint64)
_MULTIPLIER = _rng.integers(0, 2**63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(column):
    """(starts, values): the sorted distinct shingle hashes of each text of an Arrow column, one after another."""
    for _, data, offsets in K.chunks(column):
        h, bounds = K.word_hashes(data, offsets, fold=True)
        n = np.diff(bounds)
        whole, short = K.runs(h, WORDS), [K.runs(h, k) for k in range(1, WORDS)]
        sets = [np.unique(whole[b : b + k - WORDS + 1]) if k >= WORDS else short[k - 1][b : b + 1] if k else whole[:0] for b, k in zip(bounds.tolist(), n.tolist(), strict=False)]
        starts = np.zeros(len(sets) + 1, np.int64)
        np.cumsum([len(s) for s in sets], out=starts[1:])
        yield starts, np.concatenate(sets) if sets else np.zeros(0, np.uint64)


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, d1, d2, signature, sketch): d1 and d2 are a digest of the set, signature holds a token for each posted
    coordinate and its value, sketch BITS bits of every coordinate, then the parities."""
    import pyarrow as pa

    def make():
        def of(b):
            out = [[], [], [], [], []]
            for starts, u in shingle_sets(b.column("text")):
                n = np.diff(starts)
                full = np.flatnonzero(n)
                at = starts[:-1][full]
                d = np.zeros((2, len(n)), np.uint64)
                tokens, sketch = np.zeros((len(n), COORDINATES), np.uint64), np.zeros((len(n), len(VALUES + ODD)), np.uint64)
                if len(full):
                    for i in (0, 1):
                        d[i, full] = np.add.reduceat(K.mix(u ^ _MASK[i]), at)
                    tmp = np.empty_like(u)
                    for i in range(COORDINATES):
                        np.bitwise_xor(u, _MASK[i], out=tmp)
                        np.multiply(tmp, _MULTIPLIER[i], out=tmp)
                        token = K.mix(np.minimum.reduceat(tmp, at) + np.uint64((i + 1) * 0x9E3779B97F4A7C15 % 2**64))
                        tokens[full, i] = token
                        sketch[full, i // LANES] |= (token >> np.uint64(64 - BITS)) << np.uint64(i % LANES * BITS)
                    bins = (u >> np.uint64(54)).astype(np.int64) + np.repeat(np.arange(len(n)), n) * PARITIES
                    odd = np.bincount(bins, minlength=len(n) * PARITIES).astype(np.uint8) & 1
                    sketch[:, len(VALUES) :] = np.packbits(odd, bitorder="little").view(np.uint64).reshape(len(n), -1)
                for x, y in zip(out, (n, K.signed(d[0]), K.signed(d[1]), K.signed(tokens.reshape(-1)), K.signed(sketch.reshape(-1))), strict=True):
                    x.append(y)
            n, d1, d2, tokens, sketch = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in out)
            fixed = lambda x, k: pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * k), pa.array(x))
            return [pa.array(n), pa.array(d1), pa.array(d2), fixed(tokens, COORDINATES), fixed(sketch, len(VALUES + ODD))]

        return of

    return with_arrays(docs.select("doc_id", "text"), make, "n_shingles long, d1 long, d2 long, signature array<long>, sketch array<long>", ("doc_id",))


def shingles(text: str) -> set:
    """The shingles of a text themselves."""
    w = text.encode().lower().split()
    return set(zip(*(w[i:] for i in range(WORDS)), strict=False)) if len(w) >= WORDS else {tuple(w)} if w else set()


def similar(pairs: DataFrame) -> DataFrame:
    """(a, b) of those rows (a, b, x, y) whose texts x and y have sets similar enough, by the words themselves."""
    import pyarrow as pa

    def run(batches):
        last, known = None, set()
        for part in batches:
            keep = []
            for b, x, y in zip(*(part.column(c).to_pylist() for c in ("b", "x", "y")), strict=True):
                if (b, y) != last:
                    last, known = (b, y), shingles(y)
                own = shingles(x)
                k = len(own & known)
                keep.append(k > 0 and 100 * k >= PERCENT * (len(own) + len(known) - k))
            yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return arrow_map(pairs.select("a", "b", "x", "y"), run, "a long, b long")


def postings(reps: DataFrame) -> DataFrame:
    """(node, common, prefix) of the nodes that can share MATCHES posted coordinates with another.

    Tokens are ordered by how many nodes post them, rarest first, the same order for all. Two nodes that share MATCHES of
    COORDINATES tokens share one among the first COORDINATES - MATCHES + 1 of either. Tokens of one node come first and link
    nothing: a node with enough of those posts nothing, and is skipped from here on. common sums how often a node's tokens are posted."""
    tokens = reps.select("node", F.explode("signature").alias("token"))
    often = tokens.groupBy("token").agg(F.count("*").alias("often")).filter("often > 1")
    own = tokens.join(often, "token").groupBy("node").agg(F.sort_array(F.collect_set(F.struct("often", "token"))).alias("x"), F.sum("often").alias("common"))
    keep = F.size("x") - (MATCHES - 1)
    return own.filter(keep > 0).select("node", "common", F.transform(F.slice("x", F.lit(1), keep), lambda x: x["token"]).alias("prefix"))


def _alike(n: str, m: str) -> Column:
    """Sizes that allow the similarity."""
    return F.least(n, m) * 100 >= F.greatest(n, m) * PERCENT


def _collide(sketch: np.ndarray, n: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs (i, j) of rows those with MATCHES collisions, and with parities that allow the similarity."""
    odd, most = sketch[:, len(VALUES) :], (n[i] + n[j]) * (100 - PERCENT) / (100 + PERCENT)
    apart = np.zeros(len(i), np.int64)
    for part in (range(0, len(ODD), 2), range(1, len(ODD), 2)):  # half of the parities tell most pairs apart
        for k in part:
            apart += np.bitwise_count(odd[i, k] ^ odd[j, k])
        keep = apart <= most
        i, j, apart, most = i[keep], j[keep], apart[keep], most[keep]
    unequal = np.zeros(len(i), np.int64)
    lowest = np.uint64(sum(1 << BITS * k for k in range(LANES)))
    for k in range(len(VALUES)):
        x, shift = sketch[i, k] ^ sketch[j, k], BITS // 2
        while shift:  # each lane's bits are folded into its lowest
            x, shift = x | x >> np.uint64(shift), shift // 2
        unequal += np.bitwise_count(x & lowest)
    keep = unequal <= COORDINATES - MATCHES
    return i[keep], j[keep]


def _longs(column) -> np.ndarray:
    return column.flatten().to_numpy().view(np.uint64).reshape(len(column), -1)


def agreeing(pairs: DataFrame) -> DataFrame:
    """(a, b) of rows (a, n_a, sketch_a, b, n_b, sketch_b) with enough collisions."""
    import pyarrow as pa

    def run(batches):
        for part in batches:
            if part.num_rows:
                sketch = np.concatenate([_longs(part.column(f"sketch_{s}")) for s in "ab"])
                n, k = np.concatenate([part.column(f"n_{s}").to_numpy() for s in "ab"]), np.arange(part.num_rows)
                i, _ = _collide(sketch, n, k, k + part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column(c).take(pa.array(i)) for c in "ab"], names=["a", "b"])

    return arrow_map(pairs, run, "a long, b long")


def met(rows: DataFrame) -> DataFrame:
    """(a, b) for the pairs within each (token, block) of rows (token, block, own, inner, node, component, n, sketch), which are sorted so, that
    are in different components, in a block of two kinds of different own, and have enough collisions. A group is held in one task, of BLOCK or
    twice BLOCK rows; pairs are compared a distance at a time, all groups of a batch together."""
    import pyarrow as pa

    def compared(t):
        column = lambda c: t.column(c).to_numpy(zero_copy_only=False)
        token, block, own, inner, node, component, n = map(column, ("token", "block", "own", "inner", "node", "component", "n"))
        sketch, out = _longs(t.column("sketch")), []
        for d in range(1, t.num_rows):
            i = np.flatnonzero((token[d:] == token[:-d]) & (block[d:] == block[:-d]))
            if not len(i):
                break
            j = i + d
            fits = (component[i] != component[j]) & (inner[i] | (own[i] != own[j])) & (np.minimum(n[i], n[j]) * 100 >= np.maximum(n[i], n[j]) * PERCENT)
            i, j = _collide(sketch, n, i[fits], j[fits])
            if len(i):
                out.append((node[i], node[j]))
        a, b = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (node[:0], node[:0])
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    def run(batches):
        held = None
        for part in batches:
            held = part if held is None else pa.concat_batches([held, part])
            if not held.num_rows:
                continue
            token, block = held.column("token").to_numpy(), held.column("block").to_numpy()
            others = np.flatnonzero((token != token[-1]) | (block != block[-1]))
            if len(others):  # the last group may go on in the next batch
                cut = int(others[-1]) + 1
                yield compared(held.slice(0, cut))
                held = held.slice(cut)
        if held is not None and held.num_rows:
            yield compared(held)

    return arrow_map(rows, run, "a long, b long")


def verified(pairs: DataFrame, who: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes whose documents' texts have sets similar enough. who: node and its doc_id.

    A text stands once for TEXT_PAIRS of its pairs, so that neither side gathers a common one's pairs in one task."""
    nodes = checkpoint(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).groupBy("node").agg(F.ceil(F.count("*") / TEXT_PAIRS).cast("int").alias("copies")))
    wanted = checkpoint(nodes.join(who, "node"))
    texts = with_texts(docs, checkpoint(wanted.select("doc_id").distinct())).dropDuplicates(["doc_id", "text"]).join(wanted, "doc_id").select("node", "copies", "text")
    texts = stored(texts.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).drop("copies"))
    both = pairs.join(nodes.select(F.col("node").alias("a"), F.col("copies").alias("n")), "a").join(nodes.select(F.col("node").alias("b"), F.col("copies").alias("m")), "b")
    both = both.select("a", "b", F.pmod(F.xxhash64("b"), "n").cast("int").alias("i"), F.pmod(F.xxhash64("a"), "m").cast("int").alias("j"))
    both = both.join(texts.select(F.col("node").alias("a"), F.col("copy").alias("i"), F.col("text").alias("x")), ["a", "i"])
    both = both.join(texts.select(F.col("node").alias("b"), F.col("copy").alias("j"), F.col("text").alias("y")), ["b", "j"])
    return checkpoint(similar(both).distinct())


def links(reps: DataFrame, who: DataFrame, docs: DataFrame) -> DataFrame:
    """Links (a, b) between nodes that leave the same components as all links would."""
    p = stored(postings(reps))
    facts = stored(reps.join(p.select("node"), "node", "left_semi").select("node", "n", "sketch"))
    spark = p.sparkSession
    found, label = [], spark.createDataFrame([], "node long, component long")
    with_label = lambda df: df.join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))
    fact = lambda s: facts.select(*[F.col(c).alias(f"{c}_{s}") for c in ("n", "sketch")], F.col("node").alias(s))
    for k in range(ROUNDS):
        # each list against one member, the most common one and then others: copies fall together at the cost of one pair a row
        rows = with_label(p).withColumn("h", (-F.col("common") if k == 0 else F.xxhash64("node", F.lit(k)))).select("node", "component", "h", F.explode("prefix").alias("token"))
        low = rows.groupBy("token").agg(F.min("h").alias("h"))
        hubs = rows.join(low, ["token", "h"]).groupBy("token").agg(F.min("node").alias("hub"))
        hubs = hubs.join(with_label(p.select("node")).select(F.col("node").alias("hub"), F.col("component").alias("component_hub")), "hub")
        pairs = rows.join(hubs, "token").filter("component <> component_hub").select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()
        pairs = pairs.join(fact("a"), "a").join(fact("b"), "b").filter(_alike("n_a", "n_b"))
        new = verified(checkpoint(agreeing(pairs)), who, docs)
        if new.isEmpty():
            break
        found.append(new)
        label = checkpoint(components(reduce(DataFrame.union, found)))
    # what is left: all pairs of a list that aren't in one component yet; those that meet in several lists are taken once
    rows = with_label(p).select("node", "component", F.explode("prefix").alias("token"))
    lists = rows.groupBy("token").agg(F.count("*").alias("size"), F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("token", "size", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    lists = stored(lists)
    compared = lists.agg(F.sum(F.col("size").cast("double") * F.col("size"))).first()[0] or 0.0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(MOST_TASKS, math.ceil(compared / TASK_PAIRS)))
    rows = rows.join(lists.drop("size"), "token").join(facts, "node").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    # a member of block i goes to the pairs of blocks (i, j) for all j
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("block", F.least("own", "other").cast("long") * F.col("blocks") + F.greatest("own", "other"))
    rows = rows.select("token", "block", "own", (F.col("own") == F.col("other")).alias("inner"), "node", "component", "n", "sketch")
    rows = rows.repartition(tasks, "token", "block").sortWithinPartitions("token", "block")
    found.append(verified(checkpoint(met(rows).distinct()), who, docs))
    return reduce(DataFrame.union, found)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row for each row of docs.

    Texts are lower-cased in A-Z and cut into words; a document's set holds its distinct five-word shingles (all its words as one if
    fewer). Equal sets form a class, of which the smallest doc_id stands for all. Documents are linked by a similarity
    of 0.75 or more, confirmed on full sets; component_id is the smallest doc_id reachable. A null or empty text has no
    shingles and links with nothing, a null doc_id likewise: it is its own component. Rows that repeat a doc_id are one document:
    what either links with, both do. kept marks doc_id = component_id (null with null counts as equal)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sig = stored(signatures(docs).withColumn("row", F.monotonically_increasing_id()))
    usable = sig.filter("n_shingles > 0 and doc_id is not null")
    # a class is all rows of one set; its node is the number of a row with its smallest doc_id
    classes = usable.groupBy("d1", "d2").agg(F.min(F.struct("doc_id", "row")).alias("x")).select("d1", "d2", F.col("x.row").alias("node"), F.col("x.doc_id").alias("doc_id"))
    classes = stored(classes)
    who = classes.select("node", "doc_id")
    reps = usable.select(F.col("row").alias("node"), F.col("n_shingles").alias("n"), "signature", "sketch").join(classes.select("node"), "node", "left_semi")
    again = checkpoint(usable.groupBy("doc_id").agg(F.count("*").alias("k")).filter("k > 1").select("doc_id"))
    ties = semi(usable.select("doc_id", "d1", "d2"), again, "doc_id").join(classes.select("d1", "d2", "node"), ["d1", "d2"]).select("doc_id", "node").distinct()
    ties = ties.join(ties.groupBy("doc_id").agg(F.min("node").alias("a")), "doc_id").select("a", F.col("node").alias("b"))
    label = components(links(reps, who, docs).union(ties)).join(who, "node")
    label = label.join(label.groupBy("component").agg(F.min("doc_id").alias("least")), "component").select("node", "least")
    byclass = classes.join(label, "node", "left").select("d1", "d2", F.coalesce("least", "doc_id").alias("component"))
    rest = sig.filter("not (n_shingles > 0 and doc_id is not null)").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    out = usable.select("doc_id", "n_shingles", "d1", "d2").join(byclass, ["d1", "d2"]).select("doc_id", "n_shingles", F.col("component").alias("component_id"))
    return out.union(rest).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
