"""Substring dedup over a log-structured index of window fingerprints.

A window of WINDOW words is filed under its fingerprint: the smallest hash of the GRAM-word runs inside it. Equal windows have
equal fingerprints, and neighbours mostly share theirs, so a text has about one fingerprint for 13 windows. The index is a list of
immutable runs, each bucketed and sorted by fingerprint, with one row for each (fingerprint, hash of the stretch of windows
that share it). A batch of documents becomes a run of its own and is merge-joined with the runs before it, bucket by bucket.
Fingerprints met twice are verified by cryptographic digests of the words themselves, within one fingerprint: stretches that are whole
copies by a digest of all their words, the windows of all others one by one from the texts. Runs of a level are compacted into one of the
next. An index lies in a folder with a manifest, so that a later session opens it and appends a batch."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .common import BROADCAST_KEYS, arrow_map, file_system, remove, semi, shared_dir, stored, with_arrays, with_texts

WINDOW, GRAM = 50, 25
#: Batches that a table is split into, by doc_id, and runs of a level that are compacted into one.
BATCHES, FAN_IN = 3, 2
#: An index keeps texts in folders by ranges of doc_id, of about so many rows but no more than so many folders a batch, and opens those that hold a match.
PART_ROWS, MAX_PARTS = 100_000, 1000
#: What dedup() adds to a table.
RESULTS = ("n_words", "n_removed", "kept_sha256", "clean_text")


def _fingerprints(h: np.ndarray) -> np.ndarray:
    """For each start, the smallest hash of the GRAM-word runs in the WINDOW words from there (over all texts as one)."""
    g = K.runs(h, GRAM)
    width, step = WINDOW - GRAM + 1, 1
    while step * 2 <= width:
        g = np.minimum(g[:-step], g[step:]) if len(g) > step else g[:0]
        step *= 2
    rest = width - step
    return np.minimum(g[: len(g) - rest], g[rest:]) if len(g) > rest else g[:0]


def _starts(bounds: np.ndarray) -> np.ndarray:
    """Where windows within one text start."""
    n = np.diff(bounds)
    valid = np.zeros(int(bounds[-1]) + 1, np.int32)
    long = n >= WINDOW
    np.add.at(valid, bounds[:-1][long], 1)
    np.add.at(valid, bounds[1:][long] - WINDOW + 1, -1)
    return np.flatnonzero(np.cumsum(valid))


def _kept_hash(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _words(column) -> list[list[bytes]]:
    import pyarrow as pa

    return [(t or b"").split() for t in column.cast(pa.binary()).to_pylist()]


def stretches(docs: DataFrame) -> DataFrame:
    """docs with n_words, kept_sha256 (of all words) and their stretches of windows: fp, g (BLAKE2 of all words), start, len."""
    import pyarrow as pa

    def make():
        def of(b):
            n_words, shas, sizes, rows = [], [], [], [[], [], [], []]
            texts = _words(b.column("text"))
            joined = [K.Joined(w) for w in texts]
            for w in joined:
                n_words.append(len(w.words))
                shas.append(hashlib.sha256(w.bytes).hexdigest())
            for row, data, offsets in K.chunks(b.column("text")):
                h, bounds = K.word_hashes(data, offsets)
                at = _starts(bounds)
                fp = _fingerprints(h)[at]
                first = np.flatnonzero(np.concatenate([[True], (fp[1:] != fp[:-1]) | (at[1:] != at[:-1] + 1)])) if len(at) else at
                length = np.diff(np.append(first, len(at)))
                text = np.searchsorted(bounds, at[first], "right") - 1
                start = at[first] - bounds[text]
                counts = np.bincount(text, minlength=len(bounds) - 1)
                g, k = np.empty(len(first), np.int64), 0
                for i, n in enumerate(counts.tolist()):
                    if n:
                        runs = joined[row + i].runs(start[k : k + n], start[k : k + n] + length[k : k + n] + WINDOW - 1)
                        g[k : k + n] = np.frombuffer(b"".join(hashlib.blake2b(x, digest_size=8).digest() for x in runs), "<i8")
                        k += n
                sizes.append(counts)
                for x, y in zip(rows, (K.signed(fp[first]), g, start, length), strict=True):
                    x.append(y)
            offsets = np.zeros(b.num_rows + 1, np.int32)
            if sizes:
                np.cumsum(np.concatenate(sizes), out=offsets[1:])
            fp, g, start, length = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in rows)
            lists = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(x)) for x in (fp, g, start.astype(np.int32), length.astype(np.int32))]
            return [pa.array(n_words, pa.int64()), pa.array(shas, pa.string()), *lists]

        return of

    return with_arrays(docs, make, "n_words long, kept_sha256 string, fp array<long>, g array<long>, start array<int>, len array<int>")


def windows(texts: DataFrame) -> DataFrame:
    """(h1, h2, doc_id, pos) of the windows of (doc_id, text, fps) filed under one of fps; h1 and h2 are the MD5 digest of their words."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            ids, wanted, words = b.column("doc_id").to_numpy(zero_copy_only=False), b.column("fps"), _words(b.column("text"))
            for first, data, offsets in K.chunks(b.column("text")):
                h, bounds = K.word_hashes(data, offsets)
                at, every = _starts(bounds), _fingerprints(h)
                text = np.searchsorted(bounds, at, "right") - 1
                for i in range(len(bounds) - 1):
                    a, z = np.searchsorted(text, [i, i + 1])
                    pos = (at[a:z] - bounds[i])[np.isin(K.signed(every[at[a:z]]), wanted[first + i].values.to_numpy())]
                    joined = K.Joined(words[first + i]) if len(pos) else None
                    for k in range(0, len(pos), 50_000):
                        p = pos[k : k + 50_000]
                        digests = np.frombuffer(b"".join(hashlib.md5(x, usedforsecurity=False).digest() for x in joined.runs(p, p + WINDOW)), "<i8").reshape(-1, 2)
                        yield pa.RecordBatch.from_arrays([pa.array(digests[:, 0].copy()), pa.array(digests[:, 1].copy()), pa.array(np.full(len(p), ids[first + i], np.int64)), pa.array(p.astype(np.int32))], names=["h1", "h2", "doc_id", "pos"])

    return arrow_map(texts.select("doc_id", "text", "fps"), run, "h1 long, h2 long, doc_id long, pos int")


def removed(texts: DataFrame) -> DataFrame:
    """texts with n_words, n_removed, kept_sha256 and clean_text in place of spans, which are (start, len) of windows."""
    import pyarrow as pa

    def make():
        def of(b):
            out = [[], [], [], []]
            for t, spans in zip(b.column("text").cast(pa.binary()).to_pylist(), b.column("spans"), strict=True):
                w = (t or b"").split()
                edge = np.zeros(len(w) + 1, np.int32)
                s = spans.values
                start, length = s.field("start").to_numpy(), s.field("len").to_numpy()
                fits = start + length + WINDOW - 1 <= len(w)  # all do, but where rows share a doc_id
                np.add.at(edge, start[fits], 1)
                np.add.at(edge, (start + length + WINDOW - 1)[fits], -1)
                gone = np.cumsum(edge[:-1]) > 0
                kept = [w[k] for k in np.flatnonzero(~gone)]
                clean = b" ".join(kept) if gone.any() else t
                for x, y in zip(out, (len(w), int(gone.sum()), _kept_hash(kept), None if clean is None else clean.decode()), strict=True):
                    x.append(y)
            return [pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)]

        return of

    return with_arrays(texts, make, "n_words long, n_removed long, kept_sha256 string, clean_text string").drop("spans")


RUN = "fp BIGINT, g BIGINT, doc_id BIGINT, n BIGINT"


@dataclass
class Run:
    level: int
    name: str
    buckets: int


@dataclass
class Texts:
    """Texts of one appended batch: folders part=0 ... over equal ranges of doc_id from lo to hi."""

    name: str
    lo: int
    hi: int
    parts: int

    def part(self):
        return F.floor((F.col("doc_id") - F.lit(self.lo)) / F.lit(self.hi - self.lo + 1) * F.lit(self.parts)).cast("int")


@dataclass
class Index:
    """Runs of the fingerprints seen so far, as tables bucketed and sorted by fp, and the texts of appended batches, in one shared folder.

    manifest-<n>.json in that folder names what belongs to the index after its n-th change; it appears whole, by a rename, and
    what no longer belongs is deleted after that, so that a job that dies leaves the index as it was before its batch."""

    spark: SparkSession
    folder: str
    runs: list[Run] = field(default_factory=list)
    texts: list[Texts] = field(default_factory=list)
    version: int = 0
    fan_in: int = FAN_IN
    old: list[str] = field(default_factory=list)

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> Index:
        """The index in a folder, which is empty or holds what append() left there, in this session or another."""
        fs, at, path = file_system(spark, folder)
        fs.mkdirs(at)
        names = [f.getPath().getName() for f in fs.listStatus(at)]
        found = max((int(n[9:-5]) for n in names if n.startswith("manifest-") and n.endswith(".json")), default=0)
        index = cls(spark, folder, version=found)
        if found:
            stream = fs.open(path(f"{folder}/manifest-{found}.json"))
            state = json.loads(bytes(stream.readAllBytes()))
            stream.close()
            index.runs, index.texts = [Run(**r) for r in state["runs"]], [Texts(**t) for t in state["texts"]]
        for r in index.runs:
            index.known(r)
        return index

    def known(self, r: Run) -> None:
        """Tells the session's catalog of a run; its files carry their buckets in their names."""
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {r.name} ({RUN}) USING parquet CLUSTERED BY (fp) SORTED BY (fp) INTO {r.buckets} BUCKETS LOCATION '{self.folder}/{r.name}'")

    def save(self) -> None:
        fs, _, path = file_system(self.spark, self.folder)
        self.version += 1
        part, whole = path(f"{self.folder}/.manifest-{uuid.uuid4().hex}"), path(f"{self.folder}/manifest-{self.version}.json")
        out = fs.create(part)
        out.write(bytearray(json.dumps({"runs": [vars(r) for r in self.runs], "texts": [vars(t) for t in self.texts]}).encode()))
        out.close()
        if not fs.rename(part, whole):
            raise OSError(f"{whole} was written by another session")
        self.clear()

    def clear(self) -> None:
        """Deletes the runs that were compacted into others."""
        for name in self.old:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            remove(self.spark, f"{self.folder}/{name}")
        self.old = []

    def write(self, rows: DataFrame, level: int = 0) -> Run:
        """A run of (fp, g, doc_id, n): the smallest doc_id with a stretch and how often it was met."""
        r = Run(level, f"fingerprints_{uuid.uuid4().hex}", int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        rows.select("fp", "g", "doc_id", "n").repartition(r.buckets, "fp").write.bucketBy(r.buckets, "fp").sortBy("fp").option("path", f"{self.folder}/{r.name}").saveAsTable(r.name)
        return r

    def rows(self) -> DataFrame | None:
        return reduce(DataFrame.union, [self.spark.table(r.name) for r in self.runs]) if self.runs else None

    def add(self, run: Run, last: bool = False) -> None:
        """A new run; as long as a level is full its runs are merged, keeping the smallest doc_id of each stretch."""
        self.runs.append(run)
        while not last:
            level = self.runs[-1].level
            full = [r for r in self.runs if r.level == level]
            if len(full) < self.fan_in:
                return
            merged = reduce(DataFrame.union, [self.spark.table(r.name) for r in full]).groupBy("fp", "g").agg(F.min("doc_id").alias("doc_id"), F.sum("n").alias("n"))
            run = self.write(merged, level + 1)
            self.runs = [r for r in self.runs if r.level != level] + [run]
            self.old += [r.name for r in full]

    def drop(self) -> None:
        """Deletes the index and its folder."""
        self.old += [r.name for r in self.runs]
        self.clear()
        remove(self.spark, self.folder)

    def keep(self, docs: DataFrame, lo: int, hi: int, n: int) -> None:
        t = Texts(f"texts_{uuid.uuid4().hex}", lo, hi, max(1, min(MAX_PARTS, -(-n // PART_ROWS))))
        docs.select("doc_id", "text").withColumn("part", t.part()).repartitionByRange(t.parts, "part", "doc_id").write.partitionBy("part").parquet(f"{self.folder}/{t.name}")
        self.texts.append(t)

    def texts_of(self, wanted: DataFrame) -> DataFrame:
        """The stored texts of the doc_ids in wanted: of each batch only the folders that hold one are read."""
        found = [self.spark.createDataFrame([], "doc_id long, text string")]
        for t in self.texts:
            parts = [r[0] for r in wanted.filter(F.col("doc_id").between(t.lo, t.hi)).select(t.part().alias("part")).distinct().collect()]  # MAX_PARTS at most
            if parts:
                found.append(self.spark.read.parquet(f"{self.folder}/{t.name}").filter(F.col("part").isin(parts)).select("doc_id", "text"))
        return with_texts(reduce(DataFrame.union, found), wanted)

    def append(self, docs: DataFrame) -> DataFrame:
        """Adds documents, whose doc_ids are all above those of earlier batches (ValueError if not), and returns what dedup() would for
        them, after all earlier ones. Earlier texts are read from the index, and of those only the folders that hold a match.
        Rows without a doc_id pass through. The batch belongs to the index once its manifest is written, which is the last step."""
        docs, more = _packed(docs)
        named = docs.filter("doc_id is not null")
        lo, hi, n = named.agg(F.min("doc_id"), F.max("doc_id"), F.count("*")).first()
        out = _unchanged(stretches(docs.filter("doc_id is null")))
        if n:
            if self.texts and lo <= self.texts[-1].hi:
                raise ValueError(f"doc_id {lo} isn't above {self.texts[-1].hi}")
            self.keep(named, lo, hi, n)
            out = add_batch(self, named, self.texts_of).unionByName(out)
            self.save()
        return _unpacked(out, more)


def add_batch(index: Index, batch: DataFrame, texts_of: Callable[[DataFrame], DataFrame], last: bool = False) -> DataFrame:
    """Adds documents to the index and returns batch with n_words, n_removed, kept_sha256 and clean_text.

    batch holds doc_id and text, further columns too, if any, as a struct; texts_of joins doc_ids of this batch and all before it with their texts, for
    verification, and every doc_id in the batch is above those before."""
    summary = stored(stretches(batch))
    own = summary.select("doc_id", F.explode(F.arrays_zip("fp", "g", "start", "len")).alias("x")).select("doc_id", "x.*")
    run = index.write(own.groupBy("fp", "g").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")))
    new, old = index.spark.table(run.name), index.rows()
    met = new.groupBy("fp").agg(F.sum("n").alias("n")).filter("n > 1").select("fp")
    if old is not None:  # sorted by fingerprint on both sides: no shuffle
        met = met.union(new.select("fp").join(old.select("fp").hint("merge"), "fp", "left_semi"))
    met = stored(met.distinct())
    known = new.select("fp", "g", "doc_id")
    known = (known.union(old.select("fp", "g", "doc_id")) if old is not None else known).join(met, "fp", "left_semi")
    first = stored(known.groupBy("fp", "g").agg(F.min("doc_id").alias("first")))
    whole = own.join(met, "fp", "left_semi").join(first, ["fp", "g"]).filter("first < doc_id").select("doc_id", "start", "len")
    # fingerprints with several stretches: the windows of one document for each stretch, compared one by one
    several = stored(first.groupBy("fp").agg(F.count("*").alias("n")).filter("n > 1").select("fp"))
    wanted = semi(first, several, "fp").select(F.col("first").alias("doc_id"), "fp").groupBy("doc_id").agg(F.collect_set("fp").alias("fps"))
    w = stored(windows(texts_of(stored(wanted))))
    least = stored(w.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last").drop("last"))  # written, so that a hot window's rows can be split in the join
    part = w.join(least, ["h1", "h2"]).filter("first < doc_id").select("doc_id", F.col("pos").alias("start"), F.lit(1).alias("len"))
    spans = stored(whole.union(part).groupBy("doc_id").agg(F.collect_list(F.struct("start", "len")).alias("spans")))
    less = stored(removed(with_texts(batch, spans)))  # with_texts(batch) leaves earlier documents out
    changed = spans.select("doc_id")
    rest = _unchanged(summary).join(F.broadcast(changed) if changed.count() <= BROADCAST_KEYS else changed, "doc_id", "left_anti")
    index.add(run, last)
    return less.unionByName(rest)


def _packed(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """doc_id, text and all other columns but RESULTS as a struct; their names."""
    more = [c for c in docs.columns if c not in ("doc_id", "text", *RESULTS)]
    packed = [F.struct(*[f"`{c}`" for c in more]).alias("_more")] if more else []
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *packed), more


def _unpacked(out: DataFrame, more: list[str]) -> DataFrame:
    return out.select("doc_id", "text", *[F.col("_more")[c].alias(c) for c in more], *RESULTS)


def _unchanged(summary: DataFrame) -> DataFrame:
    """The results of documents that lose nothing, from stretches()."""
    return summary.drop("fp", "g", "start", "len").withColumns({"n_removed": F.lit(0).cast("long"), "clean_text": F.col("text")})


def dedup(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """docs with n_words, n_removed, kept_sha256 and clean_text, one row for each row of docs; columns of their names are replaced.

    clean_text is the text as it was if nothing goes, else the words that stay, one space between them; kept_sha256 is of those words in
    either case. Texts are read from storage only if they are asked for.

    Each word goes that a window of WINDOW words covers whose words also start in a document with a smaller doc_id, as judged on the
    input. The table is fed to an empty index in batches of rising doc_id. A null text has no words; a row
    without a doc_id neither loses words nor takes them from others. Rows that share a doc_id are one document as to what is
    smaller: they don't take words from each other, and each loses what either of them shares with smaller ones
    (a removal found at a place applies to the rows with that doc_id alike, where they have such a place)."""
    docs, more = _packed(docs)
    spark = docs.sparkSession
    cuts = docs.select(F.percentile_approx("doc_id", [k / batches for k in range(1, batches)], 10_000)).first()[0] if batches > 1 else []
    edges = [None, *sorted(set(cuts or [])), None]
    index, out = Index(spark, f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"), []
    try:
        for k, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False)):
            seen = docs.filter("doc_id is not null" if hi is None else F.col("doc_id") <= hi)
            batch = seen if lo is None else seen.filter(F.col("doc_id") > lo)
            out.append(add_batch(index, batch, lambda wanted, seen=seen: with_texts(seen.select("doc_id", "text"), wanted), last=k == len(edges) - 2))
    finally:
        index.drop()
    nameless = _unchanged(stretches(docs.filter("doc_id is null")))
    return _unpacked(reduce(DataFrame.unionByName, [*out, nameless]), more)
