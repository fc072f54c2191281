"""Problem 5: each new batch against everything accepted before, by an index of segments.

A record's tokens, sorted by number, are a string; two sets are as far apart as their strings under insertions and
deletions. A string of length ``l`` is cut into a fixed number of segments, ``apart + 1`` for the most edits that any
partner of this length allows, all of one length at even positions: of every partner, one segment at least is
untouched. The index holds each segment with its position and the string's length. A batch record probes its own
substrings of the segment lengths that its possible partners have; an equal one counts if position and length leave
no more edits before and after it than the pair may have. Segment lengths are rounded down to powers of two, so a
record of ``n`` tokens has about ``n`` substrings for each of one or two lengths: the cost is linear in its size.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covermill.llm.records import HOT_SHARE, Classes, Threshold, verified
from covermill.session import Scratch

#: Parts into which the records under a hot segment are dealt.
SALTS = 16


def _segments(n: str, t: Threshold) -> str:
    """SQL: number of segments of a string of length ``n``, one more than the edits of its farthest partner."""
    return f"(1 + cast(floor({t.den - t.num}D * {t.most(n)} / {t.den} + 1e-9) as int))"


def _length(n: str, t: Threshold) -> str:
    """SQL: tokens in a segment of a string of length ``n``."""
    return f"shiftleft(1, cast(floor(log2({n} div {_segments(n, t)}) + 1e-9) as int))"


def segment_rows(sets: DataFrame, t: Threshold) -> DataFrame:
    """``key, pos, id, n, parity`` of each segment; ``pos`` tokens stand before it."""
    cut = sets.select("id", "n", "parity", "tokens", F.expr(_segments("n", t)).alias("k"), F.expr(_length("n", t)).alias("len"))
    cut = cut.select("*", F.explode(F.expr("sequence(0, k - 1)")).alias("s")).withColumn("pos", F.expr("cast(s * (n div k) as int)"))
    return cut.select(F.xxhash64(F.expr("slice(tokens, pos + 1, len)")).alias("key"), "pos", "id", "n", "parity")


def probe_rows(sets: DataFrame, t: Threshold) -> DataFrame:
    """``key, pos, id, n, parity`` of each substring that may be a segment of a partner."""
    lengths = f"filter(array_distinct(transform(sequence({t.least('n')}, {t.most('n')}), l -> {_length('l', t)})), x -> x <= n)"
    cut = sets.select("id", "n", "parity", "tokens", F.explode(F.expr(lengths)).alias("len"))
    cut = cut.select("*", F.explode(F.expr("sequence(0, n - len)")).alias("pos"))
    return cut.select(F.xxhash64(F.expr("slice(tokens, pos + 1, len)")).alias("key"), "pos", "id", "n", "parity")


class SegmentIndex:
    """The history as a written index that grows with each batch; accepted records are not read or cut again.

    ``path`` is a folder in shared storage with two tables, the segments in buckets by the hash of their key and the
    accepted sets in buckets by id, and with partitions by batch, so that a check shuffles the batch only and each of
    its keys meets the history in that key's bucket. A batch counts once its marker is there, which is written after
    both tables; what is accepted is read off the folder, so any session goes on where another ended. One writer at a
    time. A batch that is tried again under its number is checked against the batches before it and replaces its
    first try. The number of buckets is fixed when the index is made (as many as the session shuffles to, or given).
    """

    def __init__(self, spark, path: str, t: Threshold, buckets: int | None = None):
        self.spark, self.path, self.t = spark, path.rstrip("/"), t
        made = [int(n[8:]) for n in self._names(self.path) if n.startswith("buckets=")]
        self.buckets = made[0] if made else buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.root = f"{self.path}/buckets={self.buckets}"
        self.tables = {}
        for name, key, columns in (("segments", "key", "key long, pos int, id long, n int, parity long"), ("sets", "id", "id long, n int, parity long, tokens array<long>")):
            table = f"covermill_{name}_{hashlib.sha1(self.root.encode()).hexdigest()[:16]}"
            self.tables[name] = table
            spark.sql(f"drop table if exists {table}")
            spark.sql(f"create table {table} ({columns}, batch int) using parquet partitioned by (batch) clustered by ({key}) into {self.buckets} buckets location '{self.root}/{name}'")
            fs, folder = self._fs(f"{self.root}/{name}")
            fs.mkdirs(folder)
            spark.sql(f"msck repair table {table}")

    def _fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _names(self, path: str) -> list[str]:
        fs, at = self._fs(path)
        return [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []

    def batches(self) -> list[int]:
        """The numbers of the batches that are written whole."""
        return sorted(int(n[6:]) for n in self._names(f"{self.root}/done") if n.startswith("batch="))

    def accept(self, sets: DataFrame, batch: int | None = None) -> None:
        """Appends a batch of records, each set once. Without ``batch``, it is the batch after the last whole one."""
        batch = max(self.batches(), default=-1) + 1 if batch is None else int(batch)
        fs, marker = self._fs(f"{self.root}/done/batch={batch}")
        fs.delete(marker, True)
        rows = {"segments": (segment_rows(sets, self.t), "key"), "sets": (sets.select("id", "n", "parity", "tokens"), "id")}
        for name, (df, key) in rows.items():
            view = f"{self.tables[name]}_new"
            df.repartition(self.buckets, key).createOrReplaceTempView(view)
            self.spark.sql(f"insert overwrite table {self.tables[name]} partition (batch = {batch}) select * from {view}")
            self.spark.catalog.dropTempView(view)
        fs.mkdirs(marker)

    def _known(self, name: str, batches: list[int]) -> DataFrame:
        return self.spark.table(self.tables[name]).where(F.col("batch").isin(batches)).drop("batch")

    def check(self, scratch: Scratch, sets: DataFrame, batch: int | None = None) -> DataFrame:
        """``id`` of the records whose overlap with an accepted record reaches the threshold; with ``batch``, with one
        of the batches before it.

        First each segment meets one accepted record with an equal one, which settles most members of large families
        of near-copies; the records left over meet all accepted records by all their substrings.
        """
        known = [n for n in self.batches() if batch is None or n < batch]
        if not known:
            return sets.select("id").limit(0)
        segments, history = self._known("segments", known), self._known("sets", known)
        # as many records of a family as there are, one stands for it under each key
        one = segments.groupBy("key").agg(F.min_by(F.struct("pos", "id", "n", "parity"), "id").alias("x")).select("key", "x.*")
        first = scratch.keep(verified(self._met(one, segment_rows(sets, self.t)), history, self.t, sets).select(F.col("b").alias("id")).distinct())
        rest = sets.join(first, "id", "left_anti")
        probes = probe_rows(rest, self.t)
        # hot segments, of which there are few, meet by salted keys, so that none fills a task
        most = max(1000, segments.count() // HOT_SHARE)
        hot = segments.groupBy("key").agg(F.count("*").alias("rows")).where(F.col("rows") > most).select("key").collect()
        met = self._met(segments, probes)
        if hot:
            # fewer than HOT_SHARE of them
            few = F.broadcast(self.spark.createDataFrame(hot, "key long"))
            salt = F.expr(f"pmod(xxhash64(id), {SALTS})")
            dealt = segments.join(few, "key", "left_semi").withColumn("key", F.xxhash64("key", salt))
            spread = probes.join(few, "key", "left_semi").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumn("key", F.xxhash64("key", F.col("salt").cast("long"))).drop("salt")
            met = self._met(segments, probes.join(few, "key", "left_anti")).unionByName(self._met(dealt, spread)).distinct()
        return first.unionByName(verified(met, history, self.t, rest).select(F.col("b").alias("id")).distinct())

    def _met(self, index: DataFrame, probes: DataFrame) -> DataFrame:
        """Candidates ``(a, b)``: index record ``a`` and batch record ``b`` with an equal segment that position, length
        and parity allow."""
        sides = "abs(x.pos - y.pos) + abs((x.n - x.pos) - (y.n - y.pos)) <= " + self.t.apart("x.n", "y.n")
        met = index.alias("x").join(probes.alias("y"), F.expr(f"x.key = y.key and {self.t.may_pass('x', 'y')} and {sides}"))
        return met.select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()


def replay(scratch: Scratch, found: Classes, index: SegmentIndex) -> DataFrame:
    """``id`` of all repeats when the batches of ``found``, classes within each batch, come in order.

    Each batch is checked against the index and its other records are appended; within a batch nothing is compared,
    and the first batch has nothing before it and is accepted whole. A batch that the index holds already is not
    appended again. Records without a batch or without values are no repeats.
    """
    numbers = [r[0] for r in found.members.select("batch").distinct().orderBy("batch").collect()]
    repeats = []
    for number in numbers:
        own = found.sets.where(F.col("batch") == number).select("id", "n", "parity", "tokens")
        bad = scratch.keep(index.check(scratch, own, number))
        index.accept(own.join(bad, "id", "left_anti"), number)
        members = found.members.where(F.col("batch") == number).join(bad.select(F.col("id").alias("rep")), "rep")
        repeats.append(members.select("id"))
    out = found.members.select("id").limit(0)
    for more in repeats:
        out = out.unionByName(more)
    return out
