"""Texts into containers of fixed capacity by swap-based local search."""

from __future__ import annotations

from heapq import heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelmodes.session import cut

SHARD = 4_000  # items that one local search sees


class Bins:
    """Containers of one shard and the local search between them.

    ``sizes`` are put first-fit in the order given (a shuffled one), which is where the search starts. A container's rank is its fill, then its number; items only move to containers of
    higher rank, and only where the sum of squared fills rises, so the search ends. For every size the lowest-ranked container that holds an item of it is known, so
    the best item for a gap is found without looking through containers, and none is overlooked.
    """

    def __init__(self, sizes: list[int], capacity: int) -> None:
        self.capacity = capacity
        gaps, self.items, many = np.zeros(max(len(sizes), 1), np.int64), [], 0
        for i, size in enumerate(sizes):
            b = int((gaps[:many] >= size).argmax()) if many else 0
            if b == many or gaps[b] < size:
                b, many = many, many + 1
                gaps[b] = capacity
                self.items.append({})
            gaps[b] -= size
            self.items[b].setdefault(size, []).append(i)
        self.many = many
        self.fill = [capacity - int(g) for g in gaps[:many]]
        self.start = list(range(len(sizes)))  # the container of every item at the start
        for b, held in enumerate(self.items):
            for own in held.values():
                for i in own:
                    self.start[i] = b
        self.sizes = np.array(sorted(set(sizes)), np.int64)
        self.at = {int(s): k for k, s in enumerate(self.sizes)}
        self.heaps: list[list[int]] = [[] for _ in self.sizes]
        self.low = np.full(len(self.sizes), np.iinfo(np.int64).max)  # rank of the lowest container with an item of each size; may lag behind, but is never too high
        for b in range(many):
            self._announce(b)

    def rank(self, b: int) -> int:
        return self.fill[b] * self.many + b

    def _announce(self, b: int) -> None:
        r = self.rank(b)
        for s in self.items[b]:
            k = self.at[s]
            heappush(self.heaps[k], r)
            self.low[k] = min(self.low[k], r)

    def _settle(self, k: int) -> int:
        """The true lowest rank of a size."""
        heap, s = self.heaps[k], int(self.sizes[k])
        while heap:
            b = heap[0] % self.many
            if self.rank(b) == heap[0] and s in self.items[b]:
                break
            heappop(heap)
        self.low[k] = heap[0] if heap else np.iinfo(np.int64).max
        return self.low[k]

    def _shift(self, s: int, source: int, target: int) -> None:
        own = self.items[source][s]
        self.items[target].setdefault(s, []).append(own.pop())
        if not own:
            del self.items[source][s]
        self.fill[source] -= s
        self.fill[target] += s

    def _eligible(self, lo: int, hi: int, below: int) -> np.ndarray:
        """Places of the sizes over ``lo`` and up to ``hi`` that a container of lower rank than ``below`` holds, in ascending order."""
        first, last = np.searchsorted(self.sizes, [lo, hi], side="right")
        return first + np.flatnonzero(self.low[first:last] < below)

    def _best(self, lo: int, hi: int, below: int) -> int:
        """The largest such size, or 0."""
        found = self._eligible(lo, hi, below)
        for k in found[::-1]:
            if self._settle(k) < below:
                return int(self.sizes[k])
        return 0

    def _holder(self, s: int) -> int:
        return self._settle(self.at[s]) % self.many

    def improve(self) -> None:
        """Move, exchange one for one and two for one, from the fullest container down, until no step raises the sum of squared fills. Containers that lose all items vanish."""
        again = True
        while again:
            again = False
            for r in sorted((self.rank(b) for b, f in enumerate(self.fill) if 0 < f < self.capacity), reverse=True):
                b = r % self.many
                while 0 < self.fill[b] < self.capacity and self._step(b):
                    again = True

    def _step(self, b: int) -> bool:
        gap, rank = self.capacity - self.fill[b], self.rank(b)
        s = self._best(0, gap, rank)
        if s:
            self._done(b, [(s, self._holder(s))], 0, -1)
            return True
        best = (0, 0, 0)
        for t in self.items[b]:
            s = self._best(t + best[0], t + gap, rank)
            if s:
                best = (s - t, s, t)
                if best[0] == gap:
                    break
        if best[0]:
            c = self._holder(best[1])
            self._done(b, [(best[1], c)], best[2], c)
            return True
        return self._two_for_one(b, gap, rank)

    def _two_for_one(self, b: int, gap: int, rank: int) -> bool:
        """Two items from lower containers, together larger by at most the gap, for one that goes to either of these."""
        for t in sorted(self.items[b], reverse=True):
            able = np.array([k for k in self._eligible(0, t + gap - 1, rank) if self._settle(k) < rank], dtype=np.int64)
            if not len(able):
                continue
            own = self.sizes[able]
            partner = np.searchsorted(own, t + gap - own, side="right") - 1  # the largest second item for each first
            total = np.where(partner >= 0, own + own[np.maximum(partner, 0)], 0)
            for j in np.argsort(-total, kind="stable"):
                if total[j] <= t:
                    break
                one, two = int(own[j]), int(own[partner[j]])
                c, d = self._holder(one), self._holder(two)
                if one == two and len(self.items[c][one]) < 2:
                    continue
                for back in {c, d}:
                    change = {b: one + two - t}
                    for place, amount in ((c, -one), (d, -two), (back, t)):
                        change[place] = change.get(place, 0) + amount
                    if self.fill[back] + change[back] <= self.capacity and sum((self.fill[x] + y) ** 2 - self.fill[x] ** 2 for x, y in change.items()) > 0:
                        self._done(b, [(one, c), (two, d)], t, back)
                        return True
        return False

    def _done(self, b: int, received: list[tuple[int, int]], given: int, back: int) -> None:
        for s, c in received:
            self._shift(s, c, b)
        if given:
            self._shift(given, b, back)
        for x in {b, *(c for _, c in received)}:
            self._announce(x)


def _packed(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values(["order", "doc_id", "piece"], ignore_index=True)
    bins = Bins(group["tokens"].tolist(), int(group["capacity"].iloc[0]))
    begun = group["start_bin"].to_list()
    name = f"r{group['round'].iloc[0]}-{group['shard'].iloc[0]}"
    if begun[0] is None:
        begun = [f"{name}-{b}" for b in bins.start]
    bins.improve()
    where, fill = [""] * len(group), [0] * len(group)
    for b, held in enumerate(bins.items):
        for own in held.values():
            for i in own:
                where[i], fill[i] = f"{name}-{b}", bins.fill[b]
    return group.assign(bin_id=where, fill=fill, start_bin=begun)[[c.split()[0] for c in _PACKED.split(", ")]]


_ITEM = "job_id int, capacity int, doc_id long, piece long, start_token long, tokens long, start_bin string"
_PACKED = f"{_ITEM}, bin_id string, fill long"


def pack(sizes: DataFrame, limits: DataFrame, most_jobs: int = 1_000) -> DataFrame:
    """(job_id, capacity, doc_id, piece, start_token, tokens, start_bin, bin_id, fill): every text of ``sizes`` (doc_id, tokens) in a container of every job.

    A text larger than the capacity is cut into full containers and one rest, which is packed like a text; no other is split. Texts of no
    tokens need no room and are left out, like NULL ids. ``limits`` (job_id, capacity_tokens) is a short list of jobs (more than ``most_jobs`` raise); a capacity
    that is NULL or below 1 is no job, of repeated job ids the largest capacity counts.

    Items are dealt by hash into shards of about SHARD; each is packed first-fit in the order of the hash (``start_bin``) and improved by local search until no step is left. Then the
    containers less filled than their job's average are opened and their items dealt again, so unused space doesn't grow with the number of shards,
    until that saves no container or none could be saved. Work is linear in the items; a shard's size is bounded whatever the texts, as ids are unique.
    """
    spark = sizes.sparkSession
    rows = limits.where("capacity_tokens >= 1 AND job_id IS NOT NULL").groupBy("job_id").agg(F.max("capacity_tokens").alias("c")).limit(most_jobs + 1).collect()
    if len(rows) > most_jobs:
        raise ValueError(f"more than {most_jobs} jobs")
    if not rows:
        return spark.createDataFrame([], _PACKED)
    jobs = F.array(*(F.struct(F.lit(int(r.job_id)).alias("job_id"), F.lit(int(r.c)).alias("capacity")) for r in sorted(rows)))
    each = sizes.where("tokens > 0 AND doc_id IS NOT NULL").select("doc_id", "tokens", F.explode(jobs).alias("j")).select("j.*", "doc_id", "tokens")
    whole = F.expr("tokens div capacity")
    rest = F.expr("tokens % capacity")
    whole_parts = each.where("tokens >= capacity").withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), whole - 1)))
    full_bin = F.concat_ws("-", F.lit("full"), "doc_id", "piece")
    done = whole_parts.select(
        "job_id", "capacity", "doc_id", "piece", (F.col("piece") * F.col("capacity")).alias("start_token"), F.col("capacity").cast("long").alias("tokens"),
        full_bin.alias("start_bin"), full_bin.alias("bin_id"), F.col("capacity").cast("long").alias("fill"),
    )
    items = each.where(rest > 0).select("job_id", "capacity", "doc_id", whole.alias("piece"), (whole * F.col("capacity")).alias("start_token"), rest.cast("long").alias("tokens"), F.lit(None).cast("string").alias("start_bin"))
    items = cut(items)
    r, had = 0, {}
    while True:
        counts = {c.job_id: c["count"] for c in items.groupBy("job_id").count().collect()}  # one row per job
        if not counts:
            return done
        shards = F.create_map(*(x for job, n in counts.items() for x in (F.lit(job), F.lit(-(-n // SHARD)))))
        order = F.xxhash64(F.lit(r), "doc_id", "piece")
        dealt = items.withColumns({"order": order, "shard": F.pmod(order, F.element_at(shards, F.col("job_id"))), "round": F.lit(r)})
        got = cut(dealt.groupBy("job_id", "shard").applyInPandas(_packed, _PACKED))
        bins = got.groupBy("job_id", "capacity", "bin_id").agg(F.max("fill").alias("fill"))
        now = {b.job_id: b for b in bins.groupBy("job_id", "capacity").agg(F.count("*").alias("n"), F.avg("fill").alias("mean"), F.sum("fill").alias("t")).collect()}  # one row per job
        # A job goes on while several shards remain, the last round saved a container (the first one always counts) and the bound isn't met.
        open_ = [j for j, b in now.items() if counts[j] > SHARD and b.n > -(-b.t // b.capacity) and (j not in had or b.n < had[j])]
        if not open_:
            return done.unionByName(got)
        means = F.create_map(*(x for j in open_ for x in (F.lit(j), F.lit(float(now[j].mean)))))
        loose = F.coalesce(F.col("fill") < F.element_at(means, F.col("job_id")), F.lit(False))
        done = done.unionByName(got.where(~loose))
        items = cut(got.where(loose).select(*[x.split()[0] for x in _ITEM.split(", ")]))
        had = {b.job_id: b.n for b in bins.where(loose).groupBy("job_id").agg(F.count("*").alias("n")).collect()}  # one row per job
        r += 1


def packing_report(packed: DataFrame) -> DataFrame:
    """(job_id, capacity, at_start, containers, least, tokens, filled, documents, split): ``at_start`` counts the containers before the search, ``least`` is the bound from the total size, ``filled`` the share of space used."""
    count = lambda c: packed.groupBy("job_id", "capacity", c).agg(F.sum("tokens").alias("tokens")).groupBy("job_id", "capacity").agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"))
    sums = count("bin_id").withColumnRenamed("n", "containers").join(count("start_bin").select("job_id", F.col("n").alias("at_start")), "job_id")
    texts = packed.groupBy("job_id", "doc_id").agg(F.count("*").alias("n")).groupBy("job_id").agg(F.count("*").alias("documents"), F.sum((F.col("n") > 1).cast("long")).alias("split"))
    return sums.join(texts, "job_id").select(
        "job_id", "capacity", "at_start", "containers", F.ceil(F.col("tokens") / F.col("capacity")).alias("least"), "tokens", (F.col("tokens") / (F.col("containers") * F.col("capacity"))).alias("filled"), "documents", "split"
    )
