"""Units of a schedule worked through in batches: each unit's rows and diagnostics are written, then its marker; a later call goes on
where an earlier one stopped."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterable, Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.model import Run
from quillgraph.operators import edges, iteration, ranking
from quillgraph.sources.folders import Shared
from quillgraph.sources.shared import stored

#: Rows and diagnostics (both with a column unit) of some units.
Work = Callable[[list[str]], tuple[DataFrame, DataFrame]]


@dataclass(frozen=True)
class Marker:
    """What a unit's marker says. basis is what its rows were made from: a marker with another basis does not count."""

    unit: str
    basis: str
    rows: int
    seconds: float
    error: str = ""


class Runner:
    """Outputs of one schedule in a folder of the shared file system: tables rows and diagnostics, partitioned by unit, and a marker a
    unit. Only what has a marker is read."""

    def __init__(self, spark: SparkSession, folder: str, basis: str = ""):
        self.spark, self.folder, self.basis = spark, folder.rstrip("/"), basis
        self.files = Shared(spark)

    def markers(self) -> dict[str, Marker]:
        """Markers of this basis, failures included."""
        found = [Marker(**json.loads(self.files.read(p))) for p in self.files.named(f"{self.folder}/markers/*.json")]
        return {m.unit: m for m in found if m.basis == self.basis}

    def _mark(self, m: Marker) -> None:
        self.files.write(f"{self.folder}/markers/{m.unit}.json", json.dumps(asdict(m)))

    def _unmark(self, units: Iterable[str]) -> None:
        for u in units:
            self.files.drop(f"{self.folder}/markers/{u}.json")

    def run(self, units: Sequence[str], work: Work, batch: int = 16) -> dict[str, str]:
        """What became of each unit: skipped, done, or the error. A batch is one set of jobs; where it fails, its units are worked through
        one at a time, so that only those at fault are missing, and these are tried again by the next call. A unit may have no rows."""
        if len(set(units)) < len(units) or any("/" in u for u in units):
            raise ValueError("units have different names, without /")
        known = self.markers()
        out = {u: "skipped" for u in units if u in known and not known[u].error}
        open_ = [u for u in units if u not in out]
        for k in range(0, len(open_), batch):
            some = open_[k : k + batch]
            try:
                self._commit(some, work)
            except Exception as e:  # reported by unit, below
                if len(some) == 1:
                    self._mark(Marker(some[0], self.basis, 0, 0.0, f"{type(e).__name__}: {e}"[:2000]))
                else:
                    out |= self.run(some, work, 1)
                    continue
            now = self.markers()
            out |= {u: now[u].error or "done" for u in some}
        return {u: out[u] for u in units}

    def _commit(self, units: list[str], work: Work) -> None:
        """Markers go first and come last. Partitions of units that now have no rows are dropped, since an overwrite leaves them."""
        began = time.time()
        self._unmark(units)
        for u in units:
            for table in ("rows", "diagnostics"):
                self.files.drop(f"{self.folder}/{table}/unit={u}")
        rows, diagnostics = work(units)
        mine = F.col("unit").isin(units)
        spread = rows.filter(mine).repartition("unit", F.pmod(F.xxhash64(*rows.columns), F.lit(8)))  # up to eight files a unit, of the same rows in each attempt
        for table, df in (("rows", spread), ("diagnostics", diagnostics.filter(mine))):
            df.write.partitionBy("unit").mode("append").parquet(f"{self.folder}/{table}")
        counts = dict(self._read("rows", units).groupBy("unit").count().collect()) if self._has("rows", units) else {}
        for u in units:
            self._mark(Marker(u, self.basis, counts.get(u, 0), time.time() - began))

    def _has(self, table: str, units: Iterable[str]) -> list[str]:
        return [p for u in units if self.files.exists(p := f"{self.folder}/{table}/unit={u}")]

    def _read(self, table: str, units: Iterable[str]) -> DataFrame:
        """The table's units, their names as text whatever they look like."""
        base = f"{self.folder}/{table}"
        paths = self._has(table, units)
        if not paths:
            raise ValueError(f"{base} has none of these units")
        plain = self.spark.read.parquet(*paths).schema
        return self.spark.read.schema(plain.add("unit", "string")).option("basePath", base).parquet(*paths)

    def committed(self, table: str = "rows") -> DataFrame:
        """A table's rows of all units that are done."""
        return self._read(table, [u for u, m in self.markers().items() if not m.error])

    def report(self) -> DataFrame:
        """unit, rows, seconds, error of all units that have a marker."""
        rows = [(m.unit, m.rows, m.seconds, m.error) for m in self.markers().values()]
        return self.spark.createDataFrame(rows, "unit string, rows long, seconds double, error string")


def unit_diagnostics(cands: ranking.Candidates, rankings: DataFrame, run: Run) -> DataFrame:
    """unit, n_s_cands, n_u_cands, n_s_ranked, n_u_ranked, mass: units of a size that is ranked and those that are, for every group_idx of
    candidates, ranked or not, and the sum of their pi."""
    s, u = edges.retained(*cands, run, None)
    sides = s.select("group_idx", F.lit("S").alias("t")).union(u.select("group_idx", F.lit("U").alias("t")))
    of = lambda t: F.count(F.when(F.col("t") == t, 1))
    able = sides.groupBy("group_idx").agg(of("S").alias("n_s_cands"), of("U").alias("n_u_cands"))
    r = rankings.filter(F.col("unit_idx") != run.sentinel).withColumnRenamed("unit_type", "t").groupBy("group_idx").agg(of("S").alias("n_s_ranked"), of("U").alias("n_u_ranked"), F.sum("pi").alias("mass"))
    j = able.join(r, "group_idx", "left").na.fill(0, ["n_s_ranked", "n_u_ranked"]).na.fill(0.0, ["mass"])
    return j.withColumn("unit", F.col("group_idx").cast("string")).drop("group_idx")


def unit_rankings(fw: DataFrame, refs: DataFrame, run: Run, members: dict[int, list[int]], tol: float = iteration.TOL, **white) -> Work:
    """Work that ranks units made of subfields, named by their numbers, a batch in the same jobs."""

    def work(units: list[str]) -> tuple[DataFrame, DataFrame]:
        some = {int(u): members[int(u)] for u in units}
        cands = tuple(stored(c) for c in ranking.unit_candidates(fw, run.window, some))
        r = stored(ranking.rank_units(fw, refs, run, some, tol, **white))
        return r.withColumn("unit", F.col("group_idx").cast("string")), unit_diagnostics(cands, r, run)

    return work
