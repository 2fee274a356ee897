"""Runs that survive their application: records and states in committed blocks of a folder that driver and executors share."""

from __future__ import annotations

import json
import pickle
import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafield.operators import sampler
from terrafield.operators.relational import thin
from terrafield.session import cut, remove


@dataclass
class Progress:
    """What a store has committed: iterations done, each chain's state, and (iterations, minutes) of every commit."""

    done: int = 0
    states: dict = field(default_factory=dict)
    checkpoints: list[tuple[int, float]] = field(default_factory=list)
    blocks: list[int] = field(default_factory=list)


class RunStore:
    """A folder of blocks. A block's records (a folder per param) and states are written first; a small file under `commits`, put in place by a
    rename, makes them count. What has no such file, because its application ended, is ignored and written over.

    One application writes to a store at a time; any number may read it.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _commits(self) -> list[dict]:
        """The committed blocks' entries in order, up to the first gap."""
        fs, at = self._fs(f"{self.path}/commits")
        if not fs.exists(at):
            return []
        if not [s for s in fs.listStatus(at) if s.getPath().getName().endswith(".json")]:
            return []
        rows = self.spark.read.option("pathGlobFilter", "*.json").text(f"{self.path}/commits", wholetext=True).collect()  # one per block
        every = {e["block"]: e for e in (json.loads(r.value) for r in rows)}
        out = []
        while len(out) in every:
            out.append(every[len(out)])
        return out

    def progress(self) -> Progress:
        commits = self._commits()
        if not commits:
            return Progress()
        last = commits[-1]
        rows = self.spark.read.parquet(f"{self.path}/states/{last['block']}").collect()  # one per chain
        return Progress(last["done"], {r.chain: pickle.loads(r.state) for r in rows}, [(c["done"], c["minutes"]) for c in commits], [c["block"] for c in commits])

    def records(self, param: str | None = None, thinning: float = 1.0) -> DataFrame:
        """The committed records; of one parameter only its own folders are read. thinning: the share of iterations to keep."""
        parts = [f"{self.path}/records/{b}" for b in (c["block"] for c in self._commits())]
        if not parts:
            return self.spark.createDataFrame([], sampler.RECORDS)
        fields = {f.split()[0]: f.split()[1] for f in sampler.RECORDS.split(", ")}
        out = None
        for p in parts:
            t = self.spark.read.schema(sampler.RECORDS).parquet(p)
            out = t if out is None else out.unionByName(t)
        out = out.select(*[F.col(c).cast(k).alias(c) for c, k in fields.items()])
        out = out if param is None else out.where(F.col("param") == param)
        return out if thinning == 1.0 else thin(out, thinning)

    def write_block(self, block: int, rows: DataFrame) -> None:
        """Records and states of run_chains as a block that doesn't count yet."""
        rows.where("state is null").drop("state").write.mode("overwrite").partitionBy("param").parquet(f"{self.path}/records/{block}")
        rows.where("state is not null").select("chain", "state").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/states/{block}")

    def commit(self, block: int, done: int, minutes: float) -> None:
        """Makes a written block count; a block that counts already is an error, as another application must have written it."""
        fs, at = self._fs(f"{self.path}/commits/{block}.json")
        if fs.exists(at):
            raise RuntimeError(f"block {block} is committed already")
        _, new = self._fs(f"{self.path}/commits/{block}.new")
        stream = fs.create(new, True)
        stream.write(bytearray(json.dumps({"block": block, "done": done, "minutes": minutes}).encode()))
        stream.close()
        if not fs.rename(new, at):
            raise RuntimeError(f"block {block} can't be committed")
        if block > 0:  # only the last states are needed
            remove(self.spark, f"{self.path}/states/{block - 1}")


def durable_run(spark: SparkSession, data: sampler.Data, store: RunStore, chains: int, until: int, every: int = 100, seed: int = 1, **how) -> Progress:
    """Runs chains up to iteration `until`, a committed block every so many iterations, from where the store stands.

    A chain's next block follows from its state, the seed and the iteration alone, so a run that was stopped at any point and started again
    gives the records that it would have given, as long as its blocks end at the same iterations.
    """
    at = store.progress()
    while at.done < until:
        began = time.time()
        n = min(every - at.done % every, until - at.done)
        block = len(at.blocks)
        store.write_block(block, cut(sampler.run_chains(spark, data, chains, n, at.states, seed=seed, start=at.done, **how)))
        minutes = (at.checkpoints[-1][1] if at.checkpoints else 0.0) + (time.time() - began) / 60
        store.commit(block, at.done + n, minutes)
        at = store.progress()
    return at
