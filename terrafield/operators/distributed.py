"""Chains over observations that stay on the cluster.

The kernels of operators.sampler ask three things of the observations: sums per location, the weighted normal equations, and
the noise potential with its gradient. Each is one aggregation here, with map-side combining: a pass over the rows, a shuffle of
a row per location and task at most. The driver holds arrays of the locations' size, never of the observations'.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrafield.operators import sampler

#: Locations whose arrays the driver may hold.
MAX_LOCATIONS = 2_000_000


@dataclass
class ObservationTable(sampler.Data):
    """Data whose observations are a table (loc, z, response columns, noise columns), loc from 0.

    x and x_noise stay None but for the number of columns; x_locs, x_range and x_scale are per location as ever.
    """

    table: DataFrame = None
    response: list[str] = field(default_factory=list)
    noise: list[str] = field(default_factory=list)
    _kept: tuple = None
    _gram: np.ndarray = None

    @classmethod
    def of(cls, table: DataFrame, xy, parents, x_locs, loc_columns, x_range, x_scale, response, noise, **more) -> ObservationTable:
        if len(xy) > MAX_LOCATIONS:
            raise ValueError(f"more than {MAX_LOCATIONS} locations")
        table = table.select(F.col("loc").cast("long").alias("loc"), F.col("z").cast("double").alias("z"), *dict.fromkeys([*response, *noise])).persist()
        none = np.empty(0)
        x = np.empty((0, len(response)))
        return cls(xy, parents, none, none, x, x_locs, loc_columns, x_range, x_scale, np.empty((0, len(noise))), table=table, response=response, noise=noise, **more)

    def _dot(self, names, beta) -> Column:
        return sum((F.col(n) * F.lit(float(b)) for n, b in zip(names, np.ravel(beta))), F.lit(0.0))

    def _with_field(self, s: sampler.State) -> DataFrame:
        """The table with the field: one double a location, joined by Spark's own choice of strategy."""
        w = self.table.sparkSession.createDataFrame(pd.DataFrame({"loc": np.arange(len(s.field)), "field": s.field}))
        return self.table.join(w, "loc")

    def least_squares(self):
        p = len(self.response)
        pairs = [(i, j) for i in range(p) for j in range(i, p)]
        c = [F.col(n) for n in self.response]
        one = self.table.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("z") * F.col("z")).alias("zz"), *[F.sum(c[i] * c[j]).alias(f"g{i}_{j}") for i, j in pairs], *[F.sum(c[i] * F.col("z")).alias(f"v{i}") for i in range(p)]).first()
        g, v = self._symmetric(one, p, pairs), np.array([one[f"v{i}"] for i in range(p)])
        b = np.linalg.solve(g, v)
        return g, b, float(max(1e-300, one.zz - b @ v) / max(1, one.n - p))

    @staticmethod
    def _symmetric(row, p, pairs):
        g = np.zeros((p, p))
        for i, j in pairs:
            g[i, j] = g[j, i] = row[f"g{i}_{j}"]
        return g

    def noise_gram(self):
        if self._gram is None:
            p = len(self.noise)
            pairs = [(i, j) for i in range(p) for j in range(i, p)]
            one = self.table.agg(*[F.sum(F.col(self.noise[i]) * F.col(self.noise[j])).alias(f"g{i}_{j}") for i, j in pairs]).first()
            self._gram = self._symmetric(one, p, pairs)
        return self._gram

    def stats(self, s: sampler.State):
        key = (s.beta.tobytes(), s.noise_beta.tobytes())
        if self._kept and self._kept[0] == key:  # several kernels ask at one state
            return self._kept[1]
        w = F.exp(-self._dot(self.noise, s.noise_beta))
        e = F.col("z") - self._dot(self.response, s.beta)
        got = self.table.groupBy("loc").agg(F.sum(w).alias("s0"), F.sum(w * e).alias("s1"), F.sum(w * e * e).alias("s2")).toPandas()
        out = np.zeros((3, len(self.xy)))
        out[:, got["loc"].to_numpy()] = got[["s0", "s1", "s2"]].to_numpy().T
        self._kept = (key, tuple(out))
        return self._kept[1]

    def beta_system(self, s: sampler.State):
        p = len(self.response)
        pairs = [(i, j) for i in range(p) for j in range(i, p)]
        w = F.exp(-self._dot(self.noise, s.noise_beta))
        r = F.col("z") - F.col("field")
        c = [F.col(n) for n in self.response]
        one = self._with_field(s).agg(*[F.sum(w * c[i] * c[j]).alias(f"g{i}_{j}") for i, j in pairs], *[F.sum(w * c[i] * r).alias(f"v{i}") for i in range(p)]).first()
        return self._symmetric(one, p, pairs), np.array([one[f"v{i}"] for i in range(p)])

    def noise_terms(self, s: sampler.State, beta: np.ndarray):
        log_tau = self._dot(self.noise, beta)
        r = F.col("z") - F.col("field") - self._dot(self.response, s.beta)
        q = r * r * F.exp(-log_tau)
        one = self._with_field(s).agg(F.sum(log_tau).alias("l"), F.sum(q).alias("q"), *[F.sum(F.col(n) * (0.5 - 0.5 * q)).alias(f"g{i}") for i, n in enumerate(self.noise)]).first()
        return float(one.l), float(one.q), np.array([[one[f"g{i}"]] for i in range(len(self.noise))])
