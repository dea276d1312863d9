"""The scalar filter as a table function, for SQL over partitioned tables."""

from __future__ import annotations

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf


@udtf(returnType="id bigint, t bigint, z double, p double")
class KalmanStates:
    """Filtered state and variance after each row (id, t, v) of a partition, in the order of its rows; a null v is missing.

    A partition's rows stream by: its state is two numbers.
    """

    def __init__(self) -> None:
        self.z: float | None = None
        self.p = 0.0

    def eval(self, rho: float, state_var: float, noise: float, row: Row):
        rho, state_var, noise = float(rho), float(state_var), float(noise)
        if self.z is None:
            self.z, self.p = 0.0, state_var / max(1 - rho * rho, 1e-6)
        else:
            self.z, self.p = rho * self.z, rho * rho * self.p + state_var
        if row["v"] is not None:
            gain = self.p / (self.p + noise)
            self.z, self.p = self.z + gain * (row["v"] - self.z), (1 - gain) * self.p
        yield row["id"], row["t"], self.z, self.p


def register(spark: SparkSession, name: str = "kalman_states") -> None:
    """Make the function known to SQL: ``SELECT * FROM kalman_states(0.8D, 0.2D, 0.5D, TABLE(rows) PARTITION BY series ORDER BY t)``."""
    spark.udtf.register(name, KalmanStates)
