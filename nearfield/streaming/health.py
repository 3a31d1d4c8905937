"""Health of each core from its snapshots: smoothed load with hysteresis, as a batch and as a stream."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame

STATES = ("healthy", "degraded", "throttled")
ALPHA, COOLDOWN = 0.3, 3
# Fixed values: (state before, after, p99 by the limit, inflight); worse ones are entered above, better ones below.
WORSE = ((0, 2, 1.5, 0.85), (0, 1, 1.0, 0.7), (1, 2, 1.5, 0.85))
BETTER = ((2, 1, 0.8, 0.6), (1, 0, 0.6, 0.5))


@dataclass
class Health:
    """Smoothed values (0 is unset: the next value is taken as it is), the state, and windows before it may improve."""

    p99: float = 0.0
    inflight: float = 0.0
    state: int = 0
    cooldown: int = 0

    def update(self, p99: float, inflight: float, limit: float) -> None:
        smooth = lambda old, new: new if old == 0.0 else ALPHA * new + (1 - ALPHA) * old
        self.p99, self.inflight = smooth(self.p99, p99), smooth(self.inflight, inflight)
        self.cooldown = max(0, self.cooldown - 1)
        if limit <= 0:
            return
        for before, after, a, b in WORSE:
            if self.state == before and self.p99 > a * limit and self.inflight > b:
                self.state, self.cooldown = after, COOLDOWN
                return
        for before, after, a, b in BETTER:
            if self.state == before and not self.cooldown and self.p99 < a * limit and self.inflight < b:
                self.state = after
                return


OUT = "core long, snap long, ewma_p99 double, ewma_inflight double, health string, cooldown int"
STATE = "p99 double, inflight double, state int, cooldown int"


def _run(health: Health, rows: pd.DataFrame, limit: float) -> pd.DataFrame:
    out = []
    for core, snap, p99, inflight in rows.sort_values("snap")[["core", "snap", "p99", "inflight"]].itertuples(index=False):
        health.update(float(p99), float(inflight), limit)
        out.append((core, snap, health.p99, health.inflight, STATES[health.state], health.cooldown))
    return pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])


def health_batch(snaps: DataFrame, limit: float) -> DataFrame:
    """snaps(core, snap, p99, inflight) -> each snapshot with the smoothed values and the state after it."""
    return snaps.select("core", "snap", "p99", "inflight").groupBy("core").applyInPandas(lambda g: _run(Health(), g, limit), OUT)


def health_stream(snaps: DataFrame, limit: float) -> DataFrame:
    """The same over a stream; a core's snapshots must arrive in order of snap. State is four numbers a core."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:  # noqa: ANN001
        health = Health(*state.get) if state.exists else Health()
        rows = pd.concat(list(batches))
        out = _run(health, rows, limit)
        state.update((health.p99, health.inflight, health.state, health.cooldown))
        yield out

    return snaps.select("core", "snap", "p99", "inflight").groupBy("core").applyInPandasWithState(step, OUT, STATE, "append", "NoTimeout")
