"""Counters of samples and loads, and their text exposition."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

from pyspark.sql import functions as F

from hopweave.operators.sampling import Sample


@dataclass(frozen=True)
class SamplingStats:
    batches: int
    nodes: int
    edges: int


@dataclass(frozen=True)
class PrefetchStats:
    hits: int = 0
    misses: int = 0

    @property
    def hit_rate(self) -> float:
        """1 when nothing was asked for."""
        total = self.hits + self.misses
        return self.hits / total if total else 1.0


@dataclass(frozen=True)
class Snapshot:
    """Whatever sections there are; the others are left out of the text."""

    sections: dict[str, object] = field(default_factory=dict)

    def to_prometheus(self, prefix: str = "hopweave") -> str:
        out = []
        for section, stats in self.sections.items():
            if stats is None:
                continue
            values = asdict(stats) | ({"hit_rate": stats.hit_rate} if isinstance(stats, PrefetchStats) else {})
            for name, value in values.items():
                kind = "gauge" if isinstance(value, float) else "counter"
                out += [f"# TYPE {prefix}_{section}_{name} {kind}", f"{prefix}_{section}_{name} {value}"]
        return "".join(f"{line}\n" for line in out)


def sampling_stats(sampled: Sample) -> SamplingStats:
    n = sampled.nodes.agg(F.count_distinct("batch").alias("b"), F.count("*").alias("n")).head()
    return SamplingStats(n["b"], n["n"], sampled.edges.count())
