"""What a view is asked for, and where its fields come from."""

from __future__ import annotations

from dataclasses import dataclass, field, fields as dataclass_fields

from pyspark.sql import Column, DataFrame, functions as F

from runledger.sizing import quoted

TIME_SERIES, SCALE_VIEW = "time-series", "scale-view"

# Canonical fields, fixed by the project configuration format.
CANONICAL = (
    "result.duration",
    "result.returncode",
    "git.datetime",
    "git.commit",
    "git.branch",
    "problem.test",
    "problem.case",
    "problem.subcase",
    "problem.cpu",
    "problem.size",
    "problem.per.cpu",
    "problem.scale",
)


class NoSeriesError(ValueError):
    """No chart series is enabled."""


class EmptyResultError(LookupError):
    """The filters leave no reports."""


@dataclass(frozen=True)
class ChartOptions:
    """Options of a chart view; the defaults are those of a request without options."""

    mode: str = TIME_SERIES
    show_mean: bool = True
    show_median: bool = False
    show_boxplot: bool = False
    show_ci: bool = False
    show_stdbar: bool = False
    show_errorbar: bool = False
    squeeze: int = 1
    interval: float = 0.025
    digits: int = 2
    split_charts_by: tuple[str, ...] = ()
    filters: dict = field(default_factory=dict)
    time_range: tuple[int, int] | None = None

    @classmethod
    def dashboard(cls, **changes) -> ChartOptions:
        """What the dashboard sends before anything is toggled."""
        return cls(**{"show_mean": False, "show_median": True, "show_ci": True, "show_errorbar": True, **changes})

    @classmethod
    def from_request(cls, request: dict) -> ChartOptions:
        """Options out of a request with ``show-…`` switches, mode, squeeze, range, filters and groups."""
        switches = {
            f.name: bool(request[f.name.replace("_", "-")])
            for f in dataclass_fields(cls)
            if f.name.startswith("show_") and f.name.replace("_", "-") in request
        }
        span = request.get("range") or {}
        return cls(
            mode=request.get("mode", {}).get("mode", TIME_SERIES),
            squeeze=int(request.get("squeeze", {}).get("value", 1)),
            time_range=(int(span["from"]), int(span["to"])) if "from" in span and "to" in span else None,
            filters=dict(request.get("filters", {})),
            split_charts_by=tuple(k for k, on in request.get("groupby", {}).items() if on),
            **switches,
        )

    @property
    def metric(self) -> str:
        return "median" if self.show_median else "mean"

    def metrics(self) -> tuple[str, ...]:
        """The metrics the enabled series need, in a fixed order."""
        needed: set[str] = set()
        for on, names in (
            (self.show_mean, ("mean",)),
            (self.show_median, ("median",)),
            (self.show_errorbar, (self.metric,)),
            (self.show_ci, ("mean", "ci")),
            (self.show_stdbar, ("mean", "std")),
            (self.show_boxplot, ("min", "p25", "p50", "p75", "max")),
        ):
            if on:
                needed.update(names)
        if not needed:
            raise NoSeriesError("enable at least one chart series")
        return tuple(m for m in ("mean", "median", "min", "max", "std", "p25", "p50", "p75", "ci") if m in needed)


@dataclass(frozen=True)
class FieldMapping:
    """Canonical fields of a project: a source path, or ``=`` and a SQL expression over the report."""

    fields: dict[str, str | None]
    extra: tuple[str, ...] = ()
    group_names: dict[str, str] = field(default_factory=dict)

    def __post_init__(self):
        unknown = set(self.fields) - set(CANONICAL)
        if unknown:
            raise ValueError(f"not canonical fields: {sorted(unknown)}")

    def has(self, name: str) -> bool:
        return bool(self.fields.get(name))

    def column(self, name: str) -> Column:
        source = self.fields[name]
        if source.startswith("="):
            return F.expr(source[1:].strip())
        return F.col(".".join(quoted(p) for p in source.split(".")))

    def apply(self, df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
        """The canonical columns, the extra ones, and those to keep; Catalyst prunes everything else."""
        derived = [self.column(n).alias(n) for n in CANONICAL if self.has(n)]
        extra = [F.col(".".join(quoted(p) for p in e.split("."))).alias(e) for e in self.extra]
        return df.select(*[F.col(quoted(k)) for k in keep], *derived, *extra)
