"""Feature extractors by name, and recordings as lazy tables with a ledger of finished steps."""

from __future__ import annotations

import difflib
import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


@dataclass(frozen=True)
class Extractor:
    """A feature: a function of tables to a table, with what it needs and what it returns."""

    name: str
    version: str
    inputs: tuple[str, ...]
    shape: StructType | str
    run: Callable[..., DataFrame]

    @property
    def schema(self) -> StructType:
        """What ``run`` returns; a schema given as text is parsed by the session, so only when there is one."""
        return self.shape if isinstance(self.shape, StructType) else StructType.fromDDL(self.shape)

    def missing(self, tables: dict[str, DataFrame]) -> list[str]:
        """Inputs (``table`` or ``table.column``) that the tables don't have."""
        out = []
        for need in self.inputs:
            name, _, col = need.partition(".")
            if name not in tables or col and col not in tables[name].columns:
                out.append(need)
        return out


class Registry:
    def __init__(self) -> None:
        self._by_name: dict[str, Extractor] = {}

    def register(self, name: str, inputs: tuple[str, ...], schema: str | StructType, version: str = "1") -> Callable:
        """A decorator. A name can be taken once."""
        if name in self._by_name:
            raise ValueError(f"{name!r} is registered already")

        def add(run: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
            self._by_name[name] = Extractor(name, version, tuple(inputs), schema, run)
            return run

        return add

    def get(self, name: str) -> Extractor:
        if name not in self._by_name:
            near = difflib.get_close_matches(name, self._by_name, 3)
            raise KeyError(f"no extractor {name!r}" + (f"; near: {', '.join(near)}" if near else ""))
        return self._by_name[name]

    def names(self) -> list[str]:
        return sorted(self._by_name)

    def metadata(self) -> list[dict]:
        return [{"name": e.name, "version": e.version, "inputs": list(e.inputs), "schema": e.schema.simpleString()} for e in map(self.get, self.names())]

    def __contains__(self, name: str) -> bool:
        return name in self._by_name

    def clear(self) -> None:
        self._by_name.clear()


def config_hash(config: dict) -> str:
    """The first 16 hexadecimal digits of the SHA-256 of the sorted, compact JSON."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:16]


@dataclass
class Session:
    """Lazy tables of recordings and the steps done on them. Nothing runs until ``save``."""

    tables: dict[str, DataFrame] = field(default_factory=dict)
    steps: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)

    def put(self, name: str, df: DataFrame, keys: list[str] | None = None) -> None:
        """Set a table, or with ``keys`` replace the rows of the same keys and add the others."""
        old = self.tables.get(name)
        if old is not None and keys:
            df = old.join(df.select(*keys).distinct(), keys, "left_anti").unionByName(df, allowMissingColumns=True)
        self.tables[name] = df

    def step(self, name: str, run: Callable[[Session], None]) -> bool:
        """Run a step once; False if it was done before."""
        if name in self.steps:
            return False
        run(self)
        self.steps.append(name)
        return True

    def extract(self, registry: Registry, names: list[str]) -> None:
        """Run extractors; one that lacks inputs is a warning, not an end."""
        for n in names:
            e = registry.get(n)
            lacking = e.missing(self.tables)
            if lacking:
                self.warnings.append(f"{n}: missing {', '.join(lacking)}")
            else:
                self.put(f"feature_{n}", e.run(**{i.partition(".")[0]: self.tables[i.partition(".")[0]] for i in e.inputs}))

    def save(self, path: str, overwrite: bool = False) -> None:
        for n, df in self.tables.items():
            df.write.mode("overwrite" if overwrite else "errorifexists").parquet(f"{path}/{n}")
        if self.tables:
            spark = next(iter(self.tables.values())).sparkSession
            rows = [("table", i, n) for i, n in enumerate(self.tables)] + [("step", i, n) for i, n in enumerate(self.steps)] + [("warning", i, n) for i, n in enumerate(self.warnings)]
            spark.createDataFrame(rows, "kind string, i int, name string").coalesce(1).write.mode("overwrite" if overwrite else "errorifexists").parquet(f"{path}/_ledger")

    def checkpoint(self, folder: str, name: str | None = None) -> str:
        """A snapshot under ``folder``, by name or by the last step; the session goes on unchanged. An older one of the name is replaced."""
        path = f"{folder.rstrip('/')}/{name or (self.steps[-1] if self.steps else 'start')}"
        self.save(path, overwrite=True)
        return path

    def ensure_saved(self, path: str) -> str:
        """Save unless ``path`` holds a session with the same steps already; where it is now."""
        from spikeloom.sources.writers import exists

        spark = next(iter(self.tables.values())).sparkSession if self.tables else SparkSession.getActiveSession()
        if not (exists(spark, f"{path}/_ledger") and Session.load(spark, path, []).steps == self.steps):
            self.save(path, overwrite=True)
        return path

    @classmethod
    def load(cls, spark: SparkSession, path: str, tables: list[str] | None = None) -> Session:
        """A saved session, its tables lazy; ``tables`` picks some of them."""
        rows = sorted(spark.read.parquet(f"{path}/_ledger").collect(), key=lambda r: r.i)
        names = [r.name for r in rows if r.kind == "table" and (tables is None or r.name in tables)]
        return cls({n: spark.read.parquet(f"{path}/{n}") for n in names}, [r.name for r in rows if r.kind == "step"], [r.name for r in rows if r.kind == "warning"])
