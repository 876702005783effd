"""The search component: flags, plugins, events, a request in, an envelope out (RET32, SNK4, LIM2, FLT9, UDF1, STM6, STM7, RNK12)."""

from __future__ import annotations

import json
import time
from collections import OrderedDict
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import learn as L
from . import engine, roles
from .engine import Flags
from .hints import asked_of


HOOKS = ("before_search", "after_search", "before_render", "on_feedback", "on_error")


@dataclass
class Plugins:
    """DataFrame -> DataFrame functions by hook, in the order they were added; a plugin that fails is passed over and reported."""

    hooks: dict[str, list[tuple[str, Callable]]] = field(default_factory=lambda: {h: [] for h in HOOKS})
    errors: list[tuple[str, str]] = field(default_factory=list)

    def register(self, manifest: dict, functions: dict[str, Callable]) -> None:
        missing = [k for k in ("name", "version") if not manifest.get(k)]
        unknown = [h for h in functions if h not in HOOKS]
        if missing or unknown:
            raise ValueError(f"manifest lacks {missing}, unknown hooks {unknown}")
        for hook, f in functions.items():
            self.hooks[hook].append((manifest["name"], f))

    def run(self, hook: str, value):
        for name, f in self.hooks[hook]:
            try:
                value = f(value)
            except Exception as e:  # noqa: BLE001  a plugin's failure must not end the search
                self.errors.append((name, str(e)))
        return value


class Bus:
    """Listeners by event."""

    def __init__(self) -> None:
        self._by: dict[str, list[Callable]] = {}

    def on(self, event: str, f: Callable) -> Callable[[], None]:
        self._by.setdefault(event, []).append(f)
        return lambda: self._by[event].remove(f)

    def emit(self, event: str, value) -> None:
        for f in list(self._by.get(event, ())):
            f(value)


class Snapshot:
    """The personal tables last read, for ``ttl`` seconds; once they are stale there are none, and the engine's order stands."""

    def __init__(self, ttl: float = 30.0, clock: Callable[[], float] = time.monotonic) -> None:
        self._ttl, self._clock, self._held = ttl, clock, None

    def put(self, frames: dict[str, DataFrame]) -> None:
        self._held = self._clock(), frames

    def get(self) -> dict[str, DataFrame] | None:
        return self._held[1] if self._held and self._clock() - self._held[0] <= self._ttl else None


def clamp_limit(limit: int | None, default: int = 12, most: int = 100) -> int:
    return default if limit is None else max(1, min(most, int(limit)))


@dataclass(frozen=True)
class Response:
    ok: bool
    request: str
    items: tuple = ()
    total: int = 0
    mode: str = ""
    error: dict | None = None
    elapsed_ms: float = 0.0
    api_version: str = "1"

    def as_json(self) -> str:
        body = {"ok": self.ok, "apiVersion": self.api_version, "request": self.request, "elapsedMs": round(self.elapsed_ms, 3)}
        return json.dumps(body | ({"data": {"items": list(self.items), "total": self.total, "mode": self.mode}} if self.ok else {"error": self.error}), ensure_ascii=False)

    def as_compact(self) -> str:
        return "|".join(f"{i['app_id']}:{i['score']}" for i in self.items)

    def as_text(self) -> str:
        return "\n".join(f"{n}. {i['name']} ({i['score']})" for n, i in enumerate(self.items, 1)) if self.ok else f"error: {self.error['code']}"


class Search:
    """A catalogue to search. One query at a time is served from a small cache; many at once are one plan (:meth:`batch`)."""

    def __init__(self, spark: SparkSession, apps: DataFrame, flags: Flags = Flags(), plugins: Plugins | None = None, ttl: float = 300.0, entries: int = 64, clock: Callable[[], float] = time.monotonic) -> None:
        self.spark, self.flags, self.plugins, self.bus = spark, flags, plugins or Plugins(), Bus()
        self._ttl, self._entries, self._clock = ttl, entries, clock
        self._cache: OrderedDict[tuple, tuple[float, Response]] = OrderedDict()
        self.hits = self.misses = 0
        self.selections: DataFrame | None = None
        #: tables of :func:`lodestar.plans.engine.search`, by name, each a function of the queries
        self.tables: dict[str, Callable[[DataFrame], DataFrame]] = {}
        self.set_apps(apps)

    def set_apps(self, apps: DataFrame) -> None:
        """Replace the catalogue; what was cached of the old one goes."""
        self.apps = apps
        self._cache.clear()

    def batch(self, queries: DataFrame, k: int = 30) -> DataFrame:
        """Hits of many queries (query_id, q), named."""
        asked = self.plugins.run("before_search", queries)
        q = asked.select("query_id", X.sanitize(F.col("q")).alias("q")).where("q is not null")
        try:
            hits = engine.search(q, self.apps, self.flags, k=k, **{name: make(q) for name, make in self.tables.items()})
        except Exception as e:
            self.plugins.run("on_error", e)
            raise
        named = asked_of(hits).join(self.apps.select("app_id", "name"), "app_id")
        return self.plugins.run("after_search", named)

    def record_selection(self, selections: DataFrame) -> None:
        """Remember selections (query, app, rank, ts, part, kind) and let the plugins see them; what was cached goes, as orders may change."""
        seen = self.plugins.run("on_feedback", selections)
        self.selections = seen if self.selections is None else L.record(self.selections, seen)
        self._cache.clear()
        self.bus.emit("selection", seen)

    def personal(self) -> DataFrame:
        """Affinities by the selections so far (LRN1 to LRN4)."""
        if self.selections is None:
            return self.spark.createDataFrame([], L.AFFINITY)
        return L.affinities(self.selections)

    def query(self, text: str, limit: int | None = None) -> Response:
        began, k = self._clock(), clamp_limit(limit)
        key = (text, k)
        if key in self._cache and self._clock() - self._cache[key][0] < self._ttl:
            self._cache.move_to_end(key)
            self.hits += 1
            return self._cache[key][1]
        self.misses += 1
        frame = roles.queries_frame(self.spark, [text])
        reason = frame.select(X.sanitize_reason(F.col("q"))).head()[0]
        if reason:
            response = Response(False, text, error={"code": "INVALID_QUERY", "message": reason}, elapsed_ms=1000 * (self._clock() - began))
            self.bus.emit("error", response)
            return response
        shown = self.plugins.run("before_render", self.batch(frame, k))
        rows = shown.orderBy("rank").limit(k).collect()
        items = tuple({"app_id": r["app_id"], "name": r["name"], "score": r["score"]} for r in rows)
        first = rows[0] if rows else None
        mode = "none" if first is None else engine.SOURCES[first["source"]] if first["tier"] is None else ("exact", "prefix", "fuzzy")[first["tier"]]
        response = Response(True, text, items, len(items), mode, elapsed_ms=1000 * (self._clock() - began))
        self._cache[key] = (self._clock(), response)
        while len(self._cache) > self._entries:
            self._cache.popitem(last=False)
        self.bus.emit("query", response)
        return response
