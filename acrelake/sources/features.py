"""Paged feature services as a data source, read at once or as a stream.

An area is read page after page, areas are dealt to tasks. Filters that the service knows go to it, and Spark looks at all of them
again. A stream takes what is new by the service's growing object ids; its pages may be kept in a shared store, where a restart finds
them instead of asking again.
"""

from __future__ import annotations

import hashlib
import json
import math
import time
import urllib.error
import urllib.parse
import urllib.request
import uuid
from collections.abc import Iterable, Iterator

import pyarrow.fs
from pyspark.sql import datasource as ds
from pyspark.sql.types import StructType

#: Waits before the second and third try, in seconds, and the longest wait a server may ask for.
WAITS = (1.0, 2.0)
LONGEST_WAIT = 10.0
_COLUMNS = "area string, attributes map<string, string>, geometry string"


class Areas(ds.InputPartition):
    """Areas (name, box, least object id, greatest one) that one task reads; ids are None where all are read."""

    def __init__(self, areas: list[tuple]) -> None:
        self.areas = areas


class FeatureService(ds.DataSource):
    """Options: url; areas, a JSON object of name to [x0, y0, x1, y1]; where; orderby; page (records per request, 1000); tasks (at most so
    many read at a time, one for each area); interval (seconds from one request of a task to its next, 0), so a host gets tasks / interval
    requests a second at most; pushdown (true sends filters to the service, which needs ``spark.sql.python.filterPushdown.enabled``); for streams
    id (name of the growing object id, OBJECTID) and cache (folder of a shared store for pages as they came).

    The columns are area, attributes and geometry. A schema of the reader's own may name attributes as further columns of strings, whole and
    floating numbers, to which filters apply. A failed task runs again from its first page.
    """

    @classmethod
    def name(cls) -> str:
        return "feature_service"

    def schema(self) -> str:
        return _COLUMNS

    def reader(self, schema: StructType) -> ds.DataSourceReader:
        pushes = self.options.get("pushdown", "false").lower() == "true"
        return (PushingReader if pushes else FeatureReader)(dict(self.options), schema)

    def streamReader(self, schema: StructType) -> ds.DataSourceStreamReader:  # noqa: N802
        return FeatureStream(dict(self.options), schema)


class _Requests:
    def __init__(self, options: dict[str, str], schema: StructType) -> None:
        self.url, self.where, self.order = options["url"], options.get("where", "1=1"), options.get("orderby", "")
        self.areas, self.page = json.loads(options["areas"]), int(options.get("page", 1000))
        self.tasks, self.interval = int(options.get("tasks", len(self.areas) or 1)), float(options.get("interval", 0))
        self.id, self.cache = options.get("id", "OBJECTID"), options.get("cache")
        self.fields = [(f.name, f.dataType.simpleString()) for f in schema.fields]

    def dealt(self, areas: list[tuple]) -> list[Areas]:
        return [Areas(areas[i :: self.tasks]) for i in range(min(self.tasks, len(areas)))]

    def pages(self, partition: Areas) -> Iterator[tuple[str, list[dict]]]:
        """The features of each page of the areas in turn."""
        began = -math.inf
        for name, box, low, high in partition.areas:
            offset = 0
            while True:
                url = f"{self.url}?{urllib.parse.urlencode(self.query(box, offset, low, high))}"
                page = kept(self.cache, url) if self.cache else None
                if page is None:
                    time.sleep(max(0.0, began + self.interval - time.monotonic()) if self.interval else 0)
                    began = time.monotonic()
                    page = fetch(url)
                    if self.cache:
                        keep(self.cache, url, page)
                features = page.get("features") or []
                yield name, features
                if last(page, len(features), self.page):
                    break
                offset += self.page

    def rows(self, partition: Areas) -> Iterator[tuple]:
        casts = {"bigint": int, "int": int, "double": float, "float": float}
        for area, features in self.pages(partition):
            for f in features:
                own = f.get("attributes") or {}
                known = {"area": area, "geometry": json.dumps(f["geometry"]) if f.get("geometry") else None, "attributes": {k: None if v is None else str(v) for k, v in own.items()}}
                yield tuple(known[n] if n in known else None if own.get(n) is None else casts.get(kind, str)(own[n]) for n, kind in self.fields)

    def query(self, box: list[float], offset: int, low: int | None = None, high: int | None = None) -> dict[str, object]:
        where, order = self.where, self.order
        if high is not None:
            where, order = f"({where}) AND {self.id} > {low} AND {self.id} <= {high}", self.id
        out = {"f": "json", "where": where, "geometry": ",".join(map(str, box)), "geometryType": "esriGeometryEnvelope", "spatialRel": "esriSpatialRelIntersects"}
        out |= {"inSR": 4326, "outSR": 4326, "outFields": "*", "returnGeometry": "true", "resultOffset": offset, "resultRecordCount": self.page}
        return out | ({"orderByFields": order} if order else {})


class FeatureReader(_Requests, ds.DataSourceReader):
    def partitions(self) -> list[Areas]:
        return self.dealt([(name, box, None, None) for name, box in self.areas.items()])

    def read(self, partition: Areas) -> Iterator[tuple]:
        return self.rows(partition)


class PushingReader(FeatureReader):
    """Sends filters of attributes to the service and drops areas that a filter rules out. All filters go back to Spark as well, as the
    service may compare texts in its own way."""

    def pushFilters(self, filters: list[ds.Filter]) -> Iterable[ds.Filter]:  # noqa: N802
        for f in filters:
            if f.__class__ in (ds.EqualTo, ds.In) and f.attribute == ("area",):
                names = {f.value} if isinstance(f, ds.EqualTo) else set(f.value)
                self.areas = {k: v for k, v in self.areas.items() if k in names}
            elif said := clause(f, {n for n, _ in self.fields} - {"area", "attributes", "geometry"}):
                self.where = f"{self.where} AND {said}" if self.where != "1=1" else said
            yield f


_SIGNS = {ds.EqualTo: "=", ds.GreaterThan: ">", ds.GreaterThanOrEqual: ">=", ds.LessThan: "<", ds.LessThanOrEqual: "<="}


def clause(f: ds.Filter, names: set[str]) -> str | None:
    """A filter of one attribute as the service says it; None if it doesn't."""
    if len(f.attribute) != 1 or f.attribute[0] not in names:
        return None
    name = f.attribute[0]
    if type(f) in _SIGNS:
        return (v := _literal(f.value)) and f"{name} {_SIGNS[type(f)]} {v}"
    if isinstance(f, ds.In):
        values = [_literal(v) for v in f.value]
        return f"{name} IN ({', '.join(values)})" if values and all(values) else None
    if isinstance(f, (ds.IsNull, ds.IsNotNull)):
        return f"{name} IS {'NOT ' * isinstance(f, ds.IsNotNull)}NULL"
    return None


def _literal(v: object) -> str | None:
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    return repr(v) if isinstance(v, (int, float)) and not isinstance(v, bool) and math.isfinite(v) else None


class FeatureStream(_Requests, ds.DataSourceStreamReader):
    """An offset has the greatest object id of each area that was read."""

    def initialOffset(self) -> dict:  # noqa: N802
        return {name: -1 for name in self.areas}

    def latestOffset(self) -> dict:  # noqa: N802
        stats = json.dumps([{"statisticType": "max", "onStatisticField": self.id, "outStatisticFieldName": "top"}])
        out = {}
        for name, box in self.areas.items():
            page = fetch(f"{self.url}?{urllib.parse.urlencode(self.query(box, 0) | {'outStatistics': stats})}")
            top = [f["attributes"].get("top") for f in page.get("features") or []]
            out[name] = int(top[0]) if top and top[0] is not None else -1
        return out

    def partitions(self, start: dict, end: dict) -> list[Areas]:
        """A row removed from the service may lower its greatest id; then there is nothing new."""
        return self.dealt([(name, box, start.get(name, -1), end.get(name, -1)) for name, box in self.areas.items() if end.get(name, -1) > start.get(name, -1)])

    def read(self, partition: Areas) -> Iterator[tuple]:
        return self.rows(partition)

    def commit(self, end: dict) -> None:
        pass


def _page_file(cache: str, url: str) -> tuple[pyarrow.fs.FileSystem, str]:
    store, path = pyarrow.fs.FileSystem.from_uri(cache) if "://" in cache else (pyarrow.fs.LocalFileSystem(), cache)
    return store, f"{path.rstrip('/')}/{hashlib.sha256(url.encode()).hexdigest()}.json"


def kept(cache: str, url: str) -> dict | None:
    store, path = _page_file(cache, url)
    if store.get_file_info(path).type == pyarrow.fs.FileType.NotFound:
        return None
    with store.open_input_stream(path) as f:
        return json.loads(f.read())


def keep(cache: str, url: str, page: dict) -> None:
    """Under a name of its own first, so no reader finds half a page."""
    store, path = _page_file(cache, url)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}"
    with store.open_output_stream(part) as f:
        f.write(json.dumps(page).encode())
    store.move(part, path)


def last(page: dict, found: int, size: int) -> bool:
    """An empty page ends the area, and so does a service that says so; where it says nothing, a short page does."""
    more = page.get("exceededTransferLimit")
    return found == 0 or more is False or (more is None and found < size)


def fetch(url: str) -> dict:
    """One page. Server errors, timeouts and 429 are tried again; other client errors and error bodies raise at once."""
    for turn in range(len(WAITS) + 1):
        wait = WAITS[turn] if turn < len(WAITS) else None
        try:
            with urllib.request.urlopen(url, timeout=60) as reply:
                page = json.load(reply)
            if "error" in page:
                raise ValueError(f"the service answered {page['error']}")
            return page
        except urllib.error.HTTPError as e:
            if wait is None or (e.code < 500 and e.code != 429):
                raise
            asked = e.headers.get("Retry-After", "")
            wait = min(float(asked), LONGEST_WAIT) if asked.isdigit() else wait
        except (urllib.error.URLError, TimeoutError):
            if wait is None:
                raise
        time.sleep(wait)
    raise AssertionError


def drift(mapped: set[str], layer: set[str]) -> set[str]:
    """Mapped fields that the layer lacks."""
    return mapped - layer
