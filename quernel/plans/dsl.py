"""The JSON query language: parsing and checks."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from ..functions.geo import Point, parse_point, parse_polygon


class QueryError(ValueError):
    """A request that cannot be answered as it stands."""


@dataclass(frozen=True)
class Term:
    field: str
    value: Any


@dataclass(frozen=True)
class Match:
    field: str
    text: str


@dataclass(frozen=True)
class Range:
    field: str
    low: float | None = None
    high: float | None = None
    low_open: bool = False
    high_open: bool = False


@dataclass(frozen=True)
class GeoDistance:
    field: str
    centre: Point
    km: float


@dataclass(frozen=True)
class GeoPolygon:
    field: str
    vertices: tuple[Point, ...]
    exact: bool = False


@dataclass(frozen=True)
class Bool:
    must: tuple = ()
    should: tuple = ()
    must_not: tuple = ()


@dataclass(frozen=True)
class Request:
    query: Any
    fields: tuple[str, ...] = ()
    sort: str = "relevance"  # relevance, none, asc, desc, distance
    sort_field: str | None = None
    page: int = 1
    size: int = 10
    offset: int | None = None
    everything: bool = False
    after: tuple[Any, Any] | None = None
    options: dict = field(default_factory=dict)


def _one(body: Any, what: str) -> tuple[str, Any]:
    if not isinstance(body, dict) or not body:
        raise QueryError(f"{what} takes an object with a field")
    return next(iter(body.items()))


def _number(x: Any) -> float:
    if isinstance(x, bool) or not isinstance(x, (int, float)):
        raise QueryError(f"a range bound is a number, not {x!r}")
    return x


def parse_query(body: Any, nested: bool = True) -> Any:
    """The first known key of `body` says what it is."""
    if not isinstance(body, dict):
        raise QueryError("a query is an object")
    for kind in ("match", "term", "geo_distance", "geo_polygon", "range", "bool"):
        if kind in body:
            break
    else:
        raise QueryError(f"no query in {sorted(body)}")
    inner = body[kind]
    try:
        if kind == "match":
            name, text = _one(inner, kind)
            return Match(name, str(text))
        if kind == "term":
            return Term(*_one(inner, kind))
        if kind == "range":
            name, b = _one(inner, kind)
            if not isinstance(b, dict) or not b or set(b) - {"gt", "gte", "lt", "lte"}:
                raise QueryError("a range has gt, gte, lt or lte")
            low = next((_number(b[k]) for k in ("gte", "gt") if k in b), None)
            high = next((_number(b[k]) for k in ("lte", "lt") if k in b), None)
            return Range(name, low, high, "gte" not in b and "gt" in b, "lte" not in b and "lt" in b)
        if kind == "geo_distance":
            rest = {k: v for k, v in inner.items() if k != "distance"}
            name, at = _one(rest, kind)
            return GeoDistance(name, parse_point(at), float(inner.get("distance", 2.0)))
        if kind == "geo_polygon":
            name, b = _one(inner, kind)
            return GeoPolygon(name, tuple(parse_polygon(b["points"])), bool(b.get("exact", False)))
    except (TypeError, KeyError, AttributeError) as e:
        raise QueryError(f"{kind}: {e}") from e
    if not nested:
        raise QueryError("bool clauses do not nest")
    lists = {}
    for part in ("must", "should", "must_not"):
        clauses = inner.get(part, [])
        lists[part] = tuple(parse_query(c, nested=False) for c in (clauses if isinstance(clauses, list) else [clauses]) if c)
    if not any(lists.values()):
        raise QueryError("bool has no clause")
    return Bool(**lists)


SORTS = {1: "relevance", 3: "none", 4: "asc", 5: "desc", 6: "distance"}


def parse(request: dict) -> Request:
    """A whole request. `from` is a page number and `size` a page's size, as aliases; `offset` counts rows."""
    if "query" not in request:
        raise QueryError("a request has a query")
    sort, by = SORTS.get(request.get("sort_type", 1)), request.get("sort_field")
    if sort is None:
        raise QueryError(f"no sort_type {request['sort_type']}")
    if request.get("sort"):
        name, how = _one(request["sort"][0], "sort")
        sort, by = str(how["order"] if isinstance(how, dict) else how), name
        if sort not in ("asc", "desc"):
            raise QueryError(f"no order {sort}")
    page = int(request.get("page_index", request.get("from", 1)))
    size = int(request.get("page_size", request.get("size", 10)))
    if page < 1 or size < 1:
        raise QueryError("pages and their sizes start at 1")
    after = None
    if "last_id" in request or "last_score" in request:
        if sort not in ("asc", "desc") or "last_id" not in request or "last_score" not in request:
            raise QueryError("last_id and last_score come together, with an order by a field")
        after = (request["last_score"], request["last_id"])
    if sort in ("asc", "desc") and not by:
        raise QueryError("an order by a field names it")
    names = tuple(x.strip() for x in request.get("fields", "").split(",") if x.strip())
    return Request(parse_query(request["query"]), names, sort, by, page, size, request.get("offset"), bool(request.get("return_all")), after, {k: request[k] for k in ("synonyms",) if k in request})
