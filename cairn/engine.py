"""A thin facade: authorized reads that return DataFrames and page cursors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn import cursor as K
from cairn.operators import access as A
from cairn.operators import events as E
from cairn.operators import search as S
from cairn.operators import temporal as T


class Denied(PermissionError):
    """The request is outside what policy and grants admit."""


class Engine:
    """Reads over an events frame and a grants frame; scope always comes first."""

    def __init__(self, events: DataFrame, grants: DataFrame | None = None):
        self.events, self.grants = events, grants

    def scopes(self, request: A.Request, kind: str | None) -> list[A.Scope]:
        """What policy and the grants that cover ``kind`` admit; without a kind, scopes name their own."""
        grants = A.collect_grants(self.grants, request.requester, kind) if self.grants is not None and request.requester else []
        allowed, scopes = A.compose(request, grants, kind)
        if not allowed:
            raise Denied("denied")
        return scopes

    def query_events(self, request: A.Request, limit: int | None = None, cursor: str | None = None, look_ahead: bool = False, **filters) -> DataFrame:
        """A page of events; with ``look_ahead`` one row more, which tells whether another page follows."""
        limit = K.check_limit(limit)
        after = K.decode(cursor, E.ORDER, limit, self._print(request, filters)) if cursor else None
        return E.query(self.events, limit, after, A.any_of(self.scopes(request, "event")), look_ahead, **filters)

    def page_of_events(self, request: A.Request, limit: int | None = None, cursor: str | None = None, **filters) -> tuple[list, str | None]:
        """A collected page, of at most 500 rows, and the cursor behind it if more rows follow."""
        size = K.check_limit(limit)
        seen = self.query_events(request, limit, cursor, look_ahead=True, **filters).collect()
        return seen[:size], self.next_cursor(request, seen[:size], limit, **filters) if len(seen) > size else None

    def next_cursor(self, request: A.Request, page: list, limit: int | None = None, **filters) -> str | None:
        """The cursor behind a collected page, or None behind the last one."""
        limit = K.check_limit(limit)
        return K.encode([page[-1][c] for c in E.ORDER], E.ORDER, limit, self._print(request, filters)) if len(page) >= limit else None

    def search(self, request: A.Request, text: str, limit: int | None = None, **filters) -> DataFrame:
        rows = E.visible(self.events.where(E.condition(**filters)).where(A.any_of(self.scopes(request, "event"))), E.deleted_ids(self.events))
        hits = S.with_fallback(rows, "eid", ["content"], text).withColumnRenamed("id", "eid")
        return rows.join(hits, "eid").orderBy(*E.ORDER).limit(K.check_limit(limit))

    def get_event(self, request: A.Request, eid: str) -> DataFrame:
        return E.visible(self.events, E.deleted_ids(self.events)).where(F.col("eid") == eid).where(A.any_of(self.scopes(request, "event")))

    def get_trace(self, request: A.Request, trace_id: str) -> DataFrame:
        """A trace in order, or nothing if any of it is hidden."""
        rows = E.visible(self.events.where(F.col("trace_id") == trace_id), E.deleted_ids(self.events))
        return A.whole_or_nothing(rows, "trace_id", self.scopes(request, "trace")).orderBy(*E.ORDER)

    def related(self, request: A.Request, relations: DataFrame, eid: str) -> DataFrame:
        """Relations of an event, or nothing if the event or any other end of them is hidden."""
        visible = A.secured(E.visible(self.events, E.deleted_ids(self.events)), self.scopes(request, "relation")).select("eid")
        own = relations.where((F.col("from_id") == eid) | (F.col("to_id") == eid))
        return A.whole_relations(own, self.events.where(F.col("eid") == eid), visible).select(*relations.columns)

    def parent(self, request: A.Request, relations: DataFrame, eid: str) -> DataFrame:
        return self.related(request, relations.where("relation = 'child_of'").where(F.col("from_id") == eid), eid)

    def children(self, request: A.Request, relations: DataFrame, eid: str) -> DataFrame:
        return self.related(request, relations.where("relation = 'child_of'").where(F.col("to_id") == eid), eid)

    def records(self, request: A.Request, records: DataFrame, kind: str, order: list[str], limit: int | None = None, **filters) -> DataFrame:
        """Records of one resource type in a total order: scope, filters, then the page, checked once more."""
        scopes = self.scopes(request, kind)
        rows = A.secured_records(records, scopes)
        for name, value in filters.items():
            if name not in records.columns:
                raise ValueError(f"no field {name!r}")
            rows = rows.where(F.col(name) == value)
        return A.validated(rows.orderBy(*order).limit(K.check_limit(limit)), scopes)

    def facts(self, request: A.Request, facts: DataFrame, owners: DataFrame, dimension: str, when: str) -> DataFrame:
        """Times of resources in scope, known at or holding at an instant."""
        return A.secured_facts(facts, owners, self.scopes(request, None)).where(T.as_of(dimension, when))

    def corpus(self, request: A.Request, units: DataFrame, text: str = "", metadata: dict | None = None, limit: int = 100) -> DataFrame:
        return S.retrieve_corpus(units, A.scope_triples(self.scopes(request, "corpus_unit")), text, metadata, limit)

    @staticmethod
    def _print(request: A.Request, filters: dict) -> str:
        return K.fingerprint(filters, request=[request.operation, request.requester, list(request.profiles), list(request.projects), list(request.spaces), request.include_global, request.isolated])
