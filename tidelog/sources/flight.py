"""Scans and SQL over Arrow Flight: an optional service in front of a catalogue.

A command is a scan ticket (guards.ScanTicket) or {"sql": "SELECT ..."} as canonical
JSON. Tokens, scope and grants are checked before anything is planned; schemas are
answered from the plan, without running it. Results pass through the driver, so their
rows are bounded, and a larger result is refused.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pyarrow.flight as flight
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema

from tidelog.errors import InvalidState, TidelogError
from tidelog.operators.guards import ScanTicket, check_scope, check_token
from tidelog.operators.scan import Catalog, Predicate
from tidelog.plans import sqlapi

MAX_ROWS = 1_000_000
_ERRORS = {"unauthenticated": flight.FlightUnauthenticatedError, "permission_denied": flight.FlightUnauthorizedError}


class _Headers(flight.ServerMiddleware):
    def __init__(self, headers: dict):
        self.headers = headers


class _HeadersFactory(flight.ServerMiddlewareFactory):
    def start_call(self, info, headers) -> _Headers:
        return _Headers({k.lower(): v[0] for k, v in headers.items()})


class ScanServer(flight.FlightServerBase):
    """Serves `catalog`; with `executions` also the SQL surface over that read model.

    `tokens` are the bearer tokens accepted (all callers if None), `scope` a tenant and
    namespace that tickets must stay in. The header x-principal names who is asking;
    with `need_grant` it must be granted the table.
    """

    def __init__(self, location: str, catalog: Catalog, executions: Callable[[], DataFrame] | None = None, tokens: set[str] | None = None, scope: tuple[str, str | None] | None = None, need_grant: bool = False, max_rows: int = MAX_ROWS):
        super().__init__(location, middleware={"headers": _HeadersFactory()})
        self.catalog, self.executions, self.tokens, self.scope, self.need_grant, self.max_rows = catalog, executions, tokens, scope, need_grant, max_rows

    def _plan(self, context, command: bytes) -> DataFrame:
        try:
            headers = context.get_middleware("headers").headers
            if self.tokens is not None:
                check_token(headers.get("authorization"), self.tokens)
            try:
                body = json.loads(command)
            except ValueError as e:
                raise InvalidState(f"not a command: {e}") from e
            if isinstance(body, dict) and set(body) == {"sql"}:
                if self.executions is None:
                    raise InvalidState("there is no SQL surface here")
                return sqlapi.run_sql(self.executions(), body["sql"])
            t = ScanTicket.decode(command)
            if self.scope is not None:
                check_scope(*self.scope, t.tenant, t.namespace)
            predicate = None if t.column is None else Predicate(t.column, t.value)
            principal = headers.get("x-principal", "") if self.need_grant else None
            return self.catalog.scan(t.tenant, t.namespace, t.table, predicate, t.projection, principal)
        except TidelogError as e:
            raise _ERRORS.get(e.status, flight.FlightServerError)(f"{e.status}: {e}") from e

    def get_schema(self, context, descriptor) -> flight.SchemaResult:
        return flight.SchemaResult(to_arrow_schema(self._plan(context, descriptor.command).schema))

    def get_flight_info(self, context, descriptor) -> flight.FlightInfo:
        schema = to_arrow_schema(self._plan(context, descriptor.command).schema)
        return flight.FlightInfo(schema, descriptor, [flight.FlightEndpoint(descriptor.command, [])], -1, -1)

    def do_get(self, context, ticket) -> flight.RecordBatchStream:
        table = self._plan(context, ticket.ticket).limit(self.max_rows + 1).toArrow()
        if table.num_rows > self.max_rows:
            raise flight.FlightServerError(f"resource_exhausted: the result has more than {self.max_rows} rows")
        return flight.RecordBatchStream(table)
