"""Driver-side guards: bearer tokens, scope, roles, tickets and bounded requests."""

from __future__ import annotations

import hmac
import json
from dataclasses import asdict, dataclass

from tidelog.errors import InvalidState, PermissionDenied, Unauthenticated
from tidelog.functions.scalars import check_identifier

CAPABILITIES = ("control_plane", "catalog_read", "catalog_write", "transaction_append", "stream_append", "stream_consume", "object_read", "object_write", "retrieval_read", "retrieval_write", "replication_plan", "system_library_resolve")
_DATA = frozenset(CAPABILITIES[1:])
ROLES = {"gateway": frozenset(CAPABILITIES[:1]), "api": frozenset(CAPABILITIES[:1]), "worker": _DATA, "playbook": _DATA, "system": frozenset(CAPABILITIES)}
MAX_TICKET_BYTES = 16_384


def require(role: str, capability: str) -> None:
    if role not in ROLES or capability not in ROLES[role]:
        raise PermissionDenied(f"role {role} has no {capability}")


def check_token(header: str | None, tokens: set[str]) -> None:
    """A bearer token that is among those known, compared in constant time."""
    scheme, _, token = (header or "").partition(" ")
    if scheme.lower() != "bearer" or not any(hmac.compare_digest(token.encode(), t.encode()) for t in tokens):
        raise Unauthenticated("a valid bearer token is required")


def check_scope(allowed_tenant: str, allowed_namespace: str | None, tenant: str, namespace: str) -> None:
    if tenant != allowed_tenant or allowed_namespace not in (None, namespace):
        raise PermissionDenied(f"{tenant}.{namespace} is outside the caller's scope")


@dataclass(frozen=True)
class ScanTicket:
    """A scan request as canonical JSON: sorted keys, no blanks, a version."""

    tenant: str
    namespace: str
    table: str
    projection: tuple[str, ...] | None = None
    column: str | None = None
    value: str | int | None = None
    version: int = 1

    def encode(self) -> bytes:
        return json.dumps(asdict(self), sort_keys=True, separators=(",", ":")).encode()

    @classmethod
    def decode(cls, raw: bytes) -> "ScanTicket":
        if len(raw) > MAX_TICKET_BYTES:
            raise InvalidState("the ticket is too long")
        try:
            body = json.loads(raw)
            ticket = cls(**(body | {"projection": None if body.get("projection") is None else tuple(body["projection"])}))
        except (ValueError, TypeError, AttributeError) as e:
            raise InvalidState(f"not a ticket: {e}") from e
        if ticket.version != 1:
            raise InvalidState(f"ticket version {ticket.version} is not known")
        for name in (ticket.tenant, ticket.namespace, ticket.table):
            check_identifier(name)
        if ticket.encode() != raw:
            raise InvalidState("the ticket is not in canonical form")
        return ticket
