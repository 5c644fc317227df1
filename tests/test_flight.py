from __future__ import annotations

import json

import pytest

flight = pytest.importorskip("pyarrow.flight")

from tidelog.operators.guards import ScanTicket  # noqa: E402
from tidelog.operators.scan import Catalog  # noqa: E402
from tidelog.plans.catalogue import executions  # noqa: E402
from tidelog.sources.flight import ScanServer  # noqa: E402


@pytest.fixture(scope="module")
def client(spark, sf, tmp_path_factory):
    c = Catalog(spark, f"file://{tmp_path_factory.mktemp('catalogue')}")
    rows = spark.createDataFrame([("e1", 1), ("e2", 2), ("e3", 2)], "id string, attempt long")
    c.write(rows, "acme", "ops", "runs", "s1", "alice")
    c.write(rows, "other", "ops", "runs", "s1", "alice")
    c.grant("acme", "ops", "runs", "alice")
    with ScanServer("grpc://127.0.0.1:0", c, lambda: executions(spark, sf), {"s3"}, ("acme", None), True, max_rows=100) as server, flight.connect(f"grpc://127.0.0.1:{server.port}") as connection:
        yield connection


def options(token="s3", principal="alice"):
    return flight.FlightCallOptions(headers=[(b"authorization", f"Bearer {token}".encode()), (b"x-principal", principal.encode())])


def sql(text):
    return json.dumps({"sql": text}).encode()


def test_scan(client):
    ticket = ScanTicket("acme", "ops", "runs", ("id",), "attempt", 2).encode()
    info = client.get_flight_info(flight.FlightDescriptor.for_command(ticket), options())
    assert info.schema.names == ["id"] and client.get_schema(flight.FlightDescriptor.for_command(ticket), options()).schema == info.schema
    assert sorted(client.do_get(info.endpoints[0].ticket, options()).read_all().column("id").to_pylist()) == ["e2", "e3"]


def test_sql(client):
    got = client.do_get(flight.Ticket(sql("SELECT execution_id, status FROM executions LIMIT 5")), options()).read_all()
    assert got.num_rows == 5 and got.schema.names == ["execution_id", "status"]


@pytest.mark.parametrize(
    ("command", "who", "error", "reason"),
    [
        (ScanTicket("acme", "ops", "runs").encode(), {"token": "no"}, "FlightUnauthenticatedError", "unauthenticated"),
        (ScanTicket("acme", "ops", "runs").encode(), {"principal": "bob"}, "FlightUnauthorizedError", "permission_denied"),
        (ScanTicket("other", "ops", "runs").encode(), {}, "FlightUnauthorizedError", "permission_denied"),
        (ScanTicket("acme", "ops", "runs", ("nope",)).encode(), {}, "FlightServerError", "failed_precondition"),
        (sql("SELECT nope FROM executions"), {}, "FlightServerError", "invalid_argument"),
        (b"{", {}, "FlightServerError", "failed_precondition"),
    ],
)
def test_refusals(client, command, who, error, reason):
    with pytest.raises(getattr(flight, error), match=reason):
        client.do_get(flight.Ticket(command), options(**who)).read_all()
