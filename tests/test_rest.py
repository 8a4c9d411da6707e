"""The REST data source against a stub server on this machine."""

import base64
import datetime as dt
import json
import threading
import urllib.parse
from decimal import Decimal
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, LongType, StringType

from heddle.sources.rest import Operation, converted, ranges, read_rest

ROWS = [{"orderId": i if i % 50 else None, "who": {"name": f"c{i % 7}"}, "amount": f"{i}.25", "open": i % 2 == 0, "day": f"2024-01-{i % 28 + 1:02d}", "at": f"2024-01-01T00:00:{i % 60:02d}Z", "tags": ["a", "b"][: i % 3], "extra": {"n": i}} for i in range(1, 501)]
FIELDS = [
    {"name": "id", "type": "bigint", "from": "orderId"},
    {"name": "customer", "type": "string", "from": "who.name"},
    {"name": "amount", "type": "decimal(10,2)"},
    {"name": "open", "type": "boolean"},
    {"name": "day", "type": "date"},
    {"name": "at", "type": "timestamp"},
    {"name": "tags", "type": "array<string>"},
    {"name": "extra", "type": "string"},
    {"name": "lost", "type": "double"},
]
LIST = {
    "path": "/v1/{region}/orders",
    "fields": FIELDS,
    "items": "data.items",
    "more": "hasMore",
    "total": "totalResults",
    "offset": "offset",
    "limit": "limit",
    "query": {"kind": "{kind}"},
    "headers": {"X-Tenant": "{tenant}"},
    "filters": {"id": {">=": "idFrom", "<": "idTo", "<=": "idUpTo", "=": "id", "null": "idMissing"}, "customer": {"=": "customer", "in": "customers"}, "day": {">=": "dayFrom", "<": "dayTo"}},
}
MANIFEST = {"resources": {"shop": {"operations": {"list": LIST, "whole": {"path": "/v1/all", "fields": FIELDS[:2]}, "wrong": {"path": "/v1/all", "fields": [{"name": "id", "type": "bigint", "from": "who"}]}}}}}


class Stub(BaseHTTPRequestHandler):
    seen: list = []
    failures: dict = {}
    tokens: list = []

    def log_message(self, *_):
        pass

    def _send(self, value, code=200):
        body = json.dumps(value).encode()
        self.send_response(code)
        self.send_header("Content-Length", str(len(body)))
        self.end_headers()
        self.wfile.write(body)

    def do_POST(self):
        form = self.rfile.read(int(self.headers["Content-Length"])).decode()
        assert "grant_type=client_credentials" in form
        self.tokens.append(f"t{len(self.tokens)}")
        self._send({"access_token": self.tokens[-1]})

    def do_GET(self):
        url = urllib.parse.urlsplit(self.path)
        q = dict(urllib.parse.parse_qsl(url.query))
        self.seen.append((url.path, q, dict(self.headers)))
        if self.failures.get(url.path, 0) > 0:
            self.failures[url.path] -= 1
            return self._send({}, 503)
        if self.headers.get("Authorization", "").startswith("Bearer") and self.headers["Authorization"] == "Bearer t0" and self.failures.get("expired"):
            return self._send({}, 401)
        if url.path == "/v1/all":
            return self._send(ROWS[:5])
        if url.path != "/v1/eu%20west/orders":
            return self._send({}, 404)
        keep = [r for r in ROWS if ("idMissing" in q) == (r["orderId"] is None) or not {"idFrom", "idTo", "idMissing"} & set(q)]
        rules = {"idFrom": lambda r, v: r["orderId"] is not None and r["orderId"] >= int(v), "idTo": lambda r, v: r["orderId"] is not None and r["orderId"] < int(v), "idUpTo": lambda r, v: r["orderId"] is not None and r["orderId"] <= int(v), "customer": lambda r, v: r["who"]["name"] == v, "customers": lambda r, v: r["who"]["name"] in v.split(","), "dayFrom": lambda r, v: r["day"] >= v, "dayTo": lambda r, v: r["day"] < v}
        for name, rule in rules.items():
            if name in q:
                keep = [r for r in keep if rule(r, q[name])]
        at, n = int(q["offset"]), int(q["limit"])
        return self._send({"data": {"items": keep[at : at + n]}, "hasMore": at + n < len(keep), "totalResults": len(keep)})


@pytest.fixture(scope="module")
def url():
    server = ThreadingHTTPServer(("127.0.0.1", 0), Stub)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


@pytest.fixture(autouse=True)
def fresh():
    Stub.seen.clear()
    Stub.failures.clear()
    Stub.tokens.clear()


@pytest.fixture
def source(spark, url, tmp_path):
    (tmp_path / "manifest.json").write_text(json.dumps(MANIFEST))

    def read(api="list", **options):
        return read_rest(spark, f"file://{tmp_path}/manifest.json", base_url=url, schema="shop", api=api, derived={"region": "eu west", "kind": "all", "Tenant": "t&1"}, **options)

    return read


def expected():
    return sorted((r["orderId"] or 0, r["who"]["name"], Decimal(r["amount"])) for r in ROWS)


def got(df):
    return sorted((r.id or 0, r.customer, r.amount) for r in df.collect())


def test_schema_and_values(source):
    df = source(fetch_size=64)
    assert df.schema.simpleString() == "struct<id:bigint,customer:string,amount:decimal(10,2),open:boolean,day:date,at:timestamp,tags:array<string>,extra:string,lost:double>"
    assert got(df) == expected()
    row = df.where("id = 4").first()
    assert (row.open, row.day, row.tags, row.extra, row.lost) == (True, dt.date(2024, 1, 5), ["a"], '{"n": 4}', None)
    assert df.where("id = 4").select(F.date_format("at", "ss")).first()[0] == "04"
    path, q, headers = Stub.seen[0]
    assert path == "/v1/eu%20west/orders" and q["kind"] == "all" and headers["X-Tenant"] == "t&1" and q["limit"] == "64"


def test_a_range_a_task(source):
    df = source(partition_column="id", partition_lower=1, partition_upper=501, partition_num=4, fetch_size=50)
    assert df.rdd.getNumPartitions() == 5  # four ranges and the rows without an id
    Stub.seen.clear()
    assert got(df) == expected()
    asked = {(q.get("idFrom"), q.get("idTo"), q.get("idMissing")) for _, q, _ in Stub.seen}
    assert asked == {(None, "126", None), ("126", "251", None), ("251", "376", None), ("376", None, None), (None, None, "true")}


def test_ranges_of_dates_and_offsets(source):
    days = source(partition_column="day", partition_lower="2024-01-01", partition_upper="2024-01-29", partition_num=3)
    assert days.rdd.getNumPartitions() == 3 and got(days) == expected()
    offsets = source(partition_num=7, fetch_size=30)
    assert offsets.rdd.getNumPartitions() == 7
    assert got(offsets) == expected()


def test_filters_are_sent_and_tested_again(source):
    df = source(partition_column="id", partition_lower=1, partition_upper=501, partition_num=2)
    Stub.seen.clear()
    found = df.where("id >= 100 and id <= 300 and customer in ('c1', 'c2') and amount > 150").select("id").collect()
    assert sorted(r.id for r in found) == [r["orderId"] for r in ROWS if r["orderId"] and 100 <= r["orderId"] <= 300 and r["who"]["name"] in ("c1", "c2") and r["orderId"] >= 150]
    asked = {(q.get("idFrom"), q.get("idTo"), q.get("idUpTo"), q.get("customers")) for _, q, _ in Stub.seen}
    assert ("100", "251", "300", "c1,c2") in asked and ("251", None, "300", "c1,c2") in asked  # the tighter of bound and filter
    assert not any("amount" in str(q) for _, q, _ in Stub.seen)  # the service does not know it
    plan = df.where("id >= 100")._jdf.queryExecution().executedPlan().toString()
    assert "Filter" in plan


def test_sign_in(source, url):
    assert source("whole", auth_type="basic", user_name="u", password="p:w").count() == 5
    assert Stub.seen[-1][2]["Authorization"] == "Basic " + base64.b64encode(b"u:p:w").decode()
    Stub.failures["expired"] = 1  # the first token has run out by the time it is used
    oauth = {"auth_type": "oauth2", "oauth_access_token_url": f"{url}/token", "oauth_client": "c", "oauth_client_secret": "s"}
    assert source("whole", **oauth).count() == 5
    assert Stub.seen[-1][2]["Authorization"] == "Bearer t1" and len(Stub.tokens) == 2
    assert source("whole", auth_type="oauth2", auth_header="X-Auth", oauth_header_prefix="Token", oauth_client_auth_type="body", **{k: v for k, v in oauth.items() if k != "auth_type"}).count() == 5
    assert Stub.seen[-1][2]["X-Auth"].startswith("Token t")


def test_failures(source):
    Stub.failures["/v1/eu%20west/orders"] = 2
    assert source().count() == 500
    with pytest.raises(Exception, match="field 'id'"):
        source("wrong").collect()
    with pytest.raises(Exception, match="no 'nothing'"):
        source("nothing")
    with pytest.raises(Exception, match="no parameters"):
        source(partition_column="customer", partition_lower="a", partition_upper="b", partition_num=2).collect()


def test_derived_property_is_needed():
    with pytest.raises(ValueError, match=r"derived.property.region"):
        Operation.of(MANIFEST, "shop", "list", {"kind": "x", "TENANT": "t"})


def test_ranges_and_conversions():
    assert ranges("0", "10", 2, LongType()) == [(("<", 5),), ((">=", 5),)]
    assert ranges("0", "2", 9, LongType()) == [(("<", 1),), ((">=", 1),)]
    assert ranges("2024-01-01", "2024-01-03", 1, DateType()) == [()]
    with pytest.raises(ValueError):
        ranges("a", "b", 2, StringType())
    assert converted("12", LongType()) == 12 and converted(1.0, LongType()) == 1 and converted({"a": 1}, StringType()) == '{"a": 1}'
    with pytest.raises(ValueError):
        converted("1.5", LongType())
