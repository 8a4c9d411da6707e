"""Tables of web services: a data source whose manifest says what an operation's rows are and how it pages, filters and signs in.

A manifest is JSON: {"resources": {name: {"operations": {name: operation}}}}. An operation has

- path, which may hold {names} of derived properties, as may the values of query and headers;
- fields: a list of {name, type, from}: the type is Spark's, `from` a dotted path into an item, the name where it is left out;
- items (dotted path to the list in an answer; the answer itself where left out), more (path to whether more follow), total (path to
  the number of all rows), offset and limit (names of those parameters; without an offset all comes at once);
- filters: {column: {operator: parameter}}, operators =, <, <=, >, >=, in, starts and null.

A read is dealt into requests of its own for each task: ranges of a column that the service can compare, or ranges of offsets where
it tells the total. Filters of a query that the service knows are sent along and tested again by Spark, which may compare otherwise.
"""

from __future__ import annotations

import base64
import datetime as dt
import http.client
import json
import re
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass, field
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, BooleanType, DataType, DateType, DecimalType, DoubleType, FloatType, IntegerType, LongType, MapType, ShortType, StringType, StructType, TimestampType

_COMPARED = {ds.EqualTo: "=", ds.LessThan: "<", ds.LessThanOrEqual: "<=", ds.GreaterThan: ">", ds.GreaterThanOrEqual: ">=", ds.In: "in", ds.StringStartsWith: "starts"}
_AGAIN = (408, 429, 500, 502, 503, 504)


def at_path(value, path: str | None):
    """What a dotted path leads to, None where a step is missing."""
    for step in path.split(".") if path else ():
        value = value.get(step) if isinstance(value, dict) else None
    return value


def converted(value, kind: DataType):
    """A value of JSON as one of a type; what does not fit raises ValueError."""
    if value is None:
        return None
    if isinstance(kind, StringType):
        return value if isinstance(value, str) else json.dumps(value)
    if isinstance(kind, ArrayType):
        return [converted(x, kind.elementType) for x in value]
    if isinstance(kind, MapType):
        return [(k, converted(x, kind.valueType)) for k, x in value.items()]
    if isinstance(kind, StructType):
        return {f.name: converted(value.get(f.name), f.dataType) for f in kind}
    if isinstance(kind, BooleanType):
        if str(value).lower() not in ("true", "false"):
            raise ValueError(f"{value!r} is not a boolean")
        return str(value).lower() == "true"
    if isinstance(kind, (LongType, IntegerType, ShortType)):
        if Decimal(str(value)) % 1:
            raise ValueError(f"{value!r} is not a whole number")
        return int(Decimal(str(value)))
    if isinstance(kind, (DoubleType, FloatType)):
        return float(value)
    if isinstance(kind, DecimalType):
        return Decimal(str(value))
    if isinstance(kind, TimestampType):
        at = dt.datetime.fromisoformat(value)
        return at if at.tzinfo else at.replace(tzinfo=dt.timezone.utc)
    if isinstance(kind, DateType):
        return dt.date.fromisoformat(value[:10])
    raise ValueError(f"no conversion to {kind.simpleString()}")


@dataclass
class Operation:
    """An operation of a manifest with the derived properties filled in."""

    path: str
    fields: list[dict]
    items: str | None = None
    more: str | None = None
    total: str | None = None
    offset: str | None = None
    limit: str | None = None
    query: dict = field(default_factory=dict)
    headers: dict = field(default_factory=dict)
    filters: dict = field(default_factory=dict)

    @classmethod
    def of(cls, manifest: dict, resource: str, name: str, derived: dict[str, str]) -> Operation:
        try:
            told = manifest["resources"][resource]["operations"][name]
        except KeyError as e:
            raise ValueError(f"the manifest has no {e.args[0]!r} on the way to resource {resource!r}, operation {name!r}") from None
        known = {k.lower(): v for k, v in derived.items()}

        def filled(text: str, quoted: bool = False) -> str:
            def value(m: re.Match) -> str:
                if m[1].lower() not in known:
                    raise ValueError(f"operation {name!r} needs option derived.property.{m[1]}")
                found = known[m[1].lower()]
                return urllib.parse.quote(found, safe="") if quoted else found

            return re.sub(r"\{(\w+)\}", value, text)

        parts = {part: {k: filled(str(v)) for k, v in told.get(part, {}).items()} for part in ("query", "headers")}
        return cls(**{**told, **parts, "path": filled(told["path"], True)})

    def schema(self) -> str:
        """As DDL: a data source's schema is asked for where no session is."""
        return ", ".join(f"`{f['name']}` {f['type']}" for f in self.fields)


@dataclass
class Share(ds.InputPartition):
    """One task's part: bounds of a column, or offsets from and up to."""

    bounds: tuple = ()
    start: int = 0
    stop: int | None = None

    def __post_init__(self):
        super().__init__(None)


def ranges(lower: str, upper: str, num: int, kind: DataType) -> list[tuple]:
    """Bounds (operator, value) of so many ranges; the first and the last are open, so that nothing lies outside."""
    if isinstance(kind, DateType):
        a, b = (dt.date.fromisoformat(x).toordinal() for x in (lower, upper))
        back = lambda x: dt.date.fromordinal(x).isoformat()
    elif isinstance(kind, (LongType, IntegerType, ShortType)):
        a, b, back = int(lower), int(upper), int
    else:
        raise ValueError(f"ranges need whole numbers or dates, not {kind.simpleString()}")
    if b <= a:
        raise ValueError("partition.upper must be over partition.lower")
    cuts = sorted({a + (b - a) * k // num for k in range(1, num)} - {a})
    ends = [None, *cuts, None]
    return [tuple(x for x in ((">=", back(lo)) if lo is not None else None, ("<", back(hi)) if hi is not None else None) if x) for lo, hi in zip(ends, ends[1:])]


class RestReader(ds.DataSourceReader):
    def __init__(self, options: dict[str, str], operation: Operation, schema: StructType):
        self.options, self.operation, self.schema, self.filters = options, operation, schema, []
        self.size = int(options.get("fetch.size", 500))
        if self.size < 1:
            raise ValueError("fetch.size must be 1 or more")

    def pushFilters(self, filters):
        for f in filters:
            column = getattr(f, "attribute", ("",))[0]
            op = "null" if isinstance(f, ds.IsNull) else _COMPARED.get(type(f))
            if op and len(f.attribute) == 1 and op in self.operation.filters.get(column, {}):
                self.filters.append((column, op, True if op == "null" else list(f.value) if op == "in" else f.value))
            yield f  # tested again

    def partitions(self) -> list[Share]:
        o, num = self.options, int(self.options.get("partition.num", 1))
        if column := o.get("partition.column"):
            known = self.operation.filters.get(column, {})
            if not {">=", "<"} <= set(known):
                raise ValueError(f"the manifest tells no parameters for >= and < of {column!r}")
            shares = [Share(bounds=tuple((column, op, v) for op, v in r)) for r in ranges(o["partition.lower"], o["partition.upper"], num, self.schema[column].dataType)]
            return shares + ([Share(bounds=((column, "null", True),))] if "null" in known and len(shares) > 1 else [])
        if num > 1 and self.operation.total and self.operation.offset:
            n = int(at_path(self._get({**self._told(()), **self._page(0, 1)}), self.operation.total) or 0)
            step = max(1, -(-n // num))
            starts = list(range(0, n, step)) or [0]
            return [Share(start=s, stop=s + step if s != starts[-1] else None) for s in starts]
        return [Share()]

    def read(self, share: Share) -> Iterator[pa.RecordBatch]:
        told, at = self._told(share.bounds), share.start
        kinds = [(f, self.schema[f["name"]].dataType) for f in self.operation.fields if f["name"] in self.schema.names]
        names, types = [f["name"] for f, _ in kinds], [to_arrow_type(k) for _, k in kinds]
        while share.stop is None or at < share.stop:
            size = self.size if share.stop is None else min(self.size, share.stop - at)
            answer = self._get({**told, **self._page(at, size)})
            items = at_path(answer, self.operation.items) or []
            if items:
                yield pa.RecordBatch.from_arrays([pa.array([self._cell(x, f, k) for x in items], t) for (f, k), t in zip(kinds, types)], names=names)
            at += len(items)
            if not items or not self.operation.offset or (self.operation.more and not at_path(answer, self.operation.more)) or (not self.operation.more and len(items) < size):
                return

    def _cell(self, item: dict, told: dict, kind: DataType):
        try:
            return converted(at_path(item, told.get("from", told["name"])), kind)
        except (ValueError, ArithmeticError, TypeError, AttributeError) as e:
            raise ValueError(f"field {told['name']!r}: {e}") from e

    def _page(self, at: int, size: int) -> dict:
        return {k: v for k, v in ((self.operation.offset, at), (self.operation.limit, size)) if k}

    def _told(self, bounds: tuple) -> dict:
        """Parameters of the operation, of the filters and of a share's bounds; of two bounds of a kind the tighter."""
        out, taken = dict(self.operation.query), {}
        for column, op, value in [*bounds, *self.filters]:
            name = self.operation.filters[column][op]
            value = value.isoformat() if isinstance(value, (dt.date, dt.datetime)) else value
            if name in taken and op in ("<", "<=", ">", ">="):
                value = (min if op[0] == "<" else max)(value, taken[name])
            elif name in taken:
                continue
            taken[name] = value
        return out | {k: ",".join(map(str, v)) if isinstance(v, list) else str(v).lower() if isinstance(v, bool) else str(v) for k, v in taken.items()}

    def _get(self, query: dict):
        url = self.options["base.url"].rstrip("/") + self.operation.path + ("?" + urllib.parse.urlencode(query) if query else "")
        token_tried = False
        for attempt in range(5):
            try:
                request = urllib.request.Request(url, headers={"Accept": "application/json", **self.operation.headers, **self._auth()})
                with urllib.request.urlopen(request, timeout=float(self.options.get("timeout.seconds", 60))) as got:
                    return json.load(got)
            except urllib.error.HTTPError as e:
                if e.code == 401 and self.__dict__.pop("_token", None) and not token_tried:  # run out: once more with a new one
                    token_tried = True
                    continue
                if e.code not in _AGAIN or attempt == 4:
                    raise RuntimeError(f"{url.split('?')[0]} answered {e.code}") from None
                wait = e.headers.get("Retry-After", "")
                time.sleep(min(30.0, float(wait) if wait.isdigit() else 0.2 * 2**attempt))
            except (OSError, http.client.HTTPException):
                if attempt == 4:
                    raise
                time.sleep(0.2 * 2**attempt)

    def _auth(self) -> dict[str, str]:
        o, kind = self.options, self.options.get("auth.type", "no.auth")
        header = o.get("auth.header", "Authorization")
        if kind == "no.auth":
            return {}
        if kind == "basic":
            return {header: "Basic " + base64.b64encode(f"{o['user.name']}:{o['password']}".encode()).decode()}
        if kind != "oauth2":
            raise ValueError(f"auth.type {kind!r} is none of basic, no.auth, oauth2")
        if "_token" not in self.__dict__:
            form = {"grant_type": o.get("oauth.grant", "client_credentials")} | ({"scope": o["oauth.scope"]} if "oauth.scope" in o else {})
            headers = {"Content-Type": "application/x-www-form-urlencoded"}
            if o.get("oauth.client.auth.type", "header") == "header":
                headers["Authorization"] = "Basic " + base64.b64encode(f"{o['oauth.client']}:{o['oauth.client.secret']}".encode()).decode()
            else:
                form |= {"client_id": o["oauth.client"], "client_secret": o["oauth.client.secret"]}
            request = urllib.request.Request(o["oauth.access.token.url"], urllib.parse.urlencode(form).encode(), headers)
            with urllib.request.urlopen(request, timeout=60) as got:
                self._token = json.load(got)["access_token"]
        return {header: f"{o.get('oauth.header.prefix', 'Bearer')} {self._token}"}

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_token"}  # each task signs in for itself


class RestDataSource(ds.DataSource):
    """spark.read.format("rest") with options base.url, manifest.content, manifest.path or manifest.url, schema (resource), api (operation),
    derived.property.<name>, auth.type and its options, fetch.size, partition.column, partition.lower, partition.upper, partition.num."""

    @classmethod
    def name(cls) -> str:
        return "rest"

    def _options(self) -> dict[str, str]:
        o = {k.lower(): v for k, v in self.options.items()}
        for name in ("base.url", "schema", "api"):
            if name not in o:
                raise ValueError(f"option {name} is missing")
        return o

    def _operation(self) -> Operation:
        o = self._options()
        if "manifest.content" in o:
            text = o["manifest.content"]
        elif path := o.get("manifest.path") or o.get("manifest.file.path"):
            with open(path, encoding="utf-8") as f:
                text = f.read()
        elif "manifest.url" in o:
            with urllib.request.urlopen(o["manifest.url"], timeout=60) as got:
                text = got.read().decode()
        else:
            raise ValueError("one of manifest.content, manifest.path and manifest.url must be given")
        head = "derived.property."
        return Operation.of(json.loads(text), o["schema"], o["api"], {k[len(head) :]: v for k, v in o.items() if k.startswith(head)})

    def schema(self) -> str:
        return self._operation().schema()

    def reader(self, schema: StructType) -> RestReader:
        return RestReader(self._options(), self._operation(), schema)


def read_rest(spark: SparkSession, manifest: str | None = None, **options) -> DataFrame:
    """Rows of a service's operation; options with _ for the dots. `manifest` is a path that Spark reads, on any storage.

    Turns filter pushdown of Python data sources on for the session. The package must be installed on the executors.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RestDataSource)
    told = {k.replace("_", "."): str(v) for k, v in options.items() if k != "derived"} | {f"derived.property.{k}": str(v) for k, v in options.get("derived", {}).items()}
    if manifest:
        told["manifest.content"] = spark.read.text(manifest, wholetext=True).first()[0]
    return spark.read.format("rest").options(**told).load()
