"""Parsers for JSON records: applications, containers and cloud exports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import timestamps as ts
from ..schema import record


def _objects(text: Column, keys: tuple[str, ...]) -> Column:
    """The record as an array of zero or one non-empty JSON objects.

    Each named value comes as text, whatever its type. The record is read as
    the one element of an array, so that text after the object is an error.
    """
    shaped = text.rlike(r"^\s*\{") & ~text.rlike(r"^\s*\{\s*\}\s*$")
    schema = ", ".join(f"`{key}`: STRING" for key in keys)
    found = F.from_json(
        F.concat(F.lit("["), text, F.lit("]")),
        f"ARRAY<STRUCT<{schema}>>",
        {"mode": "PERMISSIVE", "allowSingleQuotes": "false"},
    )
    return F.filter(
        F.array(F.when(shaped, found)), lambda objects: F.size(objects) == 1
    )


class _Found:
    """The values read from one JSON object, by key; a dot leads into objects."""

    def __init__(self, text: Column, row: Column):
        self._text, self._row = text, row

    def value(self, key: str) -> Column:
        """The text of a value; NULL if missing or null."""
        outer, _, inner = key.partition(".")
        value = self._row[outer]
        return F.get_json_object(value, f"$.{inner}") if inner else value

    def _typed(self, key: str) -> Column:
        """The value with its type. This reads the record again: a last resort."""
        return F.try_variant_get(F.try_parse_json(self._text), f"$['{key}']", "variant")

    def _kind(self, key: str) -> Column:
        return F.schema_of_variant(self._typed(key))

    def filled(self, key: str) -> Column:
        """The text of a value unless it is empty: '', 0, false, {} and [] are."""
        value = self.value(key)
        if "." in key:
            return tx.blank_to_null(value)
        # Only these texts can stand for an empty value; the type settles which do.
        # Cases rather than conditions, since the type must not be asked for in vain.
        suspect = value.rlike(r"^(-?0(\.0+)?([eE].*)?|false|\{\}|\[\])$")
        is_text = F.coalesce(self._kind(key) == "STRING", F.lit(True))
        return (
            F.when(value.isNull() | (value == ""), F.lit(None))
            .when(suspect, F.when(is_text, value))
            .otherwise(value)
        )

    def first(self, *keys: str, default: str | None = None) -> Column:
        return F.coalesce(*[self.filled(key) for key in keys], F.lit(default))

    def or_if_absent(self, key: str, default: str) -> Column:
        """The default only where the key itself is missing; a null value stays."""
        value = self.value(key)
        named = self._text.contains(f'"{key}"')
        return (
            F.when(value.isNotNull(), value)
            .when(~named, F.lit(default))
            .when(self._typed(key).isNull(), F.lit(default))
        )

    def payload(self, key: str) -> Column:
        """An object as compact JSON text; other values are no payload."""
        value = self.value(key)
        is_object = self._kind(key).startswith("OBJECT")
        return F.when(value.startswith("{"), F.when(is_object, value))


def _records(
    text: Column, keys: tuple[str, ...], build: Callable[[_Found], dict[str, Column]]
) -> Column:
    """Read all keys once, then choose among them, then read the time.

    Each step is a transform of its own, since a value bound by a transform is
    computed once, however often the next step uses it.
    """
    names: list[str] = []

    def choose(objects: Column) -> Column:
        chosen = build(_Found(text, objects[0]))
        names[:] = chosen
        return F.struct(*[c.alias(name) for name, c in chosen.items()])

    def finish(row: Column) -> Column:
        rest = {name: row[name] for name in names if name != "time"}
        return record(timestamp=ts.any_layout(row["time"]), timestamp_raw=row["time"], **rest)

    return F.transform(F.transform(_objects(text, keys), choose), finish)


def json_records(text: Column, options) -> Column:
    """Application logs, with the field names of the common frameworks."""
    keys = (
        "timestamp", "time", "@timestamp", "level", "severity", "logLevel", "message", "msg",
        "log", "textPayload", "ip", "client_ip", "user_agent", "userAgent", "httpUserAgent",
        "status", "status_code", "response_time", "latency", "request_time", "module", "logger",
        "logName", "logStream",
    )
    return _records(
        text,
        keys,
        lambda o: {
            "time": o.first("timestamp", "time", "@timestamp"),
            "level": o.first("level", "severity", "logLevel", default="UNKNOWN"),
            "message": o.first("message", "msg", "log", "textPayload", default=""),
            "ip": o.first("ip", "client_ip"),
            "user_agent": o.first("user_agent", "userAgent", "httpUserAgent"),
            "status_code": o.first("status", "status_code"),
            "request_time": o.first("response_time", "latency", "request_time"),
            "module": o.first("module", "logger", "logName", "logStream", default="unknown"),
        },
    )


def docker_records(text: Column, options) -> Column:
    return _records(
        text,
        ("time", "level", "container_name", "source", "log", "user_agent"),
        lambda o: {
            "time": o.value("time"),
            "level": o.or_if_absent("level", "INFO"),
            "module": o.first("container_name", "source", default="docker"),
            "message": tx.rstrip(o.first("log", default="")),
            "user_agent": o.value("user_agent"),
        },
    )


def kubernetes_records(text: Column, options) -> Column:
    place = ("kubernetes.namespace_name", "kubernetes.pod_name", "kubernetes.container_name")
    return _records(
        text,
        ("kubernetes", "time", "timestamp", "level", "severity", "log", "message", "userAgent", "httpUserAgent"),
        lambda o: {
            "time": o.first("time", "timestamp"),
            "level": o.first("level", "severity", default="INFO"),
            "module": F.coalesce(
                tx.blank_to_null(F.concat_ws("/", *[o.filled(key) for key in place])),
                F.lit("kubernetes"),
            ),
            "message": o.first("log", "message", default=""),
            "user_agent": o.first("userAgent", "httpUserAgent"),
        },
    )


def cloudwatch_records(text: Column, options) -> Column:
    return _records(
        text,
        ("timestamp", "level", "severity", "logGroup", "logStream", "message", "@message", "userAgent"),
        lambda o: {
            "time": o.value("timestamp"),
            "level": o.first("level", "severity", default="INFO"),
            "module": o.first("logGroup", "logStream", default="cloudwatch"),
            "message": o.first("message", "@message", default=""),
            "user_agent": o.value("userAgent"),
        },
    )


def gcp_records(text: Column, options) -> Column:
    """A payload that is an object becomes the message as compact JSON."""
    return _records(
        text,
        (
            "timestamp", "receiveTimestamp", "severity", "logName", "textPayload", "jsonPayload",
            "protoPayload", "httpRequest",
        ),
        lambda o: {
            "time": o.first("timestamp", "receiveTimestamp"),
            "level": o.or_if_absent("severity", "INFO"),
            "module": F.substring_index(o.first("logName", default="gcp"), "/", -1),
            "message": F.coalesce(
                o.filled("textPayload"),
                o.payload("jsonPayload"),
                o.payload("protoPayload"),
                F.lit(""),
            ),
            "user_agent": o.value("httpRequest.userAgent"),
        },
    )
