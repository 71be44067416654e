"""Batches to a webhook or an advertising audience, through a data source writer with commit and abort.

Rows are numbered into batches by their key before any is sent, and a task holds whole batches, so a task that fails and runs
again sends the same batches under the same idempotency keys, which the receiver collapses. Only when all tasks have
succeeded does commit() end the run: it leaves a receipt (webhook), or sends the last batch of the session, which makes the remote
side replace its audience. After an abort neither happens and the run can be started again.
"""

from __future__ import annotations

import hashlib
import hmac
import http.client
import json
import os
import time
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby
from urllib.parse import urlsplit

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from pledgework.operators.traits import global_rank
from pledgework.sources.pulls import named

#: Attempts at a batch, the largest body, rows of a batch, the columns of an audience.
ATTEMPTS, LARGEST, WEBHOOK_ROWS, AUDIENCE_ROWS = 5, 8 << 20, 500, 1000
AUDIENCE = ("email", "phone", "fn", "ln", "zip", "ct", "st", "country", "external_id")
AUDIENCE_SCHEMA = ("EMAIL", "PHONE", "FN", "LN", "ZIP", "CT", "ST", "COUNTRY", "EXTERN_ID")
KEPT_HEADERS = frozenset("content-type content-length host x-signature x-timestamp idempotency-key".split())


class DeliveryError(RuntimeError):
    """A delivery that was refused or never got through."""


@dataclass
class Sent(WriterCommitMessage):
    batches: list[int]
    rows: int


def post(url: str, body: bytes, headers: dict) -> int:
    """One request; the status. Redirects aren't followed."""
    at = urlsplit(url)
    if at.scheme != "https" or not at.hostname or at.username:
        raise DeliveryError("only plain https addresses are delivered to")
    link = http.client.HTTPSConnection(at.hostname, at.port or 443, timeout=10)
    try:
        link.request("POST", (at.path or "/") + (f"?{at.query}" if at.query else ""), body, headers)
        answer = link.getresponse()
        answer.read(1 << 16)
        return answer.status
    finally:
        link.close()


def into_folder(url: str, body: bytes, headers: dict) -> int:
    """A receiver for tests: a file by idempotency key, which a second delivery doesn't change; others see whole files only."""
    key = headers["Idempotency-Key"]
    part = f"{url}/.{key}-{os.getpid()}-{time.monotonic_ns()}"
    with open(part, "wb") as f:
        f.write(json.dumps({"headers": headers, "body": body.decode()}).encode())
    try:
        os.link(part, f"{url}/{key}.json")
    except FileExistsError:
        pass
    finally:
        os.unlink(part)
    return 200


def deliver(url: str, payload: dict, key: str, secret: str, headers: dict[str, str] | None = None, send=post, sleep=time.sleep) -> None:
    """A signed batch, tried at most ATTEMPTS times: again after a network fault, 429 or a server's error, not after another refusal."""
    body = json.dumps(payload, separators=(",", ":"), ensure_ascii=False).encode()
    if len(body) > LARGEST:
        raise DeliveryError("a batch exceeds 8 MiB: take fewer rows or fields")
    if bad := [h for h, v in (headers or {}).items() if h.lower() in KEPT_HEADERS or not h.strip() or any(c in f"{h}{v}" for c in "\r\n")]:
        raise DeliveryError(f"these headers can't be set: {bad}")
    signed = {"Content-Type": "application/json", "X-Signature": "sha256=" + hmac.new(secret.encode(), body, hashlib.sha256).hexdigest(), "X-Timestamp": str(int(time.time())), "Idempotency-Key": key}
    for attempt in range(ATTEMPTS):
        try:
            status = send(url, body, {**(headers or {}), **signed})
        except (OSError, http.client.HTTPException):
            status = 503
        if 200 <= status < 300:
            return
        if status != 429 and status < 500:
            raise DeliveryError(f"refused with status {status}")
        if attempt + 1 < ATTEMPTS:
            sleep(min(2 ** (attempt + 1), 32))
    raise DeliveryError(f"not delivered after {ATTEMPTS} attempts")


class BatchWriter(DataSourceWriter):
    """Options: url, secret, run, batches; send and sleep (dotted names of other transports), headers (JSON), facts (JSON, into each payload), receipt (a file that tells of the whole run)."""

    def __init__(self, options: dict, columns: list[str]):
        self.options, self.columns = dict(options), columns

    def payload(self, number: int, rows: list[dict]) -> dict:
        gone = [{k: v for k, v in r.items() if k in ("profile_id", "master_id")} for r in rows if r["removed"]]
        added = [{k: v for k, v in r.items() if k not in ("batch", "removed")} for r in rows if not r["removed"]]
        return {**json.loads(self.options.get("facts", "{}")), "run_id": self.options["run"], "batch": number, "batches": int(self.options["batches"]), "added": added, "removed": gone}

    def send(self, number: int, payload: dict) -> None:
        more = {k: named(self.options[k]) for k in ("send", "sleep") if k in self.options}
        deliver(self.options["url"], payload, f"{self.options['run']}-{number}", self.options["secret"], json.loads(self.options.get("headers", "{}")), **more)

    def write(self, iterator: Iterator) -> Sent:
        """Rows come sorted by batch, so one batch is held at a time."""
        done, n = [], 0
        for number, rows in groupby((dict(zip(self.columns, r)) for r in iterator), key=lambda r: r["batch"]):
            rows = [{k: v if v is None or isinstance(v, (bool, int, float, str, list)) else str(v) for k, v in r.items()} for r in rows]
            self.send(number, self.payload(number, rows))
            done.append(number)
            n += len(rows)
        return Sent(done, n)

    def commit(self, messages: list) -> None:
        sent = sorted(b for m in messages if m for b in m.batches)
        if sent != sorted(set(sent)):
            raise DeliveryError("a batch was dealt to several tasks")
        if "receipt" in self.options:
            with open(self.options["receipt"], "w", encoding="utf-8") as f:
                json.dump({"run": self.options["run"], "batches": len(sent), "rows": sum(m.rows for m in messages if m)}, f)

    def abort(self, messages: list) -> None:
        """Nothing to take back: without a receipt the run is not done, and its next try has the same idempotency keys."""


class AudienceWriter(BatchWriter):
    """Digests of people, in the column order of AUDIENCE. The session's last batch, an empty one, is sent by commit() only; until then the remote side keeps its old audience."""

    def payload(self, number: int, rows: list[dict]) -> dict:
        data = [[r[c] or "" for c in AUDIENCE] for r in rows]
        if any(v and (len(v) != 64 or set(v) - set("0123456789abcdef")) for r in data for v in r):
            raise DeliveryError("an audience holds digests only")
        return self.session(number, False, data)

    def session(self, number: int, last: bool, data: list) -> dict:
        return {"session": {"session_id": self.options["run"], "batch_seq": number, "last_batch_flag": last}, "payload": {"schema": AUDIENCE_SCHEMA, "data": data}}

    def commit(self, messages: list) -> None:
        super().commit(messages)
        self.send(int(self.options["batches"]) + 1, self.session(int(self.options["batches"]) + 1, True, []))


class Webhook(DataSource):
    @classmethod
    def name(cls) -> str:
        return "webhook"

    def writer(self, schema, overwrite: bool) -> BatchWriter:
        return BatchWriter(self.options, schema.fieldNames())


class Audience(Webhook):
    @classmethod
    def name(cls) -> str:
        return "audience"

    def writer(self, schema, overwrite: bool) -> AudienceWriter:
        return AudienceWriter(self.options, schema.fieldNames())


def numbered(rows: DataFrame, key: str, size: int) -> DataFrame:
    """A batch number from 1 by the order of the key, so many rows each; the same rows always have the same numbers."""
    ranked = global_rank(rows, "place", F.asc(key))
    return ranked.withColumn("batch", F.floor((F.col("place") - 1) / size).cast("int") + 1).drop("place")


def delivered(kind: str, rows: DataFrame, key: str, run: str, url: str, secret: str, size: int | None = None, **options: str) -> int:
    """Sends all rows in batches of size and gives their number; kind: webhook or audience. A webhook's rows may have a column removed."""
    spark = rows.sparkSession
    for source in (Webhook, Audience):
        spark.dataSource.register(source)
    if kind == "webhook" and "removed" not in rows.columns:
        rows = rows.withColumn("removed", F.lit(False))
    made = numbered(rows, key, size or (WEBHOOK_ROWS if kind == "webhook" else AUDIENCE_ROWS))
    batches = made.agg(F.coalesce(F.max("batch"), F.lit(0))).first()[0]
    whole = made.repartition("batch").sortWithinPartitions("batch", key)
    whole.write.format(kind).options(url=url, secret=secret, run=run, batches=str(batches), **options).mode("append").save()
    return batches


def changes(wanted: DataFrame, last: DataFrame, key: str = "profile_id") -> DataFrame:
    """What a delta run sends: new members with their fields, and the keys of those who are members no more, as removed."""
    new = wanted.join(last.select(key), key, "left_anti").withColumn("removed", F.lit(False))
    gone = last.join(wanted.select(key), key, "left_anti").withColumn("removed", F.lit(True))
    return new.unionByName(gone, allowMissingColumns=True)
