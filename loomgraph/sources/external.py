"""Connectors to the world outside: HTTP requests and subprocesses, a row each, in Arrow batches; off unless asked for,
as their results aren't deterministic and a retried task asks again."""

from __future__ import annotations

import json
import subprocess
import time
import urllib.error
import urllib.request

import pandas as pd
from pyspark.sql import DataFrame

HTTP = "status_code int, success boolean, body string, json string, error string"
SHELL = "stdout string, stderr string, exit_code int, success boolean"


class _Stay(urllib.request.HTTPRedirectHandler):
    def redirect_request(self, *_):
        return None


def request(url: str, method: str = "GET", headers: dict | None = None, body=None, timeout: float = 30.0, follow_redirects: bool = False) -> dict:
    """One request; success is a status of 2xx. A JSON object is kept as such too. Redirects aren't followed unless
    asked for."""
    data = None if body is None else (body if isinstance(body, str) else json.dumps(body)).encode()
    req = urllib.request.Request(url, data=data, method=method or "GET", headers=headers or {})
    if body is not None and not isinstance(body, str):
        req.add_header("Content-Type", "application/json")
    opener = urllib.request.build_opener(*([] if follow_redirects else [_Stay]))
    try:
        with opener.open(req, timeout=timeout) as r:
            status, text, kind = r.status, r.read().decode("utf-8", "replace"), r.headers.get("Content-Type", "")
    except urllib.error.HTTPError as e:
        status, text, kind = e.code, e.read().decode("utf-8", "replace"), e.headers.get("Content-Type", "")
    except OSError as e:
        return {"status_code": None, "success": False, "body": None, "json": None, "error": str(e)}
    parsed = None
    if "json" in kind:
        try:
            parsed = text if isinstance(json.loads(text), dict) else None
        except ValueError:
            pass
    return {"status_code": status, "success": 200 <= status < 300, "body": text, "json": parsed, "error": None}


def http(df: DataFrame, **how) -> DataFrame:
    """df, which has a column url, with the response's columns."""
    names = [f.strip().split()[0] for f in HTTP.split(",")]

    def run(batches):
        for pdf in batches:
            got = [request(u, **how) for u in pdf["url"]]
            yield pd.concat([pdf, pd.DataFrame(got, columns=names, index=pdf.index)], axis=1)

    return df.mapInPandas(run, f"{_schema(df)}, {HTTP}")


def command(args: list[str], env: dict | None = None, cwd: str | None = None, timeout: float | None = None) -> dict:
    """A command's output; an exit code that isn't 0 is a result, not an error."""
    began = time.monotonic()
    try:
        p = subprocess.run(args, capture_output=True, text=True, env=env, cwd=cwd, timeout=timeout)
    except subprocess.TimeoutExpired as e:
        raise TimeoutError(f"over {time.monotonic() - began:.1f} s") from e
    return {"stdout": p.stdout, "stderr": p.stderr, "exit_code": p.returncode, "success": p.returncode == 0}


def shell(df: DataFrame, **how) -> DataFrame:
    """df, which has an array column args, with the command's output."""
    names = [f.strip().split()[0] for f in SHELL.split(",")]

    def run(batches):
        for pdf in batches:
            got = [command(list(a), **how) for a in pdf["args"]]
            yield pd.concat([pdf, pd.DataFrame(got, columns=names, index=pdf.index)], axis=1)

    return df.mapInPandas(run, f"{_schema(df)}, {SHELL}")


def _schema(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
