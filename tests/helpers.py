"""Rows and paths that several test modules use."""

from __future__ import annotations

import datetime as dt
import os
from decimal import Decimal

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


def ts(s: str) -> dt.datetime:
    return dt.datetime.fromisoformat(s)


def d(s: str) -> dt.date:
    return dt.date.fromisoformat(s)


def srv():
    return {"type": "SERVERLESS_COMPUTE", "cluster_id": None}


def classic(cluster: str):
    return {"type": "CLASSIC_COMPUTE", "cluster_id": cluster}


def run(ws, job, run_id, start, compute, duration=60):
    return (ws, job, run_id, ts(start), duration, compute)


def usage_row(date, ws, product, serverless, qty, sku="SKU_1", job="j1", end=None, tags=None):
    end_ts = ts(end) if end else dt.datetime.combine(d(date), dt.time(1))
    return (d(date), end_ts, ws, sku, "DBU", Decimal(str(qty)), product,
            {"is_serverless": serverless}, {"job_id": job}, tags or {})


def price_row(sku, start, end, price):
    return (sku, "DBU", ts(start), ts(end) if end else None, {"default": Decimal(str(price))})
