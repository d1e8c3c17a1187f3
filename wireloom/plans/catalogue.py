"""All registered queries with their independent SQL."""

from __future__ import annotations

import importlib
import re

from wireloom.plans.carriers import VIEWS, carrier_sql
from wireloom.session import ship

_PARTS = ("packets", "frames", "streams", "reports", "wire")


def _load(attr: str) -> dict:
    out: dict = {}
    for part in _PARTS:
        try:
            module = importlib.import_module(f"wireloom.plans.catalogue_{part}")
        except ModuleNotFoundError as e:
            if f"catalogue_{part}" not in str(e):
                raise
            continue
        out.update(getattr(module, attr))
    return out


def _shipped(query):
    def run(spark, sf_dir):
        ship(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict:
    return {name: _shipped(query) for name, query in _load("QUERIES").items()}


def oracle_sql() -> dict[str, str]:
    """Carriers become common table expressions in front of each statement."""
    out = {}
    for name, text in _load("ORACLES").items():
        used = [v for v in VIEWS if "{%s}" % v in text]
        for v in used:
            text = text.replace("{%s}" % v, f"c_{v}")
        ctes = ", ".join(f"c_{v} AS ({carrier_sql(v, 'duck')})" for v in used)
        body = text.strip()
        m = re.match(r"WITH\s+(RECURSIVE\s+)?", body, re.I)
        if not ctes:
            out[name] = body
        elif m:
            out[name] = f"WITH {m.group(1) or ''}{ctes}, {body[m.end():]}"
        else:
            out[name] = f"WITH {ctes} {body}"
    return out
