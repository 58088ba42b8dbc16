"""SQL that states every analysis independently, for checking results."""

from __future__ import annotations

import re

from tallyframe.oracles import abtest, game, handoff, hypothesis, library, places, realty
from tallyframe.sources.proxies import VIEWS, view_sql


def with_views(body: str) -> str:
    """Prefix a query with the definitions of the stand-in tables it names."""
    used = [v for v in VIEWS if re.search(rf"\b{v}\b", body)]
    views = ",\n".join(f"{v} AS ({view_sql(v)})" for v in used)
    body = body.strip()
    if not used:
        return body
    if body[:5].upper() == "WITH ":
        return f"WITH {views},\n{body[5:]}"
    return f"WITH {views}\n{body}"


def oracle_sql() -> dict[str, str]:
    bodies: dict[str, str] = {}
    for study in (game, library, realty, hypothesis, abtest, places, handoff):
        bodies.update(study.SQL)
    return {name: with_views(body) for name, body in bodies.items()}
