"""Query catalogue: names to callables and to the DuckDB SQL that checks them."""

from tidemark.plans import frames, ingest, layers, learning, market, payloads, policies, reports, research, risk, universes, unlock

QUERIES: dict = {}
ORACLES: dict = {}
for module in (market, research, reports, unlock, ingest, payloads, layers, policies, risk, frames, universes, learning):
    QUERIES |= module.QUERIES
    ORACLES |= module.ORACLES
