"""Named queries over the driver's tables, each with the SQL that checks it where SQL can express it."""

from __future__ import annotations

from . import compare, dossiers, functions, money, texts

QUERIES = dossiers.QUERIES | functions.QUERIES | money.QUERIES | compare.QUERIES | texts.QUERIES
ORACLES = dossiers.ORACLES | functions.ORACLES | money.ORACLES | compare.ORACLES | texts.ORACLES
