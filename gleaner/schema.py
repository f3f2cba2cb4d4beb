"""Table layouts."""

from __future__ import annotations

ITEMS = "item_id string, vec array<double>"
SCORES = "method string, repeat int, item_id string, score double"
RANKING = "method string, rank bigint, item_id string, gain double"
MEMBERSHIP = "site string, subject_id string"
SPLITS = "target string, split string, subject_id string"
EVALS = "gen int, cand int, weights map<string,double>, fitness double"
