"""Query compositions. `load_all` imports every module that registers queries."""

from __future__ import annotations

import importlib

MODULES = ["event_queries", "model_queries", "eval_queries", "twin_queries", "audit_queries", "loo_queries", "extra_queries", "file_queries", "replay_queries"]


def load_all() -> None:
    for m in MODULES:
        importlib.import_module(f"anchorline.plans.{m}")
