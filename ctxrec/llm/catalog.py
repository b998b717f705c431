"""Imports every operator, so that their queries and SQL are registered."""

from __future__ import annotations

from . import (decontaminate, hard_negatives, lexical_search, lm_score, ngram_join, pii, quality, secrets,  # noqa: F401
               sentencepiece, substring_dedup, token_count, toxicity, url_filter)
from .common import ORACLE, QUERIES  # noqa: F401
