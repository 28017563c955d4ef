"""Imports every query module; each registers itself."""

from lumen.llm import (  # noqa: F401
    q_ann, q_decontaminate, q_html, q_language, q_lines, q_manifest, q_mixing, q_phrases, q_pii, q_secrets, q_simhash, q_substrings,
    q_toxicity)
from lumen.llm.registry import ORACLE, QUERIES  # noqa: F401
