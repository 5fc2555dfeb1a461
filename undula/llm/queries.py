"""Imports every module of the subpackage that registers queries."""

from undula.llm import q_chat, q_decontaminate, q_lexical, q_mixing, q_neighbours, q_periodic, q_quality, q_simhash, q_substrings, q_tokens, q_topk, q_toxicity, q_urls  # noqa: F401
from undula.llm.catalogue import ORACLES, QUERIES  # noqa: F401
