"""Operators of a training-data pipeline over text tables, and their registered queries."""


def load_all():
    """Import every query module; returns (queries, oracle_sql)."""
    from flowguard.llm import (  # noqa: F401
        q_bpe, q_decontamination, q_licenses, q_near, q_packing, q_quality, q_rules, q_search,
        q_secrets, q_substring, q_toxicity, q_trie, q_urls)
    from flowguard.llm.registry import ORACLE, QUERIES
    return dict(QUERIES), dict(ORACLE)
