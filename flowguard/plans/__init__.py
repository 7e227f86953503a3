"""Registered queries: each operator run over the given tables, with its SQL twin."""


def load_all():
    """Import every query module; returns (queries, oracle_sql)."""
    from flowguard.plans import (  # noqa: F401
        q_alerts, q_columns, q_features, q_fusion, q_ingest, q_models, q_monitoring, q_policy,
        q_rules, q_splits, q_streams, q_workflow)
    from flowguard.plans.registry import ORACLE, QUERIES
    return dict(QUERIES), dict(ORACLE)
