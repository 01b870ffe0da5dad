"""Registered queries with their SQL counterparts."""


def all_queries():
    from . import registry
    from . import q_designs, q_genome, q_history, q_library, q_pairs, q_sequence, q_sources, q_text  # noqa: F401

    return registry.QUERIES, registry.ORACLES
