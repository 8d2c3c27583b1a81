"""Named queries over the driver tables (each module registers its queries on import)."""

from prefengine.plans import (flagship, q_eval, q_fit_udf, q_logprob, q_online, q_order, q_pairs, q_policy, q_stream,  # noqa: F401
                              q_recipes, q_text, q_tokens, q_train)
from prefengine.plans.registry import ORACLE, QUERIES

__all__ = ["QUERIES", "ORACLE"]
