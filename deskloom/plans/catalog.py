"""All queries of the core library."""

from __future__ import annotations

from deskloom.plans import analytics_plans, policy_plans, queue_plans, retrieval_plans, source_plans, text_plans, thread_plans
from deskloom.plans.registry import Registry

CORE = Registry()
for module in (queue_plans, analytics_plans, thread_plans, retrieval_plans, policy_plans, text_plans, source_plans):
    for name, query in module.R.queries.items():
        CORE.add(name, module.R.oracle.get(name))(query)
