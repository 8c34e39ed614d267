"""Query catalogue: importing this module registers every query."""

from __future__ import annotations

from churnlab.plans.oracle_base import with_ctes
from churnlab.plans.registry import register
from churnlab.sources.fixture import policyholders


@register("fixture_policyholders", with_ctes("SELECT * FROM policyholders"))
def q_fixture(spark, sf_dir):
    """The derived 40-column policyholder table itself (FIXTURES.md)."""
    return policyholders(spark, sf_dir)


from churnlab.plans import q_base  # noqa: E402,F401
from churnlab.plans import q_rates  # noqa: E402,F401
from churnlab.plans import q_scoring  # noqa: E402,F401
from churnlab.plans import q_evaluate  # noqa: E402,F401
from churnlab.plans import q_whatif  # noqa: E402,F401
from churnlab.plans import q_profiles  # noqa: E402,F401
from churnlab.plans import q_models  # noqa: E402,F401
