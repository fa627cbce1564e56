"""Every query of the library by name, with its SQL where SQL can express it."""

from tidemark.plans import indicator_plans, label_plans, model_plans, nightly, pit_plans, service_plans

_ALL = (pit_plans, indicator_plans, label_plans, service_plans, model_plans, nightly)

QUERIES: dict = {}
ORACLES: dict = {}
for _plan in _ALL:
    QUERIES |= _plan.QUERIES
    ORACLES |= _plan.ORACLES
