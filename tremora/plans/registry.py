"""All registered queries and their SQL: modules of plans add theirs when they are imported."""

from tremora.plans import catalogue, domains  # noqa: F401
from tremora.plans.catalogue import QUERIES  # noqa: F401
from tremora.plans.oracles import ORACLES  # noqa: F401
