"""replenish: a PySpark-native supply-chain planning engine.

Every result is a lazy DataFrame built from the DataFrame API; no Python
UDF runs in the core planning path.
"""

from replenish.params import PlanParams
from replenish.plans.model import SupplyModel

__all__ = ["PlanParams", "SupplyModel"]
