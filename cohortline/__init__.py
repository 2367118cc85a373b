"""cohortline: customer-order analytics as lazy Spark DataFrame plans.

Cleaning, data-quality rules, new/reactivated/retained order classification,
customer-grain and revenue/platform marts, dashboard aggregates, model-trust
checks and ad-hoc SQL, all expressed with built-in Spark SQL functions.
"""

__version__ = "0.1.0"
