"""riskfabric: population health-risk analytics as Spark DataFrame jobs.

Survey responses are recoded into binary outcomes and covariates, long-form
neighbourhood measures are pivoted into wide state and ZIP tables, the two are
joined, missing income is filled from tiered group medians, one boosted-tree
classifier per outcome is trained and scored, and exact ranking metrics, an
operating point, a subgroup error audit, importances and demographic risk
tables are reported.  Every function takes and returns DataFrames.
"""

__version__ = "0.1.0"
