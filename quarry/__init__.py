"""quarry: a Spark-native engine for tenant file intake, RAW snapshots,
column profiling, rule-based normalization and entity building.

Every public operator is DataFrame in -> DataFrame out. Nothing is collected
to the driver; ids are derived from natural keys so recomputation is stable.
"""

__version__ = "0.1.0"
