"""tallyloom: a PySpark-native engine for panels, record matching and estimates.

Subpackages: operators (DataFrame to DataFrame), functions (column helpers),
sources (readers and writers), plans (registered queries with their SQL
oracles), streaming (the same panel operators over streams).
"""

__version__ = "0.1.0"
