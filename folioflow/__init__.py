"""folioflow: document-processing and analytics operators for PySpark.

Every operator takes and returns DataFrames or Columns; order is always carried
by explicit key columns, never by the physical order of rows.
"""

__version__ = "0.1.0"
