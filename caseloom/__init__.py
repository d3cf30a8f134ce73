"""An analytics engine for evidence-backed case libraries on PySpark."""
