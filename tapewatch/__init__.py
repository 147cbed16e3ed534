"""Order-flow surveillance analytics expressed as PySpark DataFrame operators."""
