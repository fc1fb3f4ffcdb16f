"""Analytics of a shared pixel canvas's placement log, as PySpark DataFrame operators."""
