"""Analytics over chart data recovered from documents, as Spark DataFrame operators."""
