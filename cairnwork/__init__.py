"""Analytics over content-addressed stores, as DataFrame operators on Spark."""
