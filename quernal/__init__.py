"""Analytics over positions, intervals, groups and rules, on PySpark."""
