"""Event studies on daily price panels, written as Spark DataFrame operators."""
