"""tidefold: an analytics engine for operation logs, tables and views on Spark."""
