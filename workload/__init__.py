"""The registered queries, their inputs made from the driver's tables, and their SQL."""
