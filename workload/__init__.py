"""The registered queries, their inputs, and the same results spelled in SQL."""
