"""Deterministic masking of personal and financial columns as Spark jobs."""

from maskloom.operators.masking import mask_column, mask_side_by_side, mask_table
from maskloom.operators.policy import read_policy_file

__all__ = ["mask_column", "mask_side_by_side", "mask_table", "read_policy_file"]
