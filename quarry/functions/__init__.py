"""Column functions of the engine."""

from quarry.functions.columns import all_or, blank_to_null, email_valid, mask_email, mask_name, percent, row_hash, seconds_between, surrogate_key, total

__all__ = ["all_or", "blank_to_null", "email_valid", "mask_email", "mask_name", "percent", "row_hash", "seconds_between", "surrogate_key", "total"]
