"""Builders of logical plans: filters, the wide row, exports."""
