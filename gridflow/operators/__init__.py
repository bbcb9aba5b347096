"""Operators over DataFrames: rows, joins, pivot, validation, change sets, sheets."""
