"""Operators for preparing training text at cluster scale."""
