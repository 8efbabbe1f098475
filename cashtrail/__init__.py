"""Spark jobs that follow stolen money to the cash machine where it leaves the bank."""
