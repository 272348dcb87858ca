"""Operators for preparing training text: dedup, filters, tokens, extraction.

Each module holds one operator: functions from DataFrame to DataFrame, written for tables far larger than a
machine.  ``queries`` registers one query per operator.  Nothing else in the library imports this folder.
"""
