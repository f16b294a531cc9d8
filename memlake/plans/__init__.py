"""Whole paths built from operators: reading, writing, and the registered queries."""
