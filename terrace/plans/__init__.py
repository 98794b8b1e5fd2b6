"""Registered queries, their SQL equivalents, and whole builds."""
