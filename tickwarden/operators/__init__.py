"""Operators over samples, rules, alarms and catalogs."""
