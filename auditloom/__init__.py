"""Auditloom: a PySpark-native engine that audits technical manuscripts at corpus scale."""

__version__ = "0.1.0"
