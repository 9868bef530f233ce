"""Scan plans, their configuration and the helpers that cut lineage between stages."""
