"""Registered queries, each beside the SQL it equals."""
