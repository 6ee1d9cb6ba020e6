"""Registered queries and the engine's commands."""
