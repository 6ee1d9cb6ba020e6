"""Relational operators over snapshots, entries, references and chunks."""
