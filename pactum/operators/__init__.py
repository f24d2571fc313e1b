"""Relational operators over contracts, clauses, findings, wages, law and layouts."""
