"""Declarative query plans: facts, marts, in-app analytics, metrics, reports."""
