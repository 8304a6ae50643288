"""Readers and writers of ballots, orders, features, result logs and models."""
