"""Stages: one lazy plan over all days and tickers each."""
