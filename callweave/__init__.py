"""Spark jobs for open-call eligibility, matching and the data sets behind them."""
