"""Operators over graphs: cleaning, statistics, peeling, density, exact values, checks, chart data."""
