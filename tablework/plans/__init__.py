"""Composed work: skew handling, migrations, rename plans, duplicate resolution."""
