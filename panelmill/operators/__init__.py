"""Operators on DataFrames: cleaning, states, panels, transitions, weighted statistics, profiles, registry."""
