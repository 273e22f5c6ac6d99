"""Composite plans: from scenes to one report row each, and the queries over the driver's tables."""
