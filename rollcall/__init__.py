"""Benefit eligibility over school and social-registry tables, as Spark jobs."""
