"""Learner-risk analytics as Spark jobs."""
