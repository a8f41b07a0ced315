"""Firnline: recommendation, catalogue, event-funnel and corpus analytics written as Spark jobs."""
