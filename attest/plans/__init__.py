"""Planners: from declarations to fused DataFrame jobs."""
