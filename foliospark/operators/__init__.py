"""Dataflow operators over documents, pass outputs and jobs."""
