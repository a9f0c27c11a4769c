"""Checks numbers claimed about long documents, and scores whole batches of such claims, as DataFrame jobs."""
