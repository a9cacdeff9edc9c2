"""Leak-free analytics on contest data, as functions from DataFrame to DataFrame."""
