"""Readers, generators and writers; each is a DataFrame in or out."""
