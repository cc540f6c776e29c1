"""Numerics on single sequences, without Spark; Arrow functions call them."""
