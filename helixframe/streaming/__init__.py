"""Structured Streaming forms of the batch operators.

The reference has no streaming operator (its inputs are static files). This
package only lets the same batch operators run incrementally over files that
keep arriving: each micro-batch is a plain DataFrame handed to the batch code.
"""
