"""Duplex consensus analytics and large-table operators as PySpark DataFrame transforms."""
