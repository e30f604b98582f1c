"""The wide ``hits`` table, the 43-query workload, and one plan per operator."""
