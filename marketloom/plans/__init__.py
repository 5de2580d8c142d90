"""User-level jobs and reports composed from the operators."""
