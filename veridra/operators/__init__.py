"""Checks, rules, uniqueness, references, arrays, profiles, migration and schema algebra."""
