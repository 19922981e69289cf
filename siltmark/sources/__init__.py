"""Readers: repositories, histories, lockfiles, coverage reports and advisories."""
