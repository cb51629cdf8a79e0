"""Exports of answers, audits and reports."""
