"""Operators for preparing language-model training data at corpus scale.

Nothing outside this folder imports it; the modules here import each other only.
"""
