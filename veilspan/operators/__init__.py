"""Relational operators over spans: recognizers, policy, overlap, surrogates, rewriting, scoring."""
