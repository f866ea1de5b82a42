"""Operators for preparing training data of language models. Nothing else imports this package."""
