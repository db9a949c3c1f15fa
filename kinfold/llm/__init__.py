"""Corpus operators for training-data preparation; nothing else imports them."""
