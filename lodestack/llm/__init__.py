"""Operators that prepare text for training; nothing else imports them."""
