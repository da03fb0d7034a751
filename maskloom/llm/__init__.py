"""Operators that prepare training text for language models. Nothing else imports them."""
