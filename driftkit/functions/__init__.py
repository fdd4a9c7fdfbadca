"""Column expressions: value equality, printed forms, report texts."""

from driftkit.functions.text import change_text, provider, redact, risk_text
from driftkit.functions.values import comparable, text_form

__all__ = ["change_text", "comparable", "provider", "redact", "risk_text", "text_form"]
