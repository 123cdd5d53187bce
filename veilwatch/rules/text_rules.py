"""Secret and personal-data patterns for text masking and detection.

Fixed values: the patterns, labels and their order decide the masked text, because a later
rule sees the labels an earlier one has put in.
"""

from __future__ import annotations

from typing import NamedTuple


class TextRule(NamedTuple):
    kind: str
    label: str
    pattern: str
    literal: str | None  # every match holds this text; None when there is no such text
    words: tuple[str, ...] = ()  # every match holds one of these, compared in upper case


# Fixed values, in order.  The kind names are ours.
TEXT_RULES = [
    TextRule("AWS access key", "[AWS_KEY]", r"AKIA[0-9A-Z]{16}", "AKIA"),
    TextRule("GitHub token", "[GITHUB_TOKEN]", r"ghp_[A-Za-z0-9]{36}", "ghp_"),
    TextRule("GitHub fine-grained token", "[GITHUB_PAT]", r"github_pat_[A-Za-z0-9_]{82}",
             "github_pat_"),
    TextRule("GitHub server token", "[GITHUB_SECRET]", r"ghs_[A-Za-z0-9]{36}", "ghs_"),
    TextRule("Slack token", "[SLACK_TOKEN]", r"xox[baprs]-[0-9A-Za-z\-]{10,}", "xox"),
    TextRule("Google API key", "[GOOGLE_KEY]", r"AIza[0-9A-Za-z_\-]{35}", "AIza"),
    TextRule("Stripe key", "[STRIPE_KEY]", r"sk_(live|test)_[0-9a-zA-Z]{24,}", "sk_"),
    TextRule("JSON web token", "[JWT]",
             r"eyJ[A-Za-z0-9_\-]{10,}\.[A-Za-z0-9_\-]{10,}\.[A-Za-z0-9_\-]{10,}", "eyJ"),
    TextRule("Private key block", "[PRIVATE_KEY_BLOCK]",
             r"-----BEGIN [A-Z ]+PRIVATE KEY-----[\s\S]*?-----END [A-Z ]+PRIVATE KEY-----",
             "PRIVATE KEY-----"),
    TextRule("Email address", "[EMAIL]", r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}", "@"),
    TextRule("Key-value secret", "[SECRET=REDACTED]",
             r"(?i)(password|passwd|secret|token|api[_\-]?key|access[_\-]?key)"
             r"""\s*[=:]\s*['"]?\S{8,}['"]?""", None,
             ("PASSWORD", "PASSWD", "SECRET", "TOKEN", "API", "ACCESS")),
    TextRule("Hex token", "[HEX_TOKEN]", r"\b[0-9a-f]{32,64}\b", None),
]

# The e-mail rule as Java runs it: a match can only begin where a run of mailbox characters
# begins or where the last match ended, and a run is never given back.  Same matches, but
# linear on long unbroken text, where the plain form is quadratic.
EMAIL_LINEAR = (r"(?:\G|(?<![a-zA-Z0-9._%+\-]))"
                r"[a-zA-Z0-9._%+\-]++@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}")


def java_pattern(rule: TextRule) -> str:
    """The rule's pattern for Spark: Unicode classes on."""
    return "(?U)" + (EMAIL_LINEAR if rule.label == "[EMAIL]" else rule.pattern)
